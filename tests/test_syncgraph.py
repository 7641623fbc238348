"""Blocked states: small programs with known rows, and a search through all executions."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from compare import BASE
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.operators import syncgraph
from factweave.sources import facts


def program(folder, functions: dict, channels: dict, tasks: dict, edges: dict | None = None) -> str:
    """A folder with the facts of a program: functions name lists of (instruction, kind, channel or function called)."""
    insts, ops, calls = [], [], []
    for fn, body in functions.items():
        for idx, (inst, kind, what, *bb) in enumerate(body):
            insts.append((inst, fn, idx, bb[0] if bb else 0, kind, -1, False))
            if kind in ("Send", "Recv", "Close"):
                ops.append((inst, fn, what, kind))
            if kind in ("Go", "Call"):
                calls.append((fn, inst, what, kind))
    tables = {
        "inst": (insts, ["inst_id", "fn_id", "idx", "bb_id", "op", "prim", "is_defer"]),
        "chan_op": (ops, ["inst_id", "fn_id", "ch_id", "op"]),
        "call_edge": (calls, ["caller", "site", "callee", "site_kind"]),
        "channel": (list(channels.items()), ["ch_id", "buffer"]),
        "task_chan": ([(t, c) for t, cs in tasks.items() for c in cs], ["task", "ch_id"]),
        "bb_edge": ([(fn, a, b) for fn, es in (edges or {}).items() for a, b in es], ["fn_id", "src_bb", "dst_bb"]),
    }
    for name, (rows, columns) in tables.items():
        kinds = {c: "str" if c in ("op", "site_kind") else "bool" if c == "is_defer" else "int64" for c in columns}
        pd.DataFrame(rows, columns=columns).astype(kinds).to_parquet(folder / f"{name}.parquet")
    return str(folder)


def blocked(spark, folder) -> set:
    return {(r["root"], r["blocked"]) for r in syncgraph.bmoc(spark, folder).collect()}


def test_circular_wait(spark, tmp_path):
    # main makes a and b, starts a function, receives from a (10), sends to b (11); the function receives from b (7), sends to a (8).
    functions = {1: [(6, "Go", 2), (10, "Recv", 0), (11, "Send", 1)], 2: [(7, "Recv", 1), (8, "Send", 0)]}
    folder = program(tmp_path, functions, {0: 0, 1: 0}, {0: [0, 1]})
    assert blocked(spark, folder) == {(1, "7,10")}
    assert {tuple(r) for r in syncgraph.sync_paths(spark, folder).collect()} == {(1, 0, "G2 R0@10 S1@11"), (2, 0, "R1@7 S0@8")}
    # A place in each channel does not help; the function sending first does.
    (tmp_path / "b").mkdir()
    assert blocked(spark, program(tmp_path / "b", functions, {0: 1, 1: 1}, {0: [0, 1]})) == {(1, "7,10")}
    (tmp_path / "c").mkdir()
    mended = functions | {2: [(8, "Send", 0), (7, "Recv", 1)]}
    assert blocked(spark, program(tmp_path / "c", mended, {0: 0, 1: 0}, {0: [0, 1]})) == set()


def test_full_buffer(spark, tmp_path):
    # main sends twice into one place (5, 6); foo starts a function, receives from a (16), sends to b (17); it receives from b (13) first.
    functions = {1: [(5, "Send", 0), (6, "Send", 0)], 2: [(11, "Go", 3), (16, "Recv", 1), (17, "Send", 2)], 3: [(13, "Recv", 2), (14, "Send", 1)]}
    folder = program(tmp_path, functions, {0: 1, 1: 1, 2: 1}, {0: [0], 1: [1, 2]})
    assert blocked(spark, folder) == {(1, "6"), (2, "13,16")}


def test_branches_loops_closes_and_starts(spark, tmp_path):
    functions = {
        # The root starts its goroutine only on one way; on the other it receives alone.
        1: [(10, "If", -1, 0), (11, "Go", 2, 1), (12, "Recv", 0, 2)],
        2: [(20, "Send", 0)],
        # A loop that sends, once or twice, into two places; three sends need a way that goes back twice.
        3: [(30, "Send", 1, 0), (31, "If", -1, 1)],
        # A receive from a closed channel does not block; a send after the close is a panic, not a block.
        4: [(40, "Close", 2), (41, "Recv", 2), (42, "Send", 2)],
        # A channel whose buffer is not known is in no task.
        5: [(50, "Recv", 3)],
    }
    edges = {1: [(0, 1), (0, 2), (1, 2)], 3: [(0, 1), (1, 0), (1, 2)]}
    functions[3].append((32, "End", -1, 2))
    folder = program(tmp_path, functions, {0: 0, 1: 1, 2: 0, 3: -999}, {0: [0], 1: [1], 2: [2]}, edges)
    assert blocked(spark, folder) == {(1, "12"), (3, "30")}
    words = {tuple(r) for r in syncgraph.sync_paths(spark, folder).where("fn_id = 3").collect()}
    assert words == {(3, 1, "S1@30"), (3, 1, "S1@30 S1@30")}
    assert {tuple(r) for r in syncgraph.path_combinations(spark, folder).where("root = 1").collect()} == {(1, 0, "G2 R0@12 | S0@20"), (1, 0, "R0@12 | ")}


def test_combinations_of_paths_are_not_kept(spark, tmp_path, monkeypatch):
    """A root starts three functions of four words each, and one without a way to an exit on another task."""
    body = lambda n: [(n, "If", -1, 0), (n + 1, "Send", 0, 1), (n + 2, "If", -1, 2), (n + 3, "Recv", 1, 3), (n + 4, "End", -1, 4)]
    functions = {1: [(11, "Go", 2), (12, "Go", 3), (13, "Go", 4), (14, "Go", 5), (15, "Send", 2)], 5: [(50, "Send", 2)]} | {f: body(10 * f) for f in (2, 3, 4)}
    diamonds = [(0, 1), (0, 2), (1, 2), (2, 3), (2, 4), (3, 4)]
    folder = program(tmp_path, functions, {0: 1, 1: 1, 2: 1}, {0: [0, 1], 1: [2]}, dict.fromkeys((2, 3, 4), diamonds) | {5: [(0, 0)]})
    rows, kept = [], syncgraph.keep
    monkeypatch.setattr(syncgraph, "keep", lambda df: rows.append(kept(df)) or rows[-1])
    words = [["", f"S0@{f}1", f"R1@{f}3", f"S0@{f}1 R1@{f}3"] for f in (2, 3, 4)]
    want = {(1, 0, f"G2 G3 G4 | {a} | {b} | {c}") for a in words[0] for b in words[1] for c in words[2]}
    got = [tuple(r) for r in syncgraph.path_combinations(spark, folder).collect()]
    assert len(got) == 64 and set(got) == want
    assert all(r.count() < 64 for r in rows)


def test_no_channels(spark, tmp_path):
    folder = program(tmp_path, {1: [(1, "Call", 2)], 2: [(2, "Ret", -1)]}, {}, {})
    for name in syncgraph.QUERIES:
        assert syncgraph.QUERIES[name](spark, folder).count() == 0


def _stuck(words: list[tuple[str, ...]], caps: dict) -> set:
    """All sets of blocked operations (a word's number, a position) that executions of these words can end in."""
    out, seen, todo = set(), set(), [(0,) * len(words)]
    while todo:
        cut = todo.pop()
        if cut in seen:
            continue
        seen.add(cut)
        ran = [s for w, n in zip(words, cut, strict=True) for s in w[:n]]
        live = [k for k in range(len(words)) if k == 0 or f"G{k}" in words[0][: cut[0]]]
        heads = {k: words[k][cut[k]] for k in live if cut[k] < len(words[k])}
        moves, panics = [], False
        for k, head in heads.items():
            op, ch = head[0], head[1:]
            level, shut = ran.count("S" + ch) - ran.count("R" + ch), "C" + ch in ran
            if op == "G":
                moves.append([k])
            elif op in "SC" and shut:
                panics = True
            elif op == "C" or (op == "R" and (shut or level > 0)) or (op == "S" and level < caps[ch]):
                moves.append([k])
            elif op == "S" and caps[ch] == 0:
                moves += [[k, j] for j, other in heads.items() if j != k and other == "R" + ch]
        if heads and not moves and not panics:
            out.add(tuple(sorted((k, cut[k]) for k in heads)))
        todo += [tuple(n + (k in move) for k, n in enumerate(cut)) for move in moves]
    return out


STEPS = st.sampled_from(["S0", "R0", "S1", "R1", "C0"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(STEPS, max_size=4).map(tuple), min_size=1, max_size=3), st.integers(0, 2), st.integers(0, 2))
def test_order_against_all_executions(words, cap0, cap1):
    words = [tuple(f"G{k}" for k in range(1, len(words))) + words[0], *words[1:]]
    # A word runs to its ends if a last step that nothing serves is what all of it blocks at.
    ends = [(*words[0], "Rz"), *words[1:]]
    stuck = _stuck(ends, {"0": cap0, "1": cap1, "z": 0})
    runs = any(state == ((0, len(words[0])),) for state in stuck)
    assert syncgraph.has_order(tuple(words), (("0", cap0), ("1", cap1))) == runs


def _fact(sf_dir: str, name: str) -> list[tuple]:
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.sql(facts.duck_sql(f"SELECT * FROM {{{name}}}")).fetchall()


@pytest.mark.parametrize("task", [0, 5, 21])
def test_reports_against_all_executions(spark, sf_dir, task):
    """Every way of every function, every combination of ways, every execution: which operations are left blocked?"""
    insts = {r[0]: (r[1], r[2]) for r in _fact(sf_dir, "inst")}
    succ: dict = {}
    for _, a, b in _fact(sf_dir, "inst_edge"):
        succ.setdefault(a, []).append(b)
    caps = {str(c): b for c, b in _fact(sf_dir, "channel")}
    mine = {c for t, c in _fact(sf_dir, "task_chan") if t == task}
    ops = {i: f"{op[0]}{c}" for i, _, c, op in _fact(sf_dir, "chan_op") if c in mine}
    using = {insts[i][0] for i in ops}
    gos: dict = {}
    for caller, site, callee, kind in _fact(sf_dir, "call_edge"):
        if kind == "Go" and callee in using and callee != caller:
            gos.setdefault(site, []).append(callee)
    started = {(insts[s][0], c) for s, cs in gos.items() for c in cs}
    every_go = [(a, c) for a, _, c, kind in _fact(sf_dir, "call_edge") if kind == "Go"]
    lone = using - {a for a, _ in every_go} - {c for _, c in every_go}

    def ways(fn: int) -> set:
        first = min((i for i in insts if insts[i][0] == fn), key=lambda i: insts[i][1])
        out, todo, seen = set(), [(first, 0, ())], set()
        while todo:
            at, back, word = todo.pop()
            word += (at,) if at in ops or at in gos else ()
            if (at, back, word) in seen:
                continue
            seen.add((at, back, word))
            if at not in succ:
                out.add(word)
            for then in succ.get(at, ()):
                if (level := back + (insts[then][1] <= insts[at][1])) <= 1:
                    todo.append((then, level, word))
        return out

    want = set()
    for root in {a for a, _ in started} | lone:
        members = [root, *sorted(c for a, c in started if a == root)]
        combos = [[]]
        for fn in members:
            combos = [[*c, w] for c in combos for w in ways(fn)]
        for combo in combos:
            words, origin = [], []
            for k, way in enumerate(combo):
                starts = lambda i: [(f"G{members.index(c)}", i) for c in sorted(gos.get(i, ())) if c in members]
                steps = [x for i in way for x in ([(ops[i], i)] if i in ops else starts(i) if k == 0 else [])]
                words.append(tuple(s for s, _ in steps))
                origin.append([i for _, i in steps])
            for state in _stuck(words, caps):
                want.add((root, ",".join(map(str, sorted(origin[k][n] for k, n in state)))))
    got = {(r["root"], r["blocked"]) for r in syncgraph.bmoc(spark, sf_dir).where(f"task = {task}").collect()}
    assert got == want and want


def test_whole_combinations_are_judged_before_they_are_kept(spark, sf_dir, monkeypatch):
    kept, rows = syncgraph.keep, []
    monkeypatch.setattr(syncgraph, "keep", lambda df: rows.append(kept(df)) or rows[-1])
    found = syncgraph.sync_rule(spark, sf_dir).count()
    ended = [r.where("last = k").count() for k, r in enumerate([r for r in rows if "executed" in r.columns and "last" in r.columns], 1) for r in [r.selectExpr("last", f"{k} AS k")]]
    single = syncgraph.sync_rule(spark, sf_dir).where("instr(executed, '|') = 0").count()
    assert ended and sum(ended) == found - single


def test_nodes_in_a_row_are_one_node():
    """A straight line is one row; a way in, a branch, a loop and a node that stands earlier begin rows of their own."""
    assert syncgraph.runs_of({0: [1], 1: [2], 2: []}, {0: 0, 1: 1, 2: 2}, 0) == {0: [0, 1, 2]}
    succ = {0: [1], 1: [2, 4], 2: [3], 3: [4, 1], 4: [5], 5: []}
    assert syncgraph.runs_of(succ, {n: n for n in succ}, 0) == {0: [0], 1: [1], 2: [2, 3], 4: [4, 5]}
    assert syncgraph.runs_of({0: [2], 2: [1], 1: []}, {0: 0, 1: 1, 2: 2}, 0) == {0: [0, 2], 1: [1]}
