"""Small programs brought as fact tables, with results that follow from reading them."""

from __future__ import annotations

import pandas as pd
import pytest

from factweave.operators import cfg, locks
from factweave.plans import registry

QUERIES = registry.queries()


def bring(path, functions: dict[int, list[tuple]], edges=(), calls=()):
    """functions: fn_id -> (inst_id, op, prim[, bb_id]); edges: (fn_id, src_bb, dst_bb); calls: (caller, site, callee, kind)."""
    rows = []
    for fn, insts in functions.items():
        for idx, (inst, op, prim, *rest) in enumerate(insts):
            bb = rest[0] if rest else 0
            pos = sum(1 for x in insts[:idx] if (x[3] if len(x) > 3 else 0) == bb)
            rows.append((inst, fn, idx, bb, pos, op.removeprefix("defer "), prim, "main.go", inst, op.startswith("defer ")))
    inst = pd.DataFrame(rows, columns=["inst_id", "fn_id", "idx", "bb_id", "pos", "op", "prim", "file", "line", "is_defer"])
    inst.to_parquet(path / "inst.parquet")
    for name, columns, data in (("bb_edge", ["fn_id", "src_bb", "dst_bb"], edges), ("call_edge", ["caller", "site", "callee", "site_kind"], calls)):
        frame = pd.DataFrame(list(data), columns=columns)
        frame.astype({c: "int64" for c in columns if c != "site_kind"} | {c: "str" for c in columns if c == "site_kind"}).to_parquet(path / f"{name}.parquet")
    return str(path)


def rows(spark, name, path):
    return {tuple(r) for r in QUERIES[name](spark, path).collect()}


def test_double_lock_through_a_call(spark, tmp_path):
    # A method takes its lock and calls a method that takes it again; it also calls one of another type with a lock of its own.
    at = bring(
        tmp_path,
        {1: [(57, "Lock", 1), (58, "Call", 0), (60, "Call", 0), (61, "Unlock", 1)], 2: [(65, "Lock", 1), (66, "Other", 0), (67, "Unlock", 1)], 3: [(43, "Lock", 2), (44, "Other", 0), (45, "Unlock", 2)]},
        calls=[(1, 58, 2, "Call"), (1, 60, 3, "Call")],
    )
    assert rows(spark, "interprocedural_double_lock", at) == {(57, 65)}
    assert rows(spark, "live_locks_double", at) == set()
    assert rows(spark, "interprocedural_lock_pairs", at) == {(1, 2)}
    assert rows(spark, "held_locks", at) == {(1, 57, 1, n) for n in (58, 60, 61)} | {(2, 65, 1, n) for n in (66, 67)} | {(3, 43, 2, n) for n in (44, 45)}


def test_lock_order_of_a_call_against_a_function(spark, tmp_path):
    at = bring(
        tmp_path,
        {1: [(31, "Lock", 1), (32, "Call", 0), (33, "Unlock", 1)], 2: [(37, "Lock", 2), (39, "Unlock", 2)], 3: [(46, "Lock", 2), (49, "Lock", 1), (50, "Unlock", 1), (51, "Unlock", 2)]},
        calls=[(1, 32, 2, "Call")],
    )
    there, here = rows(spark, "interprocedural_lock_pairs", at), rows(spark, "live_locks_conflict", at)
    assert there == {(1, 2)} and here == {(3, 2, 1)}
    assert rows(spark, "lock_order_conflict", at) == set()  # neither function alone takes both orders


def test_calls_that_locks_are_held_across(spark, tmp_path):
    # 1 locks and calls 2, which names no lock and calls 3, which takes it again and then another; 4 releases before it calls.
    # 5 leaves with its lock: the call that it defers in a later block is entered with it, the one of its first block is not.
    at = bring(
        tmp_path,
        {
            1: [(10, "Lock", 1), (11, "Call", 0), (12, "Unlock", 1)],
            2: [(20, "Other", 0), (21, "Call", 0)],
            3: [(30, "Lock", 1), (31, "Lock", 2), (32, "Unlock", 1)],
            4: [(40, "Lock", 1), (41, "Unlock", 1), (42, "Call", 0)],
            5: [(50, "Lock", 7, 0), (51, "defer Call", 0, 0), (52, "defer Call", 0, 1)],
            6: [(60, "Lock", 7)],
            7: [(70, "Lock", 7)],
            9: [(90, "Lock", 1), (91, "Call", 0)],
            10: [(100, "Unlock", 1), (101, "Call", 0)],
            8: [(80, "Lock", 2), (81, "Lock", 1), (82, "Unlock", 1), (83, "Call", 0), (84, "Unlock", 2)],
        },
        edges=[(5, 0, 1)],
        calls=[(1, 11, 2, "Call"), (2, 21, 3, "Call"), (4, 42, 3, "Call"), (5, 51, 6, "Defer"), (5, 52, 7, "Defer"), (8, 83, 3, "Go"), (9, 91, 10, "Call"), (10, 101, 3, "Call")],
    )
    assert rows(spark, "interprocedural_double_lock", at) == {(10, 30), (50, 70)}
    assert rows(spark, "double_lock", at) == {(10, 30, 2, 1, "1>2>3"), (50, 70, 1, 1, "5>7")}
    assert rows(spark, "held_at_calls", at) == {(1, 11, 1), (8, 83, 2), (9, 91, 1), (5, 51, 7), (5, 52, 7)}
    assert rows(spark, "interprocedural_lock_pairs", at) == {(1, 2)}
    assert rows(spark, "conflict_lock", at) == {(1, 2, 2)}


def test_uses_of_fields_that_nothing_excuses(spark, tmp_path):
    # Uses in 1 (an initialiser), in 2 (most of its call sites hold a lock) and in 3 (called twice, once without a lock): only 3's
    # is a fault. Field b is locked too seldom, c is used at too few places.
    at = bring(
        tmp_path,
        {
            1: [(10, "Other", 0)],
            2: [(20, "Other", 0)],
            3: [(30, "Other", 0)],
            4: [(40, "Lock", 1), (41, "Call", 0), (42, "Call", 0), (43, "Unlock", 1), (44, "Call", 0)],
            5: [(50, "Lock", 1), (51, "Call", 0), (52, "Unlock", 1), (53, "Call", 0)],
        },
        calls=[(4, 41, 2, "Call"), (4, 42, 2, "Call"), (4, 44, 2, "Call"), (5, 51, 3, "Call"), (5, 53, 3, "Call")],
    )
    pd.DataFrame([(1, "ReInitAll"), (2, "get"), (3, "put"), (4, "main"), (5, "serve")], columns=["fn_id", "name"]).to_parquet(tmp_path / "fn_name.parquet")
    uses = [("S", "a", i, True, "x.go", i, 4) for i in range(12)] + [("S", "a", 20 + fn, False, "x.go", 20 + fn, fn) for fn in (1, 2, 3)]
    uses += [("S", "b", 40 + i, i == 0, "x.go", 40 + i, 3) for i in range(5)] + [("S", "c", 60 + i, i > 0, "x.go", 60 + min(i, 2), 3) for i in range(8)]
    pd.DataFrame(uses, columns=["struct_name", "field", "inst_id", "locked", "file", "line", "fn_id"]).to_parquet(tmp_path / "field_use.parquet")
    assert rows(spark, "fp_recursive_vote", at) == {(1, True), (2, True), (3, False), (4, False), (5, False)}
    assert rows(spark, "fp_trim_and_rerate", at) == {("S", "a", 15, 14)}
    assert rows(spark, "struct_field_race", at) == {("S", "a", "x.go", 23)}


def test_locks_that_are_forgotten(spark, tmp_path):
    # Inc: locked and never released; Value: released by a deferred call; Test0: returns with the lock; a branch that releases
    # on one way only.
    at = bring(
        tmp_path,
        {
            1: [(31, "Lock", 1), (32, "Other", 0)],
            2: [(37, "Lock", 1), (39, "defer Unlock", 1), (40, "Other", 0)],
            3: [(46, "Lock", 2), (48, "Other", 0)],
            4: [(80, "Lock", 3, 0), (86, "Unlock", 3, 1), (90, "Other", 0, 2)],
        },
        edges=[(4, 0, 1), (4, 0, 2), (4, 1, 2)],
    )
    assert {r[:2] for r in rows(spark, "forget_unlock", at)} == {(1, 31), (3, 46), (4, 80)}


def test_loop_and_dominance(spark, tmp_path):
    # 0 -> 1 -> {2, 3}, 2 -> 1, 3 -> 4: a loop of 1 and 2.
    at = bring(tmp_path, {7: [(n, "Other", 0, n) for n in range(5)]}, edges=[(7, 0, 1), (7, 1, 2), (7, 1, 3), (7, 2, 1), (7, 3, 4)])
    assert rows(spark, "natural_loops", at) == {(7, 1, 1), (7, 1, 2)}
    assert {(d, n) for _, d, n in rows(spark, "dominators", at)} == {(n, n) for n in range(5)} | {(0, n) for n in range(1, 5)} | {(1, 2), (1, 3), (1, 4), (3, 4)}
    assert rows(spark, "loop_blocks_any_backedge", at) == {(7, 1), (7, 2)}
    assert {(a, b) for _, a, b in rows(spark, "reachable_blocks", at)} == {(0, n) for n in (1, 2, 3, 4)} | {(k, n) for k in (1, 2) for n in (1, 2, 3, 4)} | {(3, 4)}
    # Endless paths round the loop come by 1, but not by 3 or 4.
    assert {(a, b) for _, a, b in rows(spark, "post_dominators", at)} == {(0, 1), (2, 1), (3, 4)}
    assert rows(spark, "postdominates_by_paths", at) == {(7, a, b) for a, b in ((0, 1), (0, 3), (0, 4), (1, 3), (1, 4), (3, 4), (2, 1), (2, 3), (2, 4))}
    assert {(r[1], r[2]) for r in rows(spark, "fuse_blocks", at)} == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3)}


def test_blocks_behind_equal_conditions(spark, tmp_path):
    # Two ifs in a row, 0 -> {1, 2} and 2 -> {3, 4}, on the same condition; a third one, 4 -> {5, 6}, on another. 1, 3 and 5 join the way.
    edges = [(7, 0, 1), (7, 0, 2), (7, 1, 2), (7, 2, 3), (7, 2, 4), (7, 3, 4), (7, 4, 5), (7, 4, 6), (7, 5, 6)]
    at = bring(tmp_path, {7: [(n, "Other", 1 if n in (0, 2) else 2, n) for n in range(7)]}, edges=edges)
    assert rows(spark, "both_blocks_happen", at) == {(7, 1, 3)}


@pytest.mark.parametrize(
    ("edges", "sccs"),
    [
        # The letters of two digraphs as numbers: a b c / b d / c d / d c; and a chain.
        ([(1, 2), (1, 3), (2, 4), (3, 4), (4, 3)], {(1, 1), (2, 2), (3, 3), (4, 3)}),
        ([(1, 2), (2, 3)], {(1, 1), (2, 2), (3, 3)}),
        ([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6)], {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}),
    ],
)
def test_components_of_small_digraphs(spark, tmp_path, edges, sccs):
    at = bring(tmp_path, {n: [(n, "Call", 0)] for n in {x for e in edges for x in e}}, calls=[(a, 100 * a + b, b, "Call") for a, b in edges])
    assert rows(spark, "digraph_sccs", at) == sccs
    assert rows(spark, "digraph_nodes", at) == {(n,) for e in edges for n in e}


def test_lost_cancel(spark, tmp_path):
    # A cancel function (a Lock here, by its fact) that one way out never calls.
    at = bring(
        tmp_path,
        {1: [(10, "Lock", 1, 0), (11, "Unlock", 1, 1), (12, "Other", 0, 2)], 2: [(20, "Lock", 1, 0), (21, "Unlock", 1, 0)]},
        edges=[(1, 0, 1), (1, 0, 2)],
    )
    assert rows(spark, "lint_lostcancel", at) == {(1, 10)}


def test_deferred_operations_are_of_another_mutex(spark, tmp_path):
    # A deferred unlock releases nothing where it stands, and a deferred lock takes nothing; a plain unlock does release. The
    # shorter of two chains is reported, and of equally short ones the smaller.
    at = bring(
        tmp_path,
        {
            1: [(10, "Lock", 1), (11, "defer Unlock", 1), (12, "Lock", 1), (13, "Lock", 2)],
            2: [(20, "Lock", 2), (21, "defer Unlock", 2), (22, "Lock", 1)],
            3: [(30, "defer Lock", 3), (31, "Lock", 3), (32, "Unlock", 3), (33, "Lock", 3), (34, "Call", 0), (35, "Call", 0)],
            4: [(40, "Call", 0)],
            5: [(50, "Call", 0)],
            6: [(60, "Lock", 3)],
        },
        calls=[(3, 34, 5, "Call"), (3, 35, 4, "Call"), (4, 40, 6, "Call"), (5, 50, 6, "Call")],
    )
    assert rows(spark, "live_locks_double", at) == {(1, 10, 12)}
    assert rows(spark, "live_locks_conflict", at) == {(1, 1, 2), (2, 2, 1)}
    assert rows(spark, "conflict_lock", at) == {(1, 2, 2)}
    assert rows(spark, "double_lock", at) == {(10, 12, 0, 1, "1"), (33, 60, 2, 1, "3>4>6")}
    assert {n for _, lock, _, n in rows(spark, "held_locks", at) if lock == 30} == set()
