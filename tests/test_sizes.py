"""What grows with the rounds of a loop and with the number of pairs, on small inputs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from test_programs import bring

from factweave.operators import callgraph, chains, fixpoint, locks, program


def test_estimates_do_not_multiply_over_rounds(spark):
    edges = fixpoint.keep(spark.range(50).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    now = fixpoint.keep(edges.select(F.col("dst").alias("node")))
    for _ in range(6):
        other = now.select(F.col("node").alias("o_node"))
        now = fixpoint.keep(now.join(edges, F.col("node") == F.col("src")).join(other, F.col("dst") == F.col("o_node")).select(F.col("dst").alias("node")))
    size = int(now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    print("bits", size.bit_length())
    assert size < 1 << 40
    assert {r[0] for r in now.collect()} == set(range(7, 51))


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_do_not_broadcast_edges_or_what_is_known(spark, monkeypatch):
    plans, kept = [], fixpoint.keep
    monkeypatch.setattr(fixpoint, "keep", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    edges = spark.range(12).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    start = spark.createDataFrame([(0, 0)], "root long, node long")
    assert {r["node"] for r in fixpoint.reach(start, edges).collect()} == set(range(13))
    rounds = [p for p in plans if "LeftAnti" in p]
    assert rounds and not any("BroadcastHashJoin" in p for p in rounds)


def test_types_and_interfaces_meet_by_classes(spark, tmp_path):
    own = [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (4, 1), (None, 1), (None, 2), (5, None), (5, 1)]
    need = [(7, 1), (8, 1), (8, 2), (9, 4), (10, 1), (10, None), (None, 1)]
    for name, rows in (("method_set", own), ("method_need", need)):
        pd.DataFrame(rows, columns=["fn_id", "prim"], dtype="Int64").to_parquet(tmp_path / f"{name}.parquet")
    found = program.guru_implements(spark, str(tmp_path))
    assert "Aggregate" not in _plan(found)  # pairs are written as they are found
    assert {tuple(r) for r in found.collect()} == {(t, 7) for t in (1, 2, 4, 5, None)} | {(t, 8) for t in (1, 2, None)}


def test_lowest_callers_of_one_two_and_more_users(spark):
    reach = [(f, f, 0) for f in range(1, 8)] + [(1, 2, 1), (1, 3, 1), (1, 4, 1), (5, 2, 1), (5, 3, 1), (6, 5, 1), (6, 2, 2), (6, 3, 2), (7, 4, 1)]
    users = [(0, 2), (1, 2), (1, 3), (2, 2), (2, 3), (2, 4), (3, 2), (3, 7), (4, 2), (4, None)]
    got = chains._lowest(spark.createDataFrame(users, "ch long, fn_id long"), spark.createDataFrame(reach, "caller long, fn long, depth int"))
    assert {tuple(r) for r in got.collect()} == {(0, 2), (1, 1), (1, 5), (2, 1)}


def test_rapid_types_take_few_rounds(spark, tmp_path, monkeypatch):
    """A chain of 40 calls, then a method that a type made at the end reaches."""
    n = 40
    pd.DataFrame([(k, k, k + 1, "Call") for k in range(n)], columns=["caller", "site", "callee", "site_kind"]).to_parquet(tmp_path / "call_edge.parquet")
    pd.DataFrame([(n, 500)], columns=["node", "label"]).to_parquet(tmp_path / "obj_addr.parquet")
    pd.DataFrame([(500, 9)], columns=["label", "type_id"]).to_parquet(tmp_path / "obj_type.parquet")
    pd.DataFrame([(3, "s", 3, 1, 3)], columns=["caller", "site", "recv", "method", "arg"]).to_parquet(tmp_path / "obj_invoke.parquet")
    pd.DataFrame([(9, 1, 70, 71, 72), (8, 1, 80, 81, 82)], columns=["type_id", "method", "fn_id", "recv_node", "param_node"]).to_parquet(tmp_path / "method_impl.parquet")
    calls, kept = [], fixpoint.keep
    for module in (fixpoint, callgraph):
        monkeypatch.setattr(module, "keep", lambda df: calls.append(1) or kept(df))
    assert {tuple(r) for r in callgraph.cg_rta(spark, str(tmp_path)).collect()} == {(k, k + 1) for k in range(n)} | {(3, 70)}
    assert len(calls) < 40


def test_components_of_a_long_ring_take_few_jobs(spark, monkeypatch):
    """A ring of 100 calls that enters a ring of 3, and a function that calls itself."""
    ring = [(k, (k + 1) % 100) for k in range(100)] + [(50, 200), (200, 201), (201, 202), (202, 200), (300, 300), (None, 1)]
    calls, kept = [], fixpoint.keep
    for module in (fixpoint, program):
        monkeypatch.setattr(module, "keep", lambda df: calls.append(1) or kept(df))
    found = program.components(spark.createDataFrame(ring, "src long, dst long"))
    assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(100)} | {(k, 200) for k in (200, 201, 202)} | {(300, 300)}
    assert len(calls) < 40


def test_rounds_of_points_to_hold_only_nodes_that_go_on(spark, tmp_path, monkeypatch):
    """1 and 2 copy to each other and to 50 ends; one end and a node apart have objects of their own, node 3 has none."""
    copies = [(1, 2), (2, 1), (3, 1)] + [(k % 2 + 1, 100 + k) for k in range(50)]
    pd.DataFrame(copies, columns=["src", "dst"]).to_parquet(tmp_path / "obj_copy.parquet")
    pd.DataFrame([(1, 7), (2, 8), (100, 9), (900, 9)], columns=["node", "label"]).to_parquet(tmp_path / "obj_addr.parquet")
    rounds, solve = [], fixpoint.semi_naive
    monkeypatch.setattr(program, "semi_naive", lambda *a, **k: rounds.append(solve(*a, **k)) or rounds[-1])
    want = {(n, x) for n in (1, 2, *range(100, 150)) for x in (7, 8)} | {(100, 9), (900, 9)}
    assert sorted(tuple(r) for r in program.points_to(spark, str(tmp_path)).collect()) == sorted(want)
    assert {r["node"] for r in rounds[0].collect()} == {1, 2}


def test_contexts_of_a_function_do_not_meet_in_pairs(spark, sf_dir, monkeypatch):
    plans, kept = [], fixpoint.keep
    monkeypatch.setattr(callgraph, "keep", lambda df: plans.append(_plan(df)) or kept(df))
    callgraph.points_to_context(spark, sf_dir)
    arcs = [line for p in plans for line in p.splitlines() if "Join" in line and "s_ctx" in line and "d_ctx" in line]
    assert arcs and not any(" OR " in line for line in arcs)


def test_pairs_of_locks_are_not_shuffled_to_be_told_apart(spark, sf_dir):
    found = locks.interprocedural_double_lock(spark, sf_dir)
    assert "Aggregate" not in _plan(found)  # a context and a lock of its function meet once
    assert found.count() == found.distinct().count() > 0


def test_contexts_of_pairs_of_locks_are_as_many_as_locks_and_functions(spark, tmp_path, monkeypatch):
    """Function 0 takes a lock at 30 places and then calls down a chain: its seventh call takes lock 2, its eighth lock 3."""
    chain = {k: [(100 + k, "Call", 0)] for k in range(1, 7)} | {7: [(107, "Lock", 2), (207, "Call", 0)], 8: [(108, "Lock", 3)]}
    functions = {0: [(k, "Lock", 1) for k in range(30)] + [(100, "Call", 0)], 20: [(301, "Lock", 2), (302, "Lock", 1)], 21: [(303, "Lock", 3), (304, "Lock", 1)]} | chain
    calls = [(k, 100 + k, k + 1, "Call") for k in range(7)] + [(7, 207, 8, "Call")]
    at, rows, kept = bring(tmp_path, functions, calls=calls), [], fixpoint.keep
    for module in (fixpoint, locks):
        monkeypatch.setattr(module, "keep", lambda df: rows.append(kept(df)) or rows[-1])
    assert {tuple(r) for r in locks.conflict_lock(spark, at).collect()} == {(1, 2, 2)}
    assert all(r.count() < 30 for r in rows if "fn" in r.columns and "prim" in r.columns)


def test_rounds_of_points_to_full_hold_sets_in_blocks(spark, tmp_path, monkeypatch):
    """Node 1 points to 400 objects about zero; a copy, a store through 5, a load and an offset pass them on; no label of node 6 is known."""
    none = {"obj_filter": ["src", "type_id", "dst"], "obj_untag": ["src", "type_id", "dst"], "obj_type": ["label", "type_id"], "obj_invoke": ["caller", "site", "recv", "method", "arg"], "method_impl": ["type_id", "method", "fn_id", "recv_node", "param_node"]}
    for name, columns in none.items():
        pd.DataFrame([], columns=columns, dtype="int64").to_parquet(tmp_path / f"{name}.parquet")
    labels = range(-200, 200)
    for name, columns, rows in (
        ("obj_addr", ["node", "label"], [(1, x) for x in labels] + [(5, 900), (6, None), (None, 3)]),
        ("obj_copy", ["src", "dst"], [(1, 2), (2, 3), (3, 2), (6, 7)]),
        ("obj_store", ["src", "dst"], [(3, 5)]),
        ("obj_load", ["src", "dst"], [(5, 4)]),
        ("obj_offset", ["src", "off", "dst"], [(4, 1, 8)]),
        ("obj_field", ["label", "off", "sub"], [(x, 1, x + 1000) for x in labels] + [(0, 2, 1)]),
    ):
        pd.DataFrame(rows, columns=columns, dtype="Int64").to_parquet(tmp_path / f"{name}.parquet")
    rows, kept = [], fixpoint.keep
    monkeypatch.setattr(program, "keep", lambda df: rows.append(kept(df)) or rows[-1])
    got = [tuple(r) for r in program.points_to_full(spark, str(tmp_path)).collect()]
    want = {(n, x) for n in (1, 2, 3, 4, -901) for x in labels} | {(8, x + 1000) for x in labels} | {(5, 900), (6, None), (7, None), (None, 3)}
    assert len(got) == len(want) and set(got) == want
    assert all(r.count() < 100 for r in rows if "node" in r.columns)
