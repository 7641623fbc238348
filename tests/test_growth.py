"""What a query holds or writes as its tables grow, on small inputs."""

from __future__ import annotations

import os

import pandas as pd
from test_programs import bring

from factweave.operators import cfg, chains, fixpoint, program


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_order_of_operations_needs_no_pairs_with_reachable_blocks(spark, tmp_path):
    """Reachable blocks, joined with pairs of operations, were taken for small (by the size of a kept file) and broadcast."""
    functions = {1: [(10, "Send", 1, 0), (11, "Recv", 1, 0), (12, "defer Send", 1, 0), (13, "defer Recv", 1, 2), (14, "Send", 1, 2), (15, "Send", 2, 2), (16, "Send", None, 2), (17, "Lock", 1, 2)], 2: [(2, "Send", 1, 0), (0, "Send", 1, 2)]}
    at = bring(tmp_path, functions, edges=[(1, 0, 1), (1, 1, 2), (2, 2, 0)])  # block 1 has no instruction
    found = cfg.happens_before_intra(spark, at)
    assert "Join" not in _plan(found)
    want = {(1, 10, 11), (1, 10, 14), (1, 11, 14), (1, 13, 12), (2, 0, 2)} | {(1, a, b) for a in (10, 11, 14) for b in (12, 13)}
    assert {tuple(r) for r in found.collect()} == want


def test_callers_of_a_sole_user_are_not_held_against_each_other(spark, monkeypatch):
    """Channel 0 has one user, 0, with 200 callers that call each other in a line; 300 calls it and is called by it; 0 and 1 use channel 1."""
    line = [(k, j, k - j) for k in range(201) for j in range(max(0, k - 7), k + 1)] + [(0, 300, 1), (300, 0, 1), (300, 300, 0)] + [(k, 0, 7) for k in range(8, 201)]
    reach, kept, rows = spark.createDataFrame(line, "caller long, fn long, depth int"), fixpoint.keep, []
    monkeypatch.setattr(chains, "keep", lambda df: rows.append(kept(df)) or rows[-1])
    got = chains._lowest(spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "ch long, fn_id long"), reach)
    assert {tuple(r) for r in got.collect()} == {(0, 0), (0, 300), (1, 1)}
    assert all(r.count() < 20 for r in rows)


def _constraints(path, **rows: list[tuple]) -> str:
    """All constraint facts of a program, empty where none are given."""
    columns = {"obj_addr": "node label", "obj_copy": "src dst", "obj_load": "src dst", "obj_store": "src dst", "obj_offset": "src off dst", "obj_field": "label off sub", "obj_filter": "src type_id dst", "obj_untag": "src type_id dst", "obj_type": "label type_id"}
    columns |= {"obj_invoke": "caller site recv method arg", "method_impl": "type_id method fn_id recv_node param_node"}
    for name, names in columns.items():
        pd.DataFrame(rows.get(name, []), columns=names.split(), dtype="int64").to_parquet(path / f"{name}.parquet")
    return str(path)


def test_points_to_follows_loads_stores_and_calls(spark, tmp_path):
    """*1 = 2 and 3 = *1, where 1 points to 7 and 2 to 8; 3 is copied to 4, on which a method is called with 2."""
    at = _constraints(tmp_path, obj_addr=[(1, 7), (2, 8)], obj_store=[(2, 1)], obj_load=[(1, 3)], obj_copy=[(3, 4)], obj_type=[(8, 5)], obj_invoke=[(1, 1, 4, 0, 2)], method_impl=[(5, 0, 9, 90, 91)])
    want = {(1, 7), (2, 8), (-8, 8), (3, 8), (4, 8), (90, 8), (91, 8)}
    assert {tuple(r) for r in program.points_to(spark, at).collect()} == want


def test_rounds_of_points_to_full_leave_no_files(spark, tmp_path, monkeypatch):
    """A line of 5 copies takes as many rounds; what they wrote is gone when the next has taken it in, but for edges."""
    at = _constraints(tmp_path, obj_addr=[(0, 7)], obj_copy=[(k, k + 1) for k in range(5)])
    paths = []

    def kept(df):
        out = fixpoint.keep(df)
        paths.append((out.columns, out.inputFiles()[0].removeprefix("file:") if out.inputFiles() else ""))
        return out

    monkeypatch.setattr(program, "keep", kept)
    assert {tuple(r) for r in program.points_to_full(spark, at).collect()} == {(k, 7) for k in range(6)}
    sets = [path for columns, path in paths if "block" in columns and "k_block" not in columns and path]
    assert len(sets) > 16 and sum(os.path.exists(path) for path in sets) < 6
