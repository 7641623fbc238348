"""Deferred closures, tests ended in nested goroutines, and two lint passes, on small programs with known rows."""

from __future__ import annotations

import pandas as pd

from factweave.operators import closures, lint


def _table(folder, name: str, columns: str, rows: list[tuple]) -> None:
    pd.DataFrame(rows, columns=columns.split()).to_parquet(folder / f"{name}.parquet")


def _insts(folder, rows: list[tuple]) -> None:
    whole = [(n, fn, idx, bb, idx % 4, op, prim, "f.go", idx, late) for n, fn, idx, bb, op, prim, late in rows]
    _table(folder, "inst", "inst_id fn_id idx bb_id pos op prim file line is_defer", whole)


def test_unlocks_in_deferred_closures(spark, tmp_path):
    _insts(
        tmp_path,
        [
            (10, 1, 0, 0, "Call", 0, True),  # defer func() { m7.Unlock(); defer m9.Unlock() }()
            (11, 1, 1, 0, "Lock", 7, False),
            (12, 1, 2, 0, "Unlock", 3, True),
            (13, 1, 3, 1, "Lock", 3, False),
            (14, 1, 4, 1, "Unlock", 4, True),  # in the loop of block 1: not seen by the lock before it
            (15, 1, 5, 2, "Call", 0, True),  # no closure
            (16, 1, 6, 3, "Lock", 5, False),  # block 3 is not reached from block 2
            (20, 2, 0, 0, "Unlock", 7, False),
            (21, 2, 1, 0, "Unlock", 9, True),
            (30, 3, 0, 0, "Lock", 1, False),
        ],
    )
    _table(tmp_path, "bb_edge", "fn_id src_bb dst_bb", [(1, 0, 1), (1, 1, 1), (1, 1, 2), (1, 0, 3)])
    _table(tmp_path, "defer_closure", "site closure_fn", [(10, 2)])
    got = {tuple(r) for r in closures.released_later(spark, str(tmp_path)).collect()}
    assert got == {(11, 7), (13, 7), (13, 3), (16, 7), (16, 3)}


def test_tests_ended_in_goroutines(spark, tmp_path):
    ops = [(100, 3, "(*testing.common).Fatal"), (101, 4, "(*testing.T).SkipNow"), (102, 4, "(*log.Logger).Fatal"), (103, 5, "(*testing.common).Fatalf"), (104, 6, "(*testing.common).Error"), (105, 7, "(*testing.common).FailNow")]
    late = [(106, 3, "(*testing.common).Fatal")]
    rows = [(n, fn, 0, 0, False, callee, 0) for n, fn, callee in ops] + [(n, fn, 1, 0, True, callee, 0) for n, fn, callee in late]
    _table(tmp_path, "sync_op", "inst_id fn_id idx bb_id is_defer callee value_id", rows)
    _table(tmp_path, "fn_parent", "fn_id parent_fn", [(2, 1), (3, 2), (4, 3), (6, 1)])
    _table(tmp_path, "fn_text", "fn_id name text", [(1, "TestA", "p.TestA"), (2, "TestA$1", "p.TestA$1"), (3, "TestA$1$1", "p.TestA$1$1"), (5, "helper", "p.helper"), (7, "TestAll", "q.TestAll")])
    _table(tmp_path, "go_target", "site fn_id target how", [(50, 1, 2, "closure"), (51, 1, 5, "dynamic"), (52, 1, 5, "static"), (53, 1, 6, "closure"), (54, 1, 7, "dynamic"), (55, 1, 3, "dynamic")])
    got = sorted(tuple(r) for r in closures.api_fatal(spark, str(tmp_path)).collect())
    assert got == [(50, 1, 100), (50, 1, 101), (52, 1, 103), (54, 1, 105), (55, 1, 100), (55, 1, 101)]


def test_lint_of_assertions_and_responses(spark, tmp_path):
    _table(tmp_path, "iface_method", "type_id name signature", [(1, "Read", "()"), (1, "Close", "() error"), (2, "Read", "([]byte) (int, error)"), (2, "Close", "()"), (3, "Close", "() error"), (4, "Len", "() int")])
    _table(tmp_path, "iface_assert", "site pos v_type t_type", [(1, 0, 1, 2), (1, 1, 1, 3), (2, 0, 1, 4), (3, 0, 3, 2), (4, 0, 9, 2), (5, 0, 1, 2)])
    got = sorted(tuple(r) for r in lint.lint_ifaceassert(spark, str(tmp_path)).collect())
    assert got == [(1, 0, 1, 2, "Close"), (3, 0, 3, 2, "Close"), (5, 0, 1, 2, "Close")]
    both = "(*net/http.Response, error)"
    stmts = [
        (1, 1, 0, 0, "assign", "http", both, "res"), (2, 1, 0, 1, "defer", "other", "", "res"),
        (3, 1, 1, 0, "assign", "*net/http.Client", both, "res"), (4, 1, 1, 1, "other", "other", "", None), (5, 1, 1, 2, "defer", "other", "", "res"),
        (6, 1, 2, 0, "assign", "net/http.Client", both, "a"), (7, 1, 2, 1, "defer", "other", "", "b"),
        (8, 1, 3, 0, "assign", "other", both, "res"), (9, 1, 3, 1, "defer", "other", "", "res"),
        (10, 1, 4, 0, "assign", "http", "(*net/http.Response)", "res"), (11, 1, 4, 1, "defer", "other", "", "res"),
        (12, 1, 5, 0, "assign", "http", both, None), (13, 1, 5, 1, "defer", "other", "", None),
        (14, 2, 0, 0, "assign", "*net/http.Client", both, "r"), (15, 2, 0, 1, "defer", "other", "", "r"),
    ]
    _table(tmp_path, "http_stmt", "stmt_id fn_id bb_id pos kind called_on results root", stmts)
    assert sorted(tuple(r) for r in lint.lint_httpresponse(spark, str(tmp_path)).collect()) == [(1, "res"), (14, "r")]
