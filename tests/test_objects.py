"""Layout of nested types and queries by access path, on a small program with known rows."""

from __future__ import annotations

import pandas as pd
import pytest

from factweave.operators import objects

TYPES = {
    1: ("basic", None, None), 2: ("pointer", 1, None), 3: ("struct", None, None), 4: ("pointer", 3, None), 5: ("array", 3, None), 6: ("slice", 3, None),
    7: ("map", 4, 3), 8: ("chan", 4, None), 9: ("tuple", None, None), 10: ("struct", None, None), 11: ("pointer", 10, None), 12: ("tuple", None, None),
}
PARTS = [(3, "p", 2), (3, "n", 1), (3, "q", 2), (9, "", 1), (9, "", 4), (10, "inner", 3), (10, "xs", 6), (10, "ch", 8), (12, "", 3)]
# 2000: struct 10; 4000: array of struct 3; 5000: what a channel holds; 6000: struct 3; 7000: a map's key and value
POINTS = [(1000, 2000), (2004, 3000), (2005, 4000), (4002, 3001), (2006, 5000), (5000, 6000), (6001, 3002), (1100, 7000), (7004, 6000), (1201, 6000)]
ASKED = [
    ("x.inner.q", 1000, 11, "load,field 0,field 2", None, {3000}),
    ("x.xs[9].p", 1000, 11, "load,field 1,sliceelem,field 0", None, {3001}),
    ("(<-x.ch).p", 1000, 11, "load,field 2,recv,load,field 0", None, {3002}),
    ("<-x.ch", 1000, 11, "load,field 2,recv", None, {6000}),
    (" ( * x ) . xs ", 1000, 11, "load,field 1", None, {4000}),
    ("*x", 1000, 11, "load", "not pointer-like", set()),
    ("x", 1000, 11, "", None, {2000, 2008}),
    ("x[k[0]].p", 1100, 7, "mapelem,load,field 0", None, {3002}),
    ("x[01].p", 1200, 9, "index 1,load,field 0", None, {3002}),
    ("x[2]", 1200, 9, "", "the type allows no [", set()),
    ("x[i]", 1200, 9, "", "the type allows no [", set()),
    ("x.inner.none", 1000, 11, "load,field 0", "the type allows no .", set()),
    ("<-x", 1000, 11, "", "the type allows no <-", set()),
    ("x..p", 1000, 11, "", "not an access path", set()),
    ("x[]", 1100, 7, "", "not an access path", set()),
    ("xs.p", 1000, 11, "", "operand must be named x", set()),
    ("y", 1000, 11, "", "operand must be named x", set()),
    (None, 1000, 11, "", "operand must be named x", set()),
]


def _write(folder, parts=PARTS) -> str:
    at: dict = {}
    rows = [(t, at.setdefault(t, []).append(0) or len(at[t]) - 1, name, part) for t, name, part in parts]
    whole = lambda data, columns: pd.DataFrame(data, columns=columns).astype({c: "Int64" for c in columns if c not in ("kind", "name", "query")})
    whole([(t, *k) for t, k in TYPES.items()], ["type_id", "kind", "elem", "key"]).to_parquet(folder / "obj_typedef.parquet")
    whole(rows, ["type_id", "pos", "name", "part_type"]).to_parquet(folder / "obj_part.parquet")
    whole([*POINTS, (999, 2008)], ["node", "label"]).to_parquet(folder / "cell_addr.parquet")
    whole([(999, 998), (998, 1000), (1000, 999)], ["src", "dst"]).to_parquet(folder / "cell_copy.parquet")
    whole([(n, node, t, text) for n, (text, node, t, *_) in enumerate(ASKED)], ["query_id", "node", "type_id", "query"]).to_parquet(folder / "path_query.parquet")
    return str(folder)


def test_layout_of_nested_types(spark, tmp_path):
    got: dict = {}
    for r in objects.pta_layout(spark, _write(tmp_path)).orderBy("type_id", "pos").collect():
        got.setdefault(r.type_id, []).append((r.path, r.leaf_type))
    assert got[3] == [("", 3), (".p", 2), (".n", 1), (".q", 2)]
    assert got[5] == [("", 5), ("[*]", 3), ("[*].p", 2), ("[*].n", 1), ("[*].q", 2)]
    assert got[9] == [("#0", 1), ("#1", 4)]
    assert got[10] == [("", 10), (".inner", 3), (".inner.p", 2), (".inner.n", 1), (".inner.q", 2), (".xs", 6), (".ch", 8)]
    assert got[12] == got[3]
    assert all(got[t] == [("", t)] for t in (1, 2, 4, 6, 7, 8, 11))


def test_access_paths(spark, tmp_path):
    folder = _write(tmp_path)
    ops = {r.query_id: (r.ops, r.error) for r in objects.pta_query_ops(spark, folder).collect()}
    assert ops == {n: (want, error) for n, (_, _, _, want, error, _) in enumerate(ASKED)}
    got: dict = {n: set() for n in range(len(ASKED))}
    rows = objects.pta_extended_query(spark, folder).collect()
    for n, label in rows:
        got[n].add(label)
    want = {n: labels for n, (*_, labels) in enumerate(ASKED)}
    assert got == want
    assert len(rows) == len(set(rows))


def test_a_type_that_holds_itself_is_an_error(spark, tmp_path):
    with pytest.raises(RuntimeError, match="nested deeper"):
        objects.pta_layout(spark, _write(tmp_path, [*PARTS, (3, "self", 10)]), max_depth=6)
