"""Values computed alike and what values come from, against recursion in Python; patches of source lines and files."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest
from compare import BASE

from factweave.operators import patches, values
from factweave.sources import facts


def _alike(a: int, b: int, value: dict, args: dict) -> bool:
    (kind, type_, text), (kind2, type2, text2) = value[a], value[b]
    if a == b:
        return True
    if kind != kind2 or type_ != type2:
        return False
    if kind in ("Const", "Global"):
        return text == text2
    if kind not in ("BinOp", "Call", "UnOp", "FieldAddr") or len(args[a]) != len(args[b]):
        return False
    pairs = lambda xs, ys: all(_alike(x, y, value, args) for x, y in zip(xs, ys, strict=True))
    if kind == "BinOp" and {text, text2} in ({"<", ">"}, {"<=", ">="}):
        return pairs(args[a], args[b][::-1])
    if text != text2:
        return False
    return pairs(args[a], args[b]) or (kind == "BinOp" and text in ("==", "!=") and pairs(args[a], args[b][::-1]))


def test_values_alike_against_recursion(spark, tmp_path):
    rng = random.Random(2)
    value, args = {}, {}
    for n in range(260):
        kind = rng.choice(["Const", "Global", "Alloc"] if n < 12 else ["BinOp", "BinOp", "BinOp", "Call", "UnOp", "FieldAddr", "Phi"])
        text = {"Const": rng.choice("01"), "Global": "G", "BinOp": rng.choice(["==", "!=", "<", ">", "<=", ">=", "+"]), "Call": "f", "UnOp": "*", "FieldAddr": rng.choice("ab")}.get(kind, f"v{n}")
        value[n] = (kind, "t" if n % 9 else "u", text)
        n_args = {"BinOp": 2, "Call": rng.randrange(1, 3), "UnOp": 1, "FieldAddr": 1, "Phi": 2}.get(kind, 0)
        args[n] = [rng.randrange(min(n, 12 + n // 8)) for _ in range(n_args)]
    value[900] = value[901] = ("UnOp", "t", "*")  # a cycle: each stands alone
    args[900], args[901] = [901], [900]
    value[902], args[902] = ("Call", "t", "f"), []  # no operands at all: alone too
    pd.DataFrame([(n, 1, n, *v) for n, v in value.items()], columns=["value_id", "fn_id", "idx", "kind", "type", "text"]).to_parquet(tmp_path / "value.parquet")
    pd.DataFrame([(n, k, a) for n, xs in args.items() for k, a in enumerate(xs)], columns=["value_id", "pos", "arg_id"]).to_parquet(tmp_path / "operand.parquet")
    got = dict(tuple(r) for r in values.value_equal_limited(spark, str(tmp_path)).collect())
    acyclic = [n for n in value if n < 900]
    want = {n: min(m for m in acyclic if _alike(n, m, value, args)) for n in acyclic} | {n: n for n in (900, 901, 902)}
    assert got == want
    assert len(set(want.values())) < len(want) - 15
    edges = {n: xs if value[n][0] == "Phi" else xs[:1] for n, xs in args.items() if value[n][0] in ("UnOp", "FieldAddr", "Phi") and n < 900}

    def ends(n: int) -> set:
        return set().union(*(ends(a) for a in edges[n])) if n in edges else {n}

    found = {tuple(r) for r in values.find_primitive(spark, str(tmp_path)).where("value_id < 900").collect()}
    assert found == {(n, e, value[e][0]) for n in edges for e in ends(n) if value[e][0] in ("Alloc", "Global")}
    bases = {tuple(r) for r in values.get_base_type(spark, str(tmp_path)).where("value_id < 900").collect()}
    chain = lambda n: chain(args[n][0]) if value[n][0] in ("UnOp", "FieldAddr") else n
    assert bases == {(n, chain(n), value[chain(n)][1]) for n in edges if value[n][0] != "Phi"}


def test_test_facts_have_values_alike(sf_dir):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    n, classes = con.sql(f"SELECT count(*), count(DISTINCT class_id) FROM ({values.SQL['value_equal_limited']})").fetchall()[0]
    assert 0 < classes < n
    assert con.sql(facts.duck_sql("SELECT count(*) FROM {operand}")).fetchall()[0][0] > 0


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("\tdone := make(chan struct{})", "\tdone := make(chan struct{}, 1)"),
        ("ch := make(chan int, 3)", "ch := make(chan int, 3)"),
        ("x := make()", "x := make()"),
        ("x := make( )", "x := make( )"),
        ("a, b := make(chan int), make(chan map[string](func(int, int) bool))", "a, b := make(chan int), make(chan map[string](func(int, int) bool), 1)"),
        ('f("make(chan int)", make(chan string)) // make(chan int)', 'f("make(chan int)", make(chan string, 1)) // make(chan int)'),
        ("// make(chan int)", "// make(chan int)"),
        ("remake(chan int)", "remake(chan int)"),
        ("x := make (chan int)", "x := make (chan int, 1)"),
        ("x := make(f(make(chan int)))", "x := make(f(make(chan int, 1)))"),
        ("x := make(chan int", "x := make(chan int"),
        ("", ""),
    ],
)
def test_buffer_of_one(line, want):
    assert patches.with_buffer(line) == want


def test_patched_files(spark, tmp_path):
    go = {
        1: ["package main", "", "func gl1_before() {", "\tdone := make(chan struct{})", "\tgo func() {", "\t\tdone <- struct{}{}", "\t}()", "\t<-done", "}"],
        2: ["func f() {", "\tch := make(chan int)", "\tgo func() { <-ch }()", "\tif leave { return }", "\tch <- 1", "}"],
        3: ["func f() {", "\tch := make(chan int)", "\tgo func() {", "\t\tch <- 1", "\t}()", "}"],
        4: ["as it is"],
    }
    pd.DataFrame([(f, n, 0, t) for f, ls in go.items() for n, t in enumerate(ls, 1)], columns=["file", "line", "form", "text"]).to_parquet(tmp_path / "go_line.parquet")
    pd.DataFrame([(1, 1, 4, 4), (2, 2, 2, 5), (3, 3, 2, 4)], columns=["file", "strategy", "make_line", "op_line"]).to_parquet(tmp_path / "fix.parquet")
    folder = str(tmp_path)
    assert [tuple(r) for r in patches.patch_1(spark, folder).collect()] == [(1, 4, "\tdone := make(chan struct{}, 1)")]
    whole = {r["file"]: r["text"].split("\n") for r in patches.patched_files(spark, folder).collect()}
    assert whole[1] == [*go[1][:3], "\tdone := make(chan struct{}, 1)", *go[1][4:]]
    assert whole[2] == [*go[2][:2], "defer func() { ch <- 1 }()", *go[2][2:4], "}"]
    assert whole[3] == [*go[3][:2], "stop := make(chan struct{})", "defer close(stop)", go[3][2], "select { case <-stop: return; case ch <- 1: }", *go[3][4:]]
    assert whole[4] == go[4]
    patches.write_files(patches.patched_files(spark, folder), f"{folder}/out")
    back = spark.read.text(f"{folder}/out/file=2", wholetext=True).collect()
    assert back[0]["value"].rstrip("\n").split("\n") == whole[2]
