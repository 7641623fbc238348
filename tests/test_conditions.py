"""Path conditions: decided as by trying values, and small programs of locks under conditions."""

from __future__ import annotations

from itertools import product

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.operators import conditions

HOLDS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
CONDS = st.lists(st.tuples(st.sampled_from(["a", "b", "c", "1"]), st.sampled_from(sorted(HOLDS)), st.sampled_from(["a", "b", "c", "0", "2", "-1"]), st.booleans()), max_size=6).map(tuple)


def _tried(conds) -> bool:
    # Bounds between three names and constants from -1 to 2 leave a solution within eight of zero if they leave any.
    for values in product(range(-8, 9), repeat=3):
        at = dict(zip("abc", values, strict=True))
        value = lambda t, at=at: at[t] if t in at else int(t)
        if all(HOLDS[op](value(x), value(y)) == flag for x, op, y, flag in conds):
            return True
    return False


@settings(max_examples=150, deadline=None)
@given(CONDS)
def test_satisfiable_as_by_trying_values(conds):
    assert conditions.satisfiable(conds) == _tried(conds)


@settings(max_examples=60, deadline=None)
@given(CONDS, CONDS)
def test_implication_as_by_trying_values(first, then):
    assert conditions.implies(first, then[:2]) == (not any(_tried((*first, (x, op, y, not flag))) for x, op, y, flag in then[:2]))


def _program(folder, functions: dict, edges: dict, branches: list[tuple]) -> str:
    """functions: number to (operation, lock, block, deferred) in turn; branches: (fn, block, yes, no, x, operator, y)."""
    insts = [(100 * fn + i, fn, i, bb, op, prim, late, "f.go", 1) for fn, body in functions.items() for i, (op, prim, bb, late) in enumerate(body)]
    pd.DataFrame(insts, columns=["inst_id", "fn_id", "idx", "bb_id", "op", "prim", "is_defer", "file", "line"]).to_parquet(folder / "inst.parquet")
    pd.DataFrame([(fn, a, b) for fn, es in edges.items() for a, b in es], columns=["fn_id", "src_bb", "dst_bb"]).astype("int64").to_parquet(folder / "bb_edge.parquet")
    pd.DataFrame(branches, columns=["fn_id", "bb_id", "true_bb", "false_bb", "x", "op", "y"]).to_parquet(folder / "branch.parquet")
    return str(folder)


def test_forgotten_unlocks(spark, tmp_path):
    on = lambda op, bb, late=False: (op, 7, bb, late)
    functions = {
        1: [on("Lock", 0), on("Ret", 0)],  # locks and returns
        2: [on("Lock", 0), on("Unlock", 0, True), on("Ret", 0)],  # a deferred unlock
        3: [on("Lock", 0)],  # the lock is the last thing done
        # i < 10 and j > 3: lock; later, under the same conditions, unlock
        4: [on("If", 0), on("If", 1), on("Lock", 2), on("If", 3), on("If", 4), on("Unlock", 5), on("Ret", 6)],
        # the unlock stands under j > 4 instead
        5: [on("If", 0), on("If", 1), on("Lock", 2), on("If", 3), on("If", 4), on("Unlock", 5), on("Ret", 6)],
        # the lock stands under conditions that contradict each other
        6: [on("If", 0), on("If", 1), on("Lock", 2), on("If", 3), on("If", 4), on("Other", 5), on("Ret", 6)],
        # as 4, but the lock's conditions are tested in a loop, so they state nothing later
        7: [on("If", 0), on("If", 1), on("Lock", 2), on("If", 3), on("If", 4), on("Unlock", 5), on("Ret", 6)],
    }
    shape = [(0, 1), (0, 3), (1, 2), (1, 3), (2, 3), (3, 4), (3, 6), (4, 5), (4, 6), (5, 6)]
    edges = {4: shape, 5: shape, 6: shape, 7: [*shape, (3, 0)]}
    tests = {4: ("i < 10", "*(j) > 3", "i < 10", "*(j) > 3"), 5: ("i < 10", "*(j) > 3", "i < 10", "*(j) > 4"), 6: ("i < 10", "i >= 10", "k < 0", "k < 0"), 7: ("i < 10", "*(j) > 3", "i < 10", "*(j) > 3")}
    branches = []
    for fn, texts in tests.items():
        for bb, text, (yes, no) in zip((0, 1, 3, 4), texts, ((1, 3), (2, 3), (4, 6), (5, 6)), strict=True):
            branches.append((fn, bb, yes, no, *text.split()))
    folder = _program(tmp_path, functions, edges, branches)
    got = {(r["fn_id"], r["lock_id"]) for r in conditions.forget_unlock(spark, folder).collect()}
    assert got == {(1, 100), (3, 300), (5, 502), (7, 702)}
    keys = {(r["fn_id"], r["bb_id"]): r["path_key"] for r in conditions.path_condition_key(spark, folder).collect()}
    assert keys[4, 2] == "(*(j) > 3) && (i < 10)" and (4, 3) not in keys and (7, 2) not in keys and (4, 6) not in keys
    smt = {(r["fn_id"], r["bb_id"]): r["smt"] for r in conditions.sink_smt2_text(spark, folder).collect()}
    assert smt[6, 2] == (
        "(declare-const i Int)(declare-const c0 Bool)(assert (= c0 (< i 10)))(declare-const c1 Bool)(assert (= c1 (>= i 10)))"
        "(declare-const Final Bool)(assert (= Final (and true c0 c1)))(assert Final)(check-sat)"
    )
    implied = {r["fn_id"]: (r["lcd"], r["pre2"]) for r in conditions.bb_precondition_smt(spark, folder).collect()}
    assert implied[4] == (0, "(and true (< i 10) (> *(j) 3))")
    decided = {r["fn_id"]: r["implied"] for r in conditions.smt_implication_of_union(spark, folder).collect()}
    assert decided == {4: True, 5: False, 7: False}
