"""Call chains of a small program, and lowest common callers by their definition."""

from __future__ import annotations

import pandas as pd

from factweave.operators import chains


def _folder(tmp_path, calls: list[tuple], uses: list[tuple]) -> str:
    pd.DataFrame(calls, columns=["caller", "site", "callee", "site_kind"]).to_parquet(tmp_path / "call_edge.parquet")
    pd.DataFrame(uses, columns=["inst_id", "fn_id", "op", "prim"]).to_parquet(tmp_path / "chan_use.parquet")
    return str(tmp_path)


def test_lowest_common_caller_with_its_chains(spark, tmp_path):
    # 1 calls 2, 2 calls 3 (twice) and starts 4, 4 calls 3 too; 3 sends and 4 receives on channel 0. 5 uses channel 1 alone. 6 and 7
    # call each other and both call 8 and 9, which use channel 2: neither of the two is lower. 10 and 11 share no caller.
    calls = [(1, 1, 2, "Call"), (2, 2, 3, "Call"), (2, 3, 3, "Go"), (2, 4, 4, "Go"), (4, 5, 3, "Call")]
    calls += [(6, 6, 7, "Call"), (7, 7, 6, "Call"), (6, 8, 8, "Call"), (6, 9, 9, "Call"), (7, 10, 8, "Call"), (7, 11, 9, "Call")]
    uses = [(100, 3, "Send", 0), (101, 4, "Recv", 0), (102, 5, "Send", 1), (103, 8, "Send", 2), (104, 9, "Recv", 2), (105, 10, "Send", 3), (106, 11, "Recv", 3), (107, 1, "Unlock", 0)]
    folder = _folder(tmp_path, calls, uses)
    got = {tuple(r) for r in chains.lca_of_functions(spark, folder).collect()}
    two = {(2, a, f, f"{a}>{f}") for a in (6, 7) for f in (8, 9)} | {(2, a, f, f"{a}>{b}>{f}") for a, b in ((6, 7), (7, 6)) for f in (8, 9)}
    assert got == {(0, 4, 3, "4>3"), (0, 4, 4, "4"), (1, 5, 5, "5")} | two
    ops = {tuple(r) for r in chains.ops_to_lca_chains(spark, folder).where("op_id < 103").collect()}
    assert ops == {(100, 4, "4>3"), (101, 4, "4"), (102, 5, "5")}


def test_seven_layers_and_visited_chains(spark, tmp_path):
    calls = [(k, k, k + 1, "Call") for k in range(20)]
    uses = [(1, 7, "Send", 0), (2, 0, "Recv", 0), (3, 8, "Send", 1), (4, 0, "Recv", 1), (5, 7, "Send", 2), (6, 7, "Recv", 2), (7, 0, "Recv", 2)]
    folder = _folder(tmp_path, calls, uses)
    chain = ">".join(map(str, range(8)))
    want = {(ch, 0, fn, text) for ch in (0, 2) for fn, text in ((0, "0"), (7, chain))}
    assert {tuple(r) for r in chains.lca_of_functions(spark, folder).collect()} == want  # eight calls away is too far
    assert {tuple(r) for r in chains.remove_visited_chains(spark, folder).collect()} == {r for r in want if r[0] == 0}
