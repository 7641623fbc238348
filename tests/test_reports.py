"""Reports that say the same, against a loop over them in order; benchmarks with known changes."""

from __future__ import annotations

import random

import pandas as pd

from factweave.operators import reports


def test_reports_given_once(spark, tmp_path):
    rng = random.Random(0)
    inst = [(n, 1, n, 0, 0, "Lock", 0, f"f{rng.randrange(2)}.go", rng.choice([None, 0, 1, 2, 3]), False) for n in range(60)]
    pd.DataFrame(inst, columns="inst_id fn_id idx bb_id pos op prim file line is_defer".split()).astype({"line": "Int64"}).to_parquet(tmp_path / "inst.parquet")
    pairs = sorted({(rng.randrange(30), rng.randrange(60)) for _ in range(90)})
    pd.DataFrame(pairs, columns=["lock1", "lock2"]).to_parquet(tmp_path / "lock_next.parquet")
    at = {n: (file, line) if line else None for n, *_, file, line, _ in inst}
    locks, places, want = set(), set(), []
    for a, b in pairs:
        place = (at[a], at[b]) if at[a] and at[b] else None
        if a not in locks and place not in places:
            want.append((a, b))
            locks.add(a)
            places |= {place} if place else set()
    got = sorted(tuple(r) for r in reports.dedup_double_lock(spark, str(tmp_path)).collect())
    assert got == want
    assert any(b != min(y for x, y in pairs if x == a) for a, b in want)  # some lock's first report is not the one given
    assert len({a for a, _ in pairs}) > len(want)  # some lock has none


def test_changes_of_benchmarks(spark, tmp_path):
    rows = [("A", 100, 50), ("B", 50, 100), ("C", 0, 0), ("D", 0, 7), ("E", 7, 0), ("F", 3, 4), ("G", 100, 100), ("H", 200, 203), ("I", 30000, 29999)]
    runs = [(name, half, ns, 1) for name, *both in rows for half, ns in enumerate(both)] + [("Z", 0, 5, 1), ("Z", 0, 5, 2), ("Z", 1, 5, 1), ("Y", 0, 5, 1)]
    pd.DataFrame(runs, columns=["name", "half", "ns", "nth"]).to_parquet(tmp_path / "bench_nth.parquet")
    got = [tuple(r) for r in reports.bench_changes(spark, str(tmp_path)).orderBy("place").collect()]
    assert got == [
        ("A", 1, "-50.00%", "0.50x", 1),
        ("B", 1, "+100.00%", "2.00x", 2),
        ("F", 1, "+33.33%", "1.33x", 3),
        ("H", 1, "+1.50%", "1.02x", 4),
        ("I", 1, "-0.00%", "1.00x", 5),
        ("C", 1, "+0.00%", "1.00x", 6),
        ("G", 1, "+0.00%", "1.00x", 7),
        ("D", 1, "+Inf%", "+Infx", 8),
        ("E", 1, "-100.00%", "0.00x", 9),
    ]
