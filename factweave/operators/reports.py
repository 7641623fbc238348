"""Reports: which of many that say the same are given, and how benchmarks changed, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.facts import duck_sql, frame, run_sql
from .fixpoint import keep

_REPORTS = """SELECT n.lock1, n.lock2, CASE WHEN a.line > 0 AND b.line > 0 THEN concat(a.file, ':', CAST(a.line AS STRING), ' ', b.file, ':', CAST(b.line AS STRING)) END AS place
FROM {lock_next} n JOIN {inst} a ON n.lock1 = a.inst_id JOIN {inst} b ON n.lock2 = b.inst_id"""


def dedup_double_lock(spark: SparkSession, sf_dir: str, max_rounds: int = 1000) -> DataFrame:
    """(lock1, lock2): reports, by lock1 and lock2, that no given report before them has the first lock of, or both places of.

    What a report that is itself left out has in common with later ones does not count, so the order decides. Each round gives the
    reports that are the first left of their lock and of their place, and takes out what these cover; places of unknown lines
    are never equal. Rounds are as many as such reports wait for one another; more than max_rounds is an error.
    """
    left, given = keep(run_sql(spark, sf_dir, _REPORTS)), []
    me = F.struct("lock1", "lock2")
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        of_lock = left.groupBy(F.col("lock1").alias("f_lock")).agg(F.min(me).alias("f_first"))
        of_place = left.where("place is not null").groupBy(F.col("place").alias("p_place")).agg(F.min(me).alias("p_first"))
        both = left.join(of_lock, F.col("lock1") == F.col("f_lock")).join(of_place, F.col("place") == F.col("p_place"), "left")
        first = keep(both.where((me == F.col("f_first")) & (F.col("p_first").isNull() | (me == F.col("p_first")))).select("lock1", "lock2", "place"))
        given.append(first)
        locks, places = first.select(F.col("lock1").alias("g_lock")), first.where("place is not null").select(F.col("place").alias("g_place"))
        left = keep(left.join(locks, F.col("lock1") == F.col("g_lock"), "left_anti").join(places, F.col("place") == F.col("g_place"), "left_anti"))
    else:
        raise RuntimeError(f"reports still wait for one another after {max_rounds} rounds")
    out = given[0] if given else left
    for part in given[1:]:
        out = out.union(part)
    return out.select("lock1", "lock2")


def bench_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, nth, percent, multiple, place): how the runs of each benchmark changed, with their place by magnitude, name and run.

    Benchmarks that were not run as often before as after are left out. The magnitude is the smaller of the two times by the larger; one
    that was or became zero comes last. Texts have two decimals of the exact quotient, halves away from zero. The order is a sort by ranges: no task
    sees more than its range, and places are counted from the sizes of the ranges before it.
    """
    runs = frame(spark, sf_dir, "bench_nth")
    of = lambda half, k: runs.where(F.col("half") == half).select(F.col("name").alias(f"{k}_name"), F.col("nth").alias(f"{k}_nth"), F.col("ns").cast("long").alias(f"{k}_ns"))
    times = lambda half, k: runs.where(F.col("half") == half).groupBy(F.col("name").alias(f"{k}_name")).agg(F.count(F.lit(1)).alias(f"{k}_n"))
    as_often = times(0, "x").join(times(1, "y"), (F.col("x_name") == F.col("y_name")) & (F.col("x_n") == F.col("y_n"))).select("x_name")
    both = of(0, "b").join(of(1, "a"), (F.col("b_name") == F.col("a_name")) & (F.col("b_nth") == F.col("a_nth"))).join(as_often, F.col("b_name") == F.col("x_name"), "left_semi")
    before, after = F.col("b_ns"), F.col("a_ns")
    none, least, most = (before == 0) & (after == 0), F.least(before, after), F.greatest(before, after)
    magnitude = F.when(none, 1.0).when(least == 0, float("inf")).otherwise(least / most)
    hundredths = lambda times, unmeasured: F.when(none, F.lit(unmeasured)).when(before > 0, F.expr(f"(2 * {times} + b_ns) div (2 * b_ns)"))
    text = lambda n: F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    change, ratio = hundredths("10000 * abs(a_ns - b_ns)", 0), hundredths("100 * a_ns", 100)
    percent = F.when(ratio.isNull(), "+Inf%").otherwise(F.concat(F.when(after < before, "-").otherwise("+"), text(change), F.lit("%")))
    multiple = F.when(ratio.isNull(), "+Infx").otherwise(F.concat(text(ratio), F.lit("x")))
    rows = both.select(F.col("b_name").alias("name"), F.col("b_nth").alias("nth"), percent.alias("percent"), multiple.alias("multiple"), magnitude.alias("magnitude"))
    ordered = keep(rows.orderBy("magnitude", "name", "nth").withColumn("at", F.monotonically_increasing_id()))
    span = F.shiftright("at", 33)
    sizes = ordered.groupBy(span.alias("r_range")).agg(F.count(F.lit(1)).alias("n"))
    before_it = F.coalesce(F.sum("n").over(Window.orderBy("r_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("r_range", before_it.alias("start"))
    placed = ordered.withColumn("range", span).join(F.broadcast(starts), F.col("range") == F.col("r_range"))  # a row for each partition
    return placed.select("name", "nth", "percent", "multiple", (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"))


SQL = {
    "bench_changes": duck_sql(
        """SELECT name, nth, CASE WHEN r IS NULL THEN '+Inf%' ELSE concat(CASE WHEN r.a < r.b THEN '-' ELSE '+' END, CAST(p // 100 AS STRING), '.', lpad(CAST(p % 100 AS STRING), 2, '0'), '%') END AS percent,
CASE WHEN r IS NULL THEN '+Infx' ELSE concat(CAST(m // 100 AS STRING), '.', lpad(CAST(m % 100 AS STRING), 2, '0'), 'x') END AS multiple, row_number() OVER (ORDER BY mag, name, nth) AS place
FROM (SELECT *, (20000 * abs(r.a - r.b) + r.b) // (2 * r.b) AS p, (200 * r.a + r.b) // (2 * r.b) AS m
FROM (SELECT x.name, x.nth, CASE WHEN x.ns = 0 AND y.ns = 0 THEN {{'a': 1, 'b': 1}} WHEN x.ns > 0 THEN {{'a': y.ns, 'b': x.ns}} END AS r, CASE WHEN x.ns = y.ns THEN 1 WHEN x.ns * y.ns = 0 THEN 'inf'::DOUBLE WHEN x.ns > y.ns THEN y.ns / x.ns ELSE x.ns / y.ns END AS mag
FROM {bench_nth} x JOIN {bench_nth} y ON x.name = y.name AND x.nth = y.nth WHERE x.half = 0 AND y.half = 1 AND (SELECT sum(CASE h.half WHEN 0 THEN 1 ELSE -1 END) FROM {bench_nth} h WHERE h.name = x.name) = 0))"""
    ),
}
QUERIES = {k: globals()[k] for k in (*SQL, "dedup_double_lock")}
