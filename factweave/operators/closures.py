"""Functions nested in functions: unlocks in deferred closures, and calls for a test's own goroutine in started ones.

The closures of a program are the edges (fn_id, parent_fn); what holds for a function and all that is nested in it is a walk
down these edges from the functions asked for. Block-level facts travel along a function's blocks in one pass (per_function).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.facts import duck_sql, frame
from .fixpoint import after, keep, per_function, reach

# Calls that end or skip a test and belong in the test's own goroutine.
FATAL = ["Fatal", "Fatalf", "FailNow", "Skip", "Skipf", "SkipNow"]


def deferred_unlocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, bb_id, idx, prim): what deferred instructions release when they run: a deferred unlock its mutex, a deferred closure all
    that its own calls unlock (deferred ones in it do not count, nor what it calls or nests)."""
    seen: dict = {}
    inst = frame(spark, sf_dir, "inst", seen)
    own = inst.where("is_defer and op = 'Unlock'").select("fn_id", "bb_id", "idx", "prim")
    inside = inst.where("op = 'Unlock' and not is_defer").select(F.col("fn_id").alias("u_fn"), F.col("prim").alias("u_prim")).distinct()
    sites = frame(spark, sf_dir, "defer_closure", seen).select(F.col("site").alias("d_site"), "closure_fn")
    late = inst.where("is_defer and op <> 'Unlock'").join(sites, F.col("inst_id") == F.col("d_site")).join(inside, F.col("closure_fn") == F.col("u_fn"))
    return own.union(late.select("fn_id", "bb_id", "idx", "u_prim")).distinct()


def released_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inst_id, prim): mutexes that a deferred unlock, in a closure too, releases when the function ends, for each lock that is taken after it.

    These are the deferred unlocks before the lock in its block, and all in the blocks that lead to its block; what a loop leads
    back to after the lock, in its own block, does not count.
    """
    defers = keep(deferred_unlocks(spark, sf_dir))
    locks = frame(spark, sf_dir, "inst").where("op = 'Lock'").select(F.col("fn_id").alias("l_fn"), F.col("bb_id").alias("l_bb"), F.col("idx").alias("l_idx"), "inst_id")
    blocks = defers.groupBy("fn_id", F.col("bb_id").alias("id")).agg(F.array_join(F.collect_set(F.col("prim").cast("string")), ",").alias("prims"))

    def solve(g, s):
        arrived = {(b, int(p)) for n, ps in zip(g["id"].tolist(), g["prims"].tolist(), strict=True) for b in after(s, n) if b != n for p in ps.split(",")}
        return sorted(arrived)

    edges = frame(spark, sf_dir, "bb_edge").select("fn_id", F.col("src_bb").alias("src"), F.col("dst_bb").alias("dst"))
    ahead = per_function(blocks, edges, solve, "fn_id long, at_bb long, prim long")
    before = locks.join(defers, (F.col("l_fn") == F.col("fn_id")) & (F.col("l_bb") == F.col("bb_id")) & (F.col("idx") < F.col("l_idx"))).select("inst_id", "prim")
    return before.union(locks.join(ahead, (F.col("l_fn") == F.col("fn_id")) & (F.col("l_bb") == F.col("at_bb"))).select("inst_id", "prim")).distinct()


def api_fatal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, fn_id, fatal_id): go statements of fn_id that start a function which ends or skips a test, itself or nested in it.

    A target that only the call graph knows counts if its full name holds the creator's name. Deferred calls do not count.
    """
    seen: dict = {}
    names = frame(spark, sf_dir, "fn_text", seen)
    creator, started = names.select(F.col("fn_id").alias("c_fn"), "name"), names.select(F.col("fn_id").alias("t_fn"), "text")
    go = frame(spark, sf_dir, "go_target", seen).select("site", "fn_id", "target", "how")
    by_graph = go.where("how = 'dynamic'").join(creator, F.col("fn_id") == F.col("c_fn")).join(started, F.col("target") == F.col("t_fn")).where("contains(text, name)")
    asked = keep(go.where("how <> 'dynamic'").select("site", "fn_id", "target").union(by_graph.select("site", "fn_id", "target")).distinct())
    nested = reach(asked.select(F.col("target").alias("root"), F.col("target").alias("node")).distinct(), frame(spark, sf_dir, "fn_parent", seen).select(F.col("parent_fn").alias("src"), F.col("fn_id").alias("dst")))
    fatal = frame(spark, sf_dir, "sync_op", seen).where(F.col("callee").rlike(r"^\(\*?testing\.\w+\)\.(" + "|".join(FATAL) + ")$") & ~F.col("is_defer"))
    there = nested.join(fatal.select("inst_id", F.col("fn_id").alias("f_fn")), F.col("node") == F.col("f_fn")).select("root", F.col("inst_id").alias("fatal_id"))
    return asked.join(there, F.col("target") == F.col("root")).select("site", "fn_id", "fatal_id").distinct()


_LATE = """late AS (SELECT fn_id, bb_id, idx, prim FROM {inst} WHERE is_defer AND op = 'Unlock'
UNION SELECT i.fn_id, i.bb_id, i.idx, u.prim FROM {inst} i JOIN {defer_closure} d ON i.inst_id = d.site JOIN {inst} u ON u.fn_id = d.closure_fn WHERE i.is_defer AND i.op <> 'Unlock' AND u.op = 'Unlock' AND NOT u.is_defer)"""
SQL = {
    "deferred_unlocks": duck_sql("SELECT fn_id, bb_id, idx, prim FROM late", _LATE),
    "released_later": duck_sql(
        """SELECT l.inst_id, d.prim FROM {inst} l JOIN late d ON l.fn_id = d.fn_id AND l.bb_id = d.bb_id AND d.idx < l.idx WHERE l.op = 'Lock'
UNION SELECT l.inst_id, w.prim FROM {inst} l JOIN way w ON l.fn_id = w.fn_id AND l.bb_id = w.at WHERE l.op = 'Lock' AND w.bb_id <> w.at""",
        _LATE + ", way AS (SELECT d.fn_id, d.bb_id, d.prim, e.dst_bb AS at FROM late d JOIN {bb_edge} e ON d.fn_id = e.fn_id AND d.bb_id = e.src_bb UNION SELECT w.fn_id, w.bb_id, w.prim, e.dst_bb FROM way w JOIN {bb_edge} e ON w.fn_id = e.fn_id AND w.at = e.src_bb)",
    ),
    "api_fatal": duck_sql(
        "SELECT DISTINCT g.site, g.fn_id, s.inst_id AS fatal_id FROM go_in g JOIN {sync_op} s ON g.target = s.fn_id JOIN {sync_api} a ON s.callee = a.callee WHERE a.op LIKE 'Test_%' AND NOT s.is_defer",
        """go_in AS (SELECT g.site, g.fn_id, g.target FROM {go_target} g LEFT JOIN {fn_text} c ON g.fn_id = c.fn_id LEFT JOIN {fn_text} t ON g.target = t.fn_id WHERE g.how IN ('static', 'closure') OR position(c.name IN t.text) > 0
UNION SELECT g.site, g.fn_id, p.fn_id FROM go_in g JOIN {fn_parent} p ON p.parent_fn = g.target)""",
    ),
}
QUERIES = {k: globals()[k] for k in SQL}
