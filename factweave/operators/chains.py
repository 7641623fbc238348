"""Call chains between the functions that use a channel: lowest common callers, the chains to every operation, what is left.

A channel's users are the functions with a send or receive on it. A common caller reaches all of them by LAYERS calls at most (a
function reaches itself by none); it is lowest if it reaches no other common caller that does not reach it back. Chains are rows
with the functions called so far as an array, grown call by call from the common caller. A step is taken only where the user
is still within reach in the layers that are left, so no row is a dead end but for cycles; a chain names no function twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.facts import duck_sql, frame, run_sql
from .fixpoint import keep

LAYERS = 7
_USERS = "SELECT DISTINCT prim AS ch, fn_id FROM {chan_use} WHERE op IN ('Send', 'Recv')"


def _reach(edges: DataFrame, users: DataFrame) -> DataFrame:
    """(caller, fn, depth): the least number of calls, LAYERS at most, by which a function reaches a user or what calls it."""
    nodes = edges.select("caller").union(edges.select("callee")).union(users.select("fn_id")).distinct()
    level = total = keep(nodes.select(F.col("caller"), F.col("caller").alias("fn"), F.lit(0).alias("depth")))
    e = edges.select(F.col("caller").alias("e_caller"), F.col("callee").alias("e_callee"))
    for depth in range(1, LAYERS + 1):
        up = level.join(e, F.col("caller") == F.col("e_callee")).select(F.col("e_caller").alias("caller"), "fn").distinct()
        known = total.select(F.col("caller").alias("k_caller"), F.col("fn").alias("k_fn"))
        level = keep(up.join(known, (F.col("caller") == F.col("k_caller")) & (F.col("fn") == F.col("k_fn")), "left_anti").withColumn("depth", F.lit(depth)))
        total = total.union(level)
    return keep(total)


def _lowest(users: DataFrame, reach: DataFrame) -> DataFrame:
    """(ch, lca): the lowest common callers of a channel's users."""
    n = users.groupBy(F.col("ch").alias("n_ch")).agg(F.count(F.lit(1)).alias("n"))
    above = reach.groupBy("fn").agg(F.count(F.lit(1)).alias("above"))
    sized = keep(users.join(above, F.col("fn_id") == F.col("fn")).select("ch", F.struct("above", "fn_id").alias("user")))
    one = sized.groupBy(F.col("ch").alias("o_ch")).agg(F.min("user").alias("one"))
    two = sized.join(one, (F.col("ch") == F.col("o_ch")) & (F.col("user") != F.col("one"))).groupBy(F.col("ch").alias("t_ch")).agg(F.min("user").alias("two"))
    # The callers of the user with the fewest that call the next one too: few are left to be held against all users of a channel.
    pair = n.join(one, F.col("n_ch") == F.col("o_ch")).join(two, F.col("n_ch") == F.col("t_ch"), "left")
    pair = keep(pair.select(F.col("n_ch").alias("ch"), "n", F.col("one.fn_id").alias("fn1"), F.col("two.fn_id").alias("fn2")))
    start = pair.where("n > 1").join(reach, F.col("fn1") == F.col("fn")).select("ch", "n", "fn2", "caller")
    next_ = reach.select(F.col("caller").alias("x_caller"), F.col("fn").alias("x_fn"))
    both = keep(start.join(next_, (F.col("caller") == F.col("x_caller")) & (F.col("fn2") == F.col("x_fn")), "left_semi"))
    many = both.where("n > 2").join(users.withColumnRenamed("ch", "u_ch"), F.col("ch") == F.col("u_ch"))
    many = many.join(next_, (F.col("caller") == F.col("x_caller")) & (F.col("fn_id") == F.col("x_fn")), "left_semi").groupBy("ch", "caller", "n").agg(F.count(F.lit(1)).alias("met"))
    common = keep(both.where("n = 2").select("ch", "caller").union(many.where("met = n").select("ch", "caller")).toDF("key", "lca"))
    # A sole user is its own lowest caller, and another of its callers is as low only if the user reaches it back: the rest is not listed.
    sole = keep(pair.where("n = 1").select(F.col("ch").alias("s_ch"), F.col("fn1").alias("s_fn")))
    its = reach.select(F.col("fn").alias("key"), F.col("caller").alias("lca"))
    round_ = its.where("key <> lca").join(sole, F.col("key") == F.col("s_fn"), "left_semi").join(next_, (F.col("key") == F.col("x_caller")) & (F.col("lca") == F.col("x_fn")), "left_semi")
    own = sole.select(F.col("s_fn").alias("key"), F.col("s_fn").alias("lca")).where("key is not null").distinct().union(_least(keep(round_), its, reach))
    return _least(common, common, reach).select(F.col("key").alias("ch"), "lca").union(sole.join(own, F.col("s_fn") == F.col("key")).select("s_ch", "lca"))


def _least(some: DataFrame, common: DataFrame, reach: DataFrame) -> DataFrame:
    """Those of some (key, lca) that reach no other common caller (key, lca) of their key that does not reach them back.

    Most are out by what they call themselves, so few are held against all that they reach.
    """
    member = common.select(F.col("key").alias("m_key"), F.col("lca").alias("m_lca"))
    back = reach.select(F.col("caller").alias("up_from"), F.col("fn").alias("up_to"))
    for calls in (reach.where("depth = 1"), reach.where("depth > 1")):
        low = some.join(calls, F.col("lca") == F.col("caller")).select(F.col("key").alias("l_key"), F.col("lca").alias("l_lca"), F.col("fn").alias("low"))
        low = low.join(member, (F.col("l_key") == F.col("m_key")) & (F.col("low") == F.col("m_lca")), "left_semi")
        low = low.join(back, (F.col("low") == F.col("up_from")) & (F.col("l_lca") == F.col("up_to")), "left_anti")
        some = keep(some.join(low, (F.col("key") == F.col("l_key")) & (F.col("lca") == F.col("l_lca")), "left_anti"))
    return some


def _grown(pairs: DataFrame, edges: DataFrame, reach: DataFrame) -> DataFrame:
    """(lca, fn_id, chain): for each pair (lca, fn_id), the chains of calls from the one to the other, as arrays of functions."""
    e = edges.select(F.col("caller").alias("e_caller"), F.col("callee").alias("e_callee"))
    near = reach.select(F.col("caller").alias("r_caller"), F.col("fn").alias("r_fn"), F.col("depth").alias("r_depth"))
    now = keep(pairs.select("lca", "fn_id", F.array("lca").alias("chain")))
    done = now.where("lca = fn_id")
    now = now.where("lca <> fn_id")
    for k in range(1, LAYERS + 1):
        step = now.join(e, (F.element_at("chain", -1) == F.col("e_caller")) & ~F.array_contains("chain", F.col("e_callee")))
        step = step.join(near, (F.col("e_callee") == F.col("r_caller")) & (F.col("fn_id") == F.col("r_fn")) & (F.col("r_depth") <= LAYERS - k))
        grown = keep(step.select("lca", "fn_id", F.array_append("chain", F.col("e_callee")).alias("chain")))
        done = done.union(grown.where(F.element_at("chain", -1) == F.col("fn_id")))
        now = grown.where(F.element_at("chain", -1) != F.col("fn_id"))
    return done


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ch, lca, fn_id, chain) for the lowest common callers of each channel's users."""
    users = keep(run_sql(spark, sf_dir, _USERS))
    edges = keep(frame(spark, sf_dir, "fn_edge").select("caller", "callee").distinct())
    reach = _reach(edges, users)
    wanted = keep(_lowest(users, reach).join(users.withColumnRenamed("ch", "u_ch"), F.col("ch") == F.col("u_ch")).select("ch", "lca", "fn_id"))
    grown = _grown(wanted.select("lca", "fn_id").distinct(), edges, reach).select(F.col("lca").alias("g_lca"), F.col("fn_id").alias("g_fn"), "chain")
    return wanted.join(grown, (F.col("lca") == F.col("g_lca")) & (F.col("fn_id") == F.col("g_fn"))).select("ch", "lca", "fn_id", "chain")


def _text(chain: str = "chain"):
    return F.array_join(F.col(chain).cast("array<string>"), ">").alias("chain")


def lca_of_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ch, lca, fn_id, chain): the lowest common callers of a channel's users, with every chain of calls to each user."""
    return _chains(spark, sf_dir).select("ch", "lca", "fn_id", _text())


def ops_to_lca_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(op_id, lca, chain): the chains from a channel's lowest common callers that end in the operation's function."""
    ops = run_sql(spark, sf_dir, "SELECT inst_id AS op_id, prim AS o_ch, fn_id AS o_fn FROM {chan_use} WHERE op IN ('Send', 'Recv')")
    chains = _chains(spark, sf_dir)
    return ops.join(chains, (F.col("o_ch") == F.col("ch")) & (F.col("o_fn") == F.col("fn_id"))).select("op_id", "lca", _text())


def remove_visited_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ch, lca, fn_id, chain): wanted chains without those that an earlier channel (of a smaller number) has had walked.

    Chains are compared by value. The first channel of each chain is found first, so a chain that many want is no pair of all.
    """
    wanted = keep(_chains(spark, sf_dir)).withColumn("hash", F.xxhash64("chain"))
    seen = wanted.groupBy(F.col("hash").alias("s_hash"), F.col("chain").alias("s_chain")).agg(F.min("ch").alias("first"))
    same = (F.col("hash") == F.col("s_hash")) & (F.col("chain") == F.col("s_chain")) & (F.col("first") < F.col("ch"))
    return wanted.join(seen, same, "left_anti").select("ch", "lca", "fn_id", _text())


_LOWEST = "users AS (" + _USERS + """),
fn_all AS (SELECT caller AS fn FROM {fn_edge} UNION SELECT callee FROM {fn_edge} UNION SELECT fn_id FROM users),
climb AS (SELECT fn AS caller, fn, 0 AS depth FROM fn_all UNION SELECT e.caller, c.fn, c.depth + 1 FROM climb c JOIN {fn_edge} e ON c.caller = e.callee WHERE c.depth < 7),
above AS (SELECT caller, fn, min(depth) AS depth FROM climb GROUP BY caller, fn),
common AS (SELECT u.ch, a.caller AS lca FROM users u JOIN above a ON u.fn_id = a.fn GROUP BY u.ch, a.caller HAVING count(*) = (SELECT count(*) FROM users v WHERE v.ch = u.ch)),
lowest AS (SELECT c.ch, c.lca FROM common c WHERE NOT EXISTS (SELECT 1 FROM common d JOIN above a ON a.caller = c.lca AND a.fn = d.lca
  WHERE d.ch = c.ch AND d.lca <> c.lca AND NOT EXISTS (SELECT 1 FROM above b WHERE b.caller = d.lca AND b.fn = c.lca)))"""
_GROW = """grow AS (SELECT DISTINCT l.lca, u.fn_id, [l.lca] AS chain FROM lowest l JOIN users u ON l.ch = u.ch
UNION ALL SELECT g.lca, g.fn_id, list_append(g.chain, e.callee) FROM grow g JOIN {fn_edge} e ON e.caller = g.chain[-1] WHERE g.chain[-1] <> g.fn_id AND NOT list_contains(g.chain, e.callee) AND len(g.chain) <= 7)"""
_CHAINS = _LOWEST + ", " + _GROW + ", chains AS (SELECT l.ch, l.lca, g.fn_id, array_to_string(g.chain, '>') AS chain FROM lowest l JOIN users u ON l.ch = u.ch JOIN grow g ON g.lca = l.lca AND g.fn_id = u.fn_id WHERE g.chain[-1] = g.fn_id)"
SQL = {
    "lca_of_functions": duck_sql("SELECT * FROM chains", _CHAINS),
    "ops_to_lca_chains": duck_sql("SELECT o.inst_id AS op_id, c.lca, c.chain FROM {chan_use} o JOIN chains c ON o.prim = c.ch AND o.fn_id = c.fn_id WHERE o.op IN ('Send', 'Recv')", _CHAINS),
    "remove_visited_chains": duck_sql("SELECT * FROM chains c WHERE NOT EXISTS (SELECT 1 FROM chains v WHERE v.chain = c.chain AND v.ch < c.ch)", _CHAINS),
}
QUERIES = {k: globals()[k] for k in SQL}
