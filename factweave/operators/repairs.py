"""Which repair fits a goroutine that is left blocked: one more place in the channel's buffer, a deferred send, or a stop channel.

Blocks are summed up first (what their last instructions are, which calls with effects or channel operations they hold), one pass
over each function's blocks says what lies ahead of them and whether they are on a cycle, and channels are summed up over their
operations. A decision is then a join of an operation with its block's, its channel's and its go statement's row: nothing pairs
operations of a channel with each other. Operations of a channel are as many as they are; lists of lines are part of the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.facts import duck_sql, frame
from .fixpoint import after, keep, per_function, walk

# Parts of the names of calls that have effects, and calls that end a function.
EFFECTS = ["Error", "error", "Log", "(*sync/atomic.Value)", "Leave"]
ENDS = ["(*testing.common).Fatalf", "(*testing.common).Fatal"]


def _any(column: str, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(F.col(column), F.lit(p))
    return out


def _blocks(spark: SparkSession, sf_dir: str, seen: dict) -> DataFrame:
    """(b_fn, b_bb, ...) for each block: up to where an instruction is the last of its kind, and what lies ahead of the block."""
    order = Window.partitionBy("fn_id", "bb_id").orderBy("idx")
    inst = frame(spark, sf_dir, "fix_inst", seen).withColumn("follows", F.lead("kind").over(order)).withColumn("nth", F.row_number().over(order))
    kind = F.col("kind")
    closes = (kind == "Call") & F.coalesce(F.col("callee") == "close", F.lit(False))
    before_call = kind.isin("UnOp", "Recv") & F.coalesce(F.col("follows") == "Call", F.lit(False))
    leaves = kind.isin("RunDefers", "Return") | closes
    effect = (kind == "Call") & F.coalesce(_any("callee", EFFECTS), F.lit(False))
    last = lambda cond: F.coalesce(F.max(F.when(cond, F.col("idx"))), F.lit(-1))
    is_nth = lambda n, cond: F.max(F.when(F.col("nth") == n, cond))
    way_out = ((F.count(F.lit(1)) == 2) & is_nth(1, kind == "RunDefers") & is_nth(2, kind == "Return")) | (
        (F.count(F.lit(1)) == 4) & is_nth(2, closes) & is_nth(3, kind == "RunDefers") & is_nth(4, kind == "Return")
    )
    ends = kind.isin("Return", "Panic") | ((kind == "Call") & F.coalesce(F.col("callee").isin(*ENDS) | F.contains("callee", F.lit("assert.")), F.lit(False)))
    blocks = keep(
        inst.groupBy("fn_id", "bb_id").agg(
            F.max(kind == "Return").alias("returns"), F.max(ends).alias("ends"), F.coalesce(way_out, F.lit(False)).alias("way_out"),
            last(~(kind.isin("Send") | leaves | before_call)).alias("last_other"), last(~kind.isin("Send", "Jump")).alias("last_no_jump"),
            last(~(leaves | ((kind == "UnOp") & before_call) | (kind == "Recv"))).alias("last_no_recv"), F.sum((kind == "Recv").cast("int")).alias("n_recv"),
            last(effect).alias("last_effect"), last(kind.isin("Send", "Recv")).alias("last_chan"),
        )
    )
    edges = keep(frame(spark, sf_dir, "fix_edge", seen).select("fn_id", F.col("src_bb").alias("src"), F.col("dst_bb").alias("dst")).distinct())

    def solve(g, s):
        effect, chan = (dict(zip(g["id"].tolist(), g[c].tolist(), strict=True)) for c in ("effect", "chan"))
        out = []
        for n in g["id"].tolist():
            ahead = after(s, n)
            far = ahead - {n}
            out.append((n, n in ahead, any(effect.get(m) for m in far), any(chan.get(m) for m in far)))
        return out

    nodes = blocks.select("fn_id", F.col("bb_id").alias("id"), (F.col("last_effect") >= 0).alias("effect"), (F.col("last_chan") >= 0).alias("chan"))
    ahead = per_function(nodes, edges, solve, "fn_id long, at_bb long, in_loop boolean, effect_ahead boolean, chan_ahead boolean").withColumnRenamed("fn_id", "at_fn")
    one = edges.groupBy(F.col("fn_id").alias("e_fn"), F.col("src").alias("e_bb")).agg(F.count(F.lit(1)).alias("n_succ"), F.min("dst").alias("succ"))
    outs = blocks.where("way_out").select(F.col("fn_id").alias("o_fn"), F.col("bb_id").alias("o_bb"))
    one = one.where("n_succ = 1").join(outs, (F.col("e_fn") == F.col("o_fn")) & (F.col("succ") == F.col("o_bb"))).select("e_fn", "e_bb", F.lit(True).alias("to_way_out"))
    late = frame(spark, sf_dir, "fix_inst", seen).where("kind = 'Defer' and contains(callee, 'Close')").select(F.col("fn_id").alias("d_fn")).distinct().withColumn("closes_late", F.lit(True))
    whole = blocks.join(ahead, (F.col("fn_id") == F.col("at_fn")) & (F.col("bb_id") == F.col("at_bb")))
    whole = whole.join(one, (F.col("fn_id") == F.col("e_fn")) & (F.col("bb_id") == F.col("e_bb")), "left").join(late, F.col("fn_id") == F.col("d_fn"), "left")
    no = F.lit(False)
    return keep(
        whole.select(
            F.col("fn_id").alias("b_fn"), F.col("bb_id").alias("b_bb"), "returns", "ends", "last_other", "last_no_jump", "last_no_recv", "n_recv", "last_effect", "last_chan",
            "in_loop", "effect_ahead", "chan_ahead", F.coalesce("to_way_out", no).alias("to_way_out"), F.coalesce("closes_late", no).alias("closes_late"),
        )
    )


def _at() -> Column:
    return (F.col("fn_id") == F.col("b_fn")) & (F.col("bb_id") == F.col("b_bb"))


def _sends(spark: SparkSession, sf_dir: str, seen: dict, blocks: DataFrame) -> DataFrame:
    sites = frame(spark, sf_dir, "chan_site", seen).where("dir = 'send'").join(blocks, _at())
    last = (F.col("returns") & (F.col("last_other") < F.col("idx"))) | ((F.col("last_no_jump") < F.col("idx")) & F.col("to_way_out"))
    effects = (F.col("last_effect") > F.col("idx")) | F.col("effect_ahead")
    quiet = ~F.col("in_loop") & ~effects & ~(F.col("last_chan") > F.col("idx")) & ~F.col("chan_ahead")
    return sites.select(
        "ch_id", "inst_id", "fn_id", "bb_id", "idx", "line", "thread", "by_line",
        last.alias("is_last"), (~F.col("closes_late") & (last | quiet)).alias("safe"), (effects | F.col("closes_late")).alias("effects"),
    )


def safe_to_unblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ch_id, inst_id, is_last, safe, effects) of each send.

    is_last: nothing but sends, closes, deferred calls and what is read for a call comes before the function returns, in the block or in
    one that does nothing else. safe: no deferred call closes anything, and the send is the last or, outside a loop, no call with
    effects and no channel operation can follow. effects: calls with effects can follow, or a deferred call closes something.
    """
    seen: dict = {}
    return _sends(spark, sf_dir, seen, _blocks(spark, sf_dir, seen)).select("ch_id", "inst_id", "is_last", "safe", "effects")


def _of_channels(sends: DataFrame) -> DataFrame:
    return sends.groupBy(F.col("ch_id").alias("c_ch")).agg(
        F.min("thread").alias("t_min"), F.max("thread").alias("t_max"), F.max(F.col("thread").isNull()).alias("on_main"), F.min("fn_id").alias("f_min"), F.max("fn_id").alias("f_max"),
        F.min("safe").alias("all_safe"), F.max("effects").alias("any_effects"), F.min("is_last").alias("all_last"), F.sort_array(F.collect_list(F.struct("idx", "inst_id", "line"))).alias("sent"),
    )


def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ch_id, inst_id, strategy, make_line, lines): the repair for each send or receive that a goroutine may be left blocked at.

    1: the buffer gets a place. The send's function is what its go statement starts (or the send was found by its line), the send is
    safe to unblock, no other goroutine sends, a second send of the goroutine is in the same function and safe, and the go statement
    is in no loop that the channel is not made in. 3, for sends that 1 does not fit: a stop channel, made at make_line, and a select at each of
    lines, the send's own first. The function that makes the channel returns no channel and (for a send found by its line) is no
    constructor, else the send's function is what its go statement starts; nothing with effects follows any send. 2, for receives: the
    sends and closes at lines become deferred at make_line. The channel is made in another function, of several blocks, the receive is
    the last thing before the return (or in a select), all closes are on the main goroutine or the receive's, all sends are the last
    of their functions. 0: none fits. The checkers' test for exits that avoid the sends holds for every function and is not needed.
    """
    seen: dict = {}
    blocks = _blocks(spark, sf_dir, seen)
    sends = keep(_sends(spark, sf_dir, seen, blocks))
    channels = keep(_of_channels(sends))
    made = frame(spark, sf_dir, "chan_made", seen).select(F.col("ch_id").alias("m_ch"), F.col("fn_id").alias("m_fn"), F.col("bb_id").alias("m_bb"), F.col("line").alias("m_line"))
    sigs = frame(spark, sf_dir, "fn_sig", seen)
    chan, builds = F.contains("result", F.lit("chan ")), (F.col("result") != "") & (F.lower("name") == F.concat(F.lit("new"), F.lower(F.element_at(F.split("result", "[.]"), -1))))
    made = made.join(sigs.select(F.col("fn_id").alias("s_fn"), chan.alias("gives_chan"), builds.alias("builds")), F.col("m_fn") == F.col("s_fn"), "left").drop("s_fn")
    loops = blocks.select(F.col("b_fn").alias("l_fn"), F.col("b_bb").alias("l_bb"), "in_loop")
    calls = frame(spark, sf_dir, "go_start", seen).distinct()
    starts = calls.select(F.col("site").alias("r_site"), F.col("callee").alias("r_fn")).distinct().withColumn("related", F.lit(True))
    places = calls.select(F.col("site").alias("g_site"), F.col("fn_id").alias("g_fn"), F.col("bb_id").alias("g_bb")).distinct()
    places = places.join(loops, (F.col("g_fn") == F.col("l_fn")) & (F.col("g_bb") == F.col("l_bb"))).select("g_site", "g_fn", "g_bb", F.col("in_loop").alias("g_loop"))
    only = calls.where("is_static").groupBy(F.col("fn_id").alias("o_fn"), F.col("callee").alias("o_callee")).agg(F.countDistinct("site").alias("n"), F.min("bb_id").alias("o_bb")).where("n = 1").drop("n")
    only = only.join(loops, (F.col("o_fn") == F.col("l_fn")) & (F.col("o_bb") == F.col("l_bb"))).select("o_fn", "o_callee", "o_bb", F.col("in_loop").alias("o_loop"))
    per_thread = sends.groupBy(F.col("ch_id").alias("n_ch"), F.col("thread").alias("n_thread")).agg(F.count(F.lit(1)).alias("n_sends"))

    s = sends.join(channels, F.col("ch_id") == F.col("c_ch")).join(made, F.col("ch_id") == F.col("m_ch"))
    s = s.join(per_thread, (F.col("ch_id") == F.col("n_ch")) & F.col("thread").eqNullSafe(F.col("n_thread")))
    s = s.join(starts, (F.col("thread") == F.col("r_site")) & (F.col("fn_id") == F.col("r_fn")), "left")
    s = s.join(places, F.col("thread") == F.col("g_site"), "left").join(only, (F.col("m_fn") == F.col("o_fn")) & (F.col("fn_id") == F.col("o_callee")), "left")
    true = lambda c: F.coalesce(c, F.lit(False))
    same_thread = true((F.col("t_min") == F.col("thread")) & (F.col("t_max") == F.col("thread")))
    alone = (F.col("n_sends") == 1) | (~F.col("on_main") & same_thread & (F.col("f_min") == F.col("f_max")) & F.col("all_safe"))
    related = true(F.col("related"))
    with_make = lambda fn, bb: true((F.col(fn) == F.col("m_fn")) & (F.col(bb) == F.col("m_bb")))
    placed = F.when(F.col("by_line"), F.col("o_bb").isNotNull() & (~F.col("o_loop") | with_make("o_fn", "o_bb"))).otherwise(F.col("g_bb").isNotNull() & (~F.col("g_loop") | with_make("g_fn", "g_bb")))
    buffer = (related | F.col("by_line")) & F.col("safe") & (F.col("t_min").isNull() | same_thread) & alone & true(placed)
    stop = ~true(F.col("gives_chan")) & F.when(F.col("by_line"), ~true(F.col("builds"))).otherwise(related) & ~F.col("any_effects")
    strategy = F.when(buffer, 1).when(stop, 3).otherwise(0)
    lines = F.concat(F.array("line"), F.col("sent.line"))
    as_text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "?")
    patched = lambda which, c: F.when(F.col("strategy") == which, c)
    of_sends = s.withColumn("strategy", strategy.cast("long")).select("ch_id", "inst_id", "strategy", patched(3, F.col("m_line") + 1).alias("make_line"), patched(3, as_text(lines)).alias("lines"))

    sites = frame(spark, sf_dir, "chan_site", seen)
    shut = sites.where("dir = 'close'").groupBy(F.col("ch_id").alias("x_ch")).agg(F.min("thread").alias("x_min"), F.max("thread").alias("x_max"), F.sort_array(F.collect_list(F.struct("idx", "inst_id", "line"))).alias("shut"))
    several = blocks.groupBy(F.col("b_fn").alias("v_fn")).agg((F.count(F.lit(1)) > 1).alias("several"))
    r = sites.where("dir = 'recv'").join(blocks, _at()).join(made, F.col("ch_id") == F.col("m_ch")).join(channels.select("c_ch", "all_last", "sent"), F.col("ch_id") == F.col("c_ch"), "left")
    r = r.join(shut, F.col("ch_id") == F.col("x_ch"), "left").join(several, F.col("m_fn") == F.col("v_fn"), "left")
    own = F.col("x_min").isNull() | true((F.col("x_min") == F.col("thread")) & (F.col("x_max") == F.col("thread")))
    last = F.col("is_select") | (F.col("returns") & (F.col("n_recv") == 1) & (F.col("last_no_recv") < F.col("idx")))
    defers = (F.col("fn_id") != F.col("m_fn")) & last & true(F.col("several")) & own & F.coalesce("all_last", F.lit(True))
    none = F.array().cast("array<bigint>")
    lines = F.concat(F.coalesce("shut.line", none), F.coalesce("sent.line", none))
    of_recvs = r.withColumn("strategy", F.when(defers, 2).otherwise(0).cast("long")).select("ch_id", "inst_id", "strategy", patched(2, F.col("m_line") + 1).alias("make_line"), patched(2, as_text(lines)).alias("lines"))
    return of_sends.union(of_recvs)


def skippable_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ch_id, fn_id, exit_bb): exits of the function that makes a channel which no send or close of the channel lies on the way to.

    Exits are blocks that return, panic or end a test. A channel without sends and closes in its own function has no rows.
    """
    seen: dict = {}
    blocks = _blocks(spark, sf_dir, seen)
    made = frame(spark, sf_dir, "chan_made", seen).select(F.col("ch_id").alias("m_ch"), F.col("fn_id").alias("m_fn"))
    stops = frame(spark, sf_dir, "chan_site", seen).where("dir <> 'recv'").join(made, (F.col("ch_id") == F.col("m_ch")) & (F.col("fn_id") == F.col("m_fn"))).select("fn_id", "ch_id", F.col("bb_id").alias("id")).distinct()
    nodes = blocks.select(F.col("b_fn").alias("fn_id"), F.lit(None).cast("long").alias("ch_id"), F.col("b_bb").alias("id"), "ends").unionByName(stops.withColumn("ends", F.lit(None).cast("boolean")))
    edges = frame(spark, sf_dir, "fix_edge", seen).select("fn_id", F.col("src_bb").alias("src"), F.col("dst_bb").alias("dst"))

    def solve(g, s):
        exits = {n for n, e in zip(g["id"].tolist(), g["ends"].tolist(), strict=True) if e is True}
        obstacles: dict = {}
        for n, c, e in zip(g["id"].tolist(), g["ch_id"].tolist(), g["ends"].tolist(), strict=True):
            if e is None:
                obstacles.setdefault(int(c), set()).add(n)
        return sorted((c, n) for c, stop in obstacles.items() for n in (walk(s, [0], stop.__contains__) & exits) - stop)

    return per_function(nodes, edges, solve, "fn_id long, ch_id long, exit_bb long").select("ch_id", "fn_id", "exit_bb")


_FLAT = """fi AS (SELECT *, kind = 'Call' AND coalesce(callee, '') = 'close' AS shuts, kind = 'Call' AND regexp_matches(coalesce(callee, ''), 'Error|error|Log|\\(\\*sync/atomic\\.Value\\)|Leave') AS eff,
coalesce(lead(kind) OVER (PARTITION BY fn_id, bb_id ORDER BY idx), '') AS nxt, count(*) OVER (PARTITION BY fn_id, bb_id) AS n_in FROM {fix_inst}),
edge AS (SELECT DISTINCT fn_id, src_bb, dst_bb FROM {fix_edge}),
way AS (SELECT fn_id, src_bb, dst_bb FROM edge UNION SELECT w.fn_id, w.src_bb, e.dst_bb FROM way w JOIN edge e ON w.fn_id = e.fn_id AND w.dst_bb = e.src_bb),
outs AS (SELECT fn_id, bb_id FROM fi GROUP BY fn_id, bb_id HAVING string_agg(kind, ',' ORDER BY idx) = 'RunDefers,Return' OR (count(*) = 4 AND string_agg(CASE WHEN shuts THEN 'close' ELSE kind END, ',' ORDER BY idx) LIKE '%,close,RunDefers,Return')),
snd AS (SELECT s.*, (EXISTS (SELECT 1 FROM fi i WHERE i.fn_id = s.fn_id AND i.bb_id = s.bb_id AND i.kind = 'Return')
AND NOT EXISTS (SELECT 1 FROM fi i WHERE i.fn_id = s.fn_id AND i.bb_id = s.bb_id AND i.idx > s.idx AND NOT (i.kind IN ('Send', 'RunDefers', 'Return') OR i.shuts OR (i.kind IN ('UnOp', 'Recv') AND i.nxt = 'Call'))))
OR (NOT EXISTS (SELECT 1 FROM fi i WHERE i.fn_id = s.fn_id AND i.bb_id = s.bb_id AND i.idx >= s.idx AND i.kind NOT IN ('Send', 'Jump'))
AND (SELECT count(*) FROM edge e WHERE e.fn_id = s.fn_id AND e.src_bb = s.bb_id) = 1 AND EXISTS (SELECT 1 FROM edge e JOIN outs o ON e.fn_id = o.fn_id AND e.dst_bb = o.bb_id WHERE e.fn_id = s.fn_id AND e.src_bb = s.bb_id)) AS is_last,
EXISTS (SELECT 1 FROM fi i WHERE i.fn_id = s.fn_id AND i.kind = 'Defer' AND i.callee LIKE '%Close%') AS dc,
EXISTS (SELECT 1 FROM fi i WHERE i.fn_id = s.fn_id AND i.bb_id = s.bb_id AND i.idx > s.idx AND i.eff) OR EXISTS (SELECT 1 FROM way w JOIN fi i ON w.fn_id = i.fn_id AND w.dst_bb = i.bb_id WHERE w.fn_id = s.fn_id AND w.src_bb = s.bb_id AND w.dst_bb <> s.bb_id AND i.eff) AS e1,
EXISTS (SELECT 1 FROM fi i WHERE i.fn_id = s.fn_id AND i.bb_id = s.bb_id AND i.idx > s.idx AND i.kind IN ('Send', 'Recv')) OR EXISTS (SELECT 1 FROM way w JOIN fi i ON w.fn_id = i.fn_id AND w.dst_bb = i.bb_id WHERE w.fn_id = s.fn_id AND w.src_bb = s.bb_id AND w.dst_bb <> s.bb_id AND i.kind IN ('Send', 'Recv')) AS e2,
EXISTS (SELECT 1 FROM way w WHERE w.fn_id = s.fn_id AND w.src_bb = s.bb_id AND w.dst_bb = s.bb_id) AS lp FROM {chan_site} s WHERE s.dir = 'send'),
sends AS (SELECT *, NOT dc AND (is_last OR NOT (lp OR e1 OR e2)) AS safe, e1 OR dc AS effects FROM snd)"""
_PLAN = (
    _FLAT
    + """, go_at AS (SELECT DISTINCT site, fn_id, bb_id FROM {go_start}), looped AS (SELECT DISTINCT fn_id, src_bb AS bb_id FROM way WHERE src_bb = dst_bb),
mk AS (SELECT m.*, coalesce(g.result LIKE '%chan %', false) AS gives_chan, coalesce(g.result <> '' AND lower(g.name) = concat('new', lower(regexp_extract(g.result, '[^.]*$'))), false) AS builds FROM {chan_made} m LEFT JOIN {fn_sig} g ON m.fn_id = g.fn_id),
j AS (SELECT s.*, m.fn_id AS m_fn, m.bb_id AS m_bb, m.line AS m_line, m.gives_chan, m.builds, EXISTS (SELECT 1 FROM {go_start} g WHERE g.site = s.thread AND g.callee = s.fn_id) AS related,
CASE WHEN NOT s.by_line THEN s.thread WHEN (SELECT count(DISTINCT site) FROM {go_start} g WHERE g.is_static AND g.fn_id = m.fn_id AND g.callee = s.fn_id) = 1 THEN (SELECT min(site) FROM {go_start} g WHERE g.is_static AND g.fn_id = m.fn_id AND g.callee = s.fn_id) END AS go_site
FROM sends s JOIN mk m ON s.ch_id = m.ch_id),
b AS (SELECT j.*, (related OR by_line) AND safe AND NOT EXISTS (SELECT 1 FROM sends t WHERE t.ch_id = j.ch_id AND t.thread IS NOT NULL AND t.thread IS DISTINCT FROM j.thread)
AND ((SELECT count(*) FROM sends t WHERE t.ch_id = j.ch_id AND t.thread IS NOT DISTINCT FROM j.thread) = 1 OR NOT EXISTS (SELECT 1 FROM sends t WHERE t.ch_id = j.ch_id AND (t.thread IS NULL OR t.thread IS DISTINCT FROM j.thread OR t.fn_id <> j.fn_id OR NOT t.safe)))
AND EXISTS (SELECT 1 FROM go_at g WHERE g.site = j.go_site AND ((g.fn_id = j.m_fn AND g.bb_id = j.m_bb) OR NOT EXISTS (SELECT 1 FROM looped l WHERE l.fn_id = g.fn_id AND l.bb_id = g.bb_id))) AS gl1,
NOT gives_chan AND (CASE WHEN by_line THEN NOT builds ELSE related END) AND NOT EXISTS (SELECT 1 FROM sends t WHERE t.ch_id = j.ch_id AND t.effects) AS gl3 FROM j),
sent AS (SELECT ch_id, string_agg(coalesce(CAST(line AS VARCHAR), '?'), ',' ORDER BY idx, inst_id) AS lines, bool_and(is_last) AS all_last FROM sends GROUP BY ch_id),
shut AS (SELECT ch_id, string_agg(coalesce(CAST(line AS VARCHAR), '?'), ',' ORDER BY idx, inst_id) AS lines FROM {chan_site} WHERE dir = 'close' GROUP BY ch_id),
r AS (SELECT r.*, m.line AS m_line, concat_ws(',', x.lines, t.lines) AS lines, r.fn_id <> m.fn_id AND (SELECT count(DISTINCT bb_id) FROM fi i WHERE i.fn_id = m.fn_id) > 1 AND coalesce(t.all_last, true)
AND NOT EXISTS (SELECT 1 FROM {chan_site} c WHERE c.ch_id = r.ch_id AND c.dir = 'close' AND c.thread IS NOT NULL AND c.thread IS DISTINCT FROM r.thread)
AND (r.is_select OR (EXISTS (SELECT 1 FROM fi i WHERE i.fn_id = r.fn_id AND i.bb_id = r.bb_id AND i.kind = 'Return') AND NOT EXISTS (SELECT 1 FROM fi i WHERE i.fn_id = r.fn_id AND i.bb_id = r.bb_id AND i.kind = 'Recv' AND i.inst_id <> r.inst_id)
AND NOT EXISTS (SELECT 1 FROM fi i WHERE i.fn_id = r.fn_id AND i.bb_id = r.bb_id AND i.idx > r.idx AND NOT (i.kind IN ('RunDefers', 'Return') OR i.shuts OR (i.kind = 'UnOp' AND i.nxt = 'Call'))))) AS gl2
FROM {chan_site} r JOIN mk m ON r.ch_id = m.ch_id LEFT JOIN sent t ON r.ch_id = t.ch_id LEFT JOIN shut x ON r.ch_id = x.ch_id WHERE r.dir = 'recv')"""
)
SQL = {
    "safe_to_unblock": duck_sql("SELECT ch_id, inst_id, is_last, safe, effects FROM sends", _FLAT),
    "repair_plan": duck_sql(
        """SELECT b.ch_id, b.inst_id, CASE WHEN gl1 THEN 1 WHEN gl3 THEN 3 ELSE 0 END AS strategy, CASE WHEN gl3 AND NOT gl1 THEN m_line + 1 END AS make_line, CASE WHEN gl3 AND NOT gl1 THEN concat(coalesce(CAST(line AS VARCHAR), '?'), ',', t.lines) END AS lines FROM b JOIN sent t ON b.ch_id = t.ch_id
UNION ALL SELECT ch_id, inst_id, CASE WHEN gl2 THEN 2 ELSE 0 END, CASE WHEN gl2 THEN m_line + 1 END, CASE WHEN gl2 THEN lines END FROM r""",
        _PLAN,
    ),
    "skippable_exits": duck_sql(
        """SELECT DISTINCT f.ch_id, f.fn_id, f.bb_id AS exit_bb FROM free f JOIN fi i ON f.fn_id = i.fn_id AND f.bb_id = i.bb_id
WHERE i.kind IN ('Return', 'Panic') OR (i.kind = 'Call' AND (i.callee IN ('(*testing.common).Fatal', '(*testing.common).Fatalf') OR i.callee LIKE '%assert.%'))""",
        _FLAT + """, stop AS (SELECT DISTINCT c.ch_id, c.fn_id, c.bb_id FROM {chan_site} c JOIN {chan_made} m ON c.ch_id = m.ch_id AND c.fn_id = m.fn_id WHERE c.dir <> 'recv'),
free AS (SELECT DISTINCT ch_id, fn_id, CAST(0 AS BIGINT) AS bb_id FROM stop WHERE (ch_id, 0) NOT IN (SELECT ch_id, bb_id FROM stop)
UNION SELECT f.ch_id, f.fn_id, e.dst_bb FROM free f JOIN edge e ON f.fn_id = e.fn_id AND f.bb_id = e.src_bb WHERE (f.ch_id, e.dst_bb) NOT IN (SELECT ch_id, bb_id FROM stop))""",
    ),
}
QUERIES = {k: globals()[k] for k in SQL}
