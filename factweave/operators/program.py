"""Whole-program relations: points-to sets, call-graph walks, closures over types and packages, dependency of primitives.

All are set-semantics fixpoints over narrow rows (semi-naive rounds), or a fixed number of joins where the operator itself
bounds the depth. Shared sides of a join are small static relations; Spark broadcasts them only below its size threshold.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.facts import SOLE_OWNER, brought, duck_sql, frame, run_sql
from . import locks
from .fixpoint import after, forget, keep, per_function, reach, semi_naive


def _rename(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*(F.col(old).alias(new) for new, old in names.items()))


def points_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, label): inclusion-based points-to sets under all constraints, as points_to_full finds them.

    A folder of a program's own facts that has neither lineitem nor a constraint of another kind has addresses and copies alone.
    """
    more = ("obj_load", "obj_store", "obj_offset", "obj_filter", "obj_untag", "obj_invoke")
    whole = any(brought(spark, sf_dir, name) for name in ("lineitem", *more))
    return points_to_full(spark, sf_dir) if whole else copied_sets(spark, sf_dir)


def copied_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, label): points-to sets under address and copy constraints alone, on which other queries' statements rest."""
    seen: dict = {}
    copy = keep(_rename(frame(spark, sf_dir, "obj_copy", seen), c_src="src", c_dst="dst").distinct())
    return copied(frame(spark, sf_dir, "obj_addr", seen), copy, {"node": ("c_src", "c_dst")})


def copied(base: DataFrame, arcs: DataFrame, along: dict[str, tuple[str, str]]) -> DataFrame:
    """Least set that holds base and follows arcs; along: the columns that an arc changes, and its columns from and to.

    Rows that no arc leaves are found at the end, in one step: the rounds hold only those that go on.
    """
    on = lambda d, side, e: reduce(lambda x, y: x & y, (d[c].eqNullSafe(e[f]) for c, f in side))
    start, end = ([(c, ends[i]) for c, ends in along.items()] for i in (0, 1))
    names = base.columns
    sources = keep(arcs.select(*(F.col(f).alias(f"z_{f}") for _, f in start)).distinct())
    of = lambda side: [(c, f"z_{f}") for (c, _), (_, f) in zip(side, start, strict=True)]
    goes_on = on(arcs, [(f, z) for (_, f), (_, z) in zip(end, of(start), strict=True)], sources)
    inner, last = keep(arcs.join(sources, goes_on, "left_semi")), arcs.join(sources, goes_on, "left_anti")

    def step(d: DataFrame, e: DataFrame) -> DataFrame:
        met = d.join(e, reduce(lambda x, y: x & y, (F.col(c) == F.col(f) for c, f in start)))
        return met.select(*(F.col(along[c][1]).alias(c) if c in along else c for c in names))

    base = keep(base.distinct())
    mid = semi_naive(base.join(sources, on(base, of(start), sources), "left_semi"), lambda d: step(d, inner))
    rest = base.join(sources, on(base, of(start), sources), "left_anti")
    return mid.union(rest.union(step(mid, last)).distinct())


#: A row of packed sets holds a node's labels of one block: 64 for each of these columns, a bit for each label.
_LANES = ("b0", "b1", "b2", "b3")


def _packed(rows: DataFrame, *by: str) -> DataFrame:
    """rows (by, label) as by, block and bits; an unknown label has a block of its own (null)."""
    lane = lambda i: F.expr(f"CASE WHEN label IS NULL THEN {int(i == 0)}L WHEN (shiftright(label, 6) & 3) = {i} THEN shiftleft(1L, CAST(label & 63 AS INT)) ELSE 0L END")
    return _merged(rows.select(*by, F.expr("shiftright(label, 8)").alias("block"), *(lane(i).alias(c) for i, c in enumerate(_LANES))), *by)


def _merged(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, "block").agg(*(F.bit_or(c).alias(c) for c in _LANES))


def _unpacked(rows: DataFrame, *by: str) -> DataFrame:
    """(by, label): the labels of packed sets, one row each."""
    lanes = rows.select(*by, "block", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("nr"), F.col(c).alias("bits")) for i, c in enumerate(_LANES)))).alias("lane"))
    bits = lanes.where("lane.bits <> 0").select(*by, "block", "lane", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    return bits.where("(shiftright(lane.bits, bit) & 1) = 1").select(*by, F.expr("block * 256 + lane.nr * 64 + bit").alias("label"))


def _some(rows: DataFrame) -> DataFrame:
    return rows.where(" OR ".join(f"{c} <> 0" for c in _LANES))


def points_to_full(spark: SparkSession, sf_dir: str, max_rounds: int = 1000) -> DataFrame:
    """(node, label) under all constraints; an object's content is the node -1 - label.

    Beside addresses and copies: loads and stores through pointers; offsets (the field of an object pointed to); type filters (the
    objects of a type); untagging (what the objects of a type hold); and calls of an interface's method: by the type of each object
    that the receiver points to, a method is entered, its receiver is the object, and its parameter gets the argument's set.
    Loads, stores, untagging and calls add copy edges as sets grow. A round joins only the labels that the last one added with
    the edges, and the sets with the edges that it adds. Sets are dense (a load takes all that many objects hold), so rounds work
    on blocks of 256 labels a row, joined by one OR; they are taken apart where a single label counts, and at the end. What a round
    wrote is deleted when the next one has taken it in, so disk holds two rounds and not all.
    """
    seen: dict = {}
    fact = lambda name, *cols: frame(spark, sf_dir, name, seen).selectExpr(*cols)
    rules = fact("obj_load", "src AS at", "'load' AS kind", "NULL AS key", "dst AS other").union(fact("obj_store", "dst", "'store'", "NULL", "src"))
    rules = rules.union(fact("obj_offset", "src", "'offset'", "off", "dst")).union(fact("obj_filter", "src", "'filter'", "type_id", "dst"))
    rules = keep(rules.union(fact("obj_untag", "src", "'untag'", "type_id", "dst")).union(fact("obj_invoke", "recv", "'call'", "method", "arg")).distinct())
    field = keep(fact("obj_field", "label AS d_label", "off AS d_off", "sub AS d_sub"))
    masks = _packed(fact("obj_type", "type_id", "label").where("label IS NOT NULL"), "type_id").withColumnsRenamed({c: f"k_{c}" for c in ("block", *_LANES)})
    # What is taken of a set: the objects of a type, and of the types that have a method, with where their receivers and parameters are.
    chosen = masks.selectExpr("type_id AS k_key", "false AS is_call", "NULL AS recv_node", "NULL AS param_node", "k_block", *(f"k_{c}" for c in _LANES))
    chosen = keep(chosen.union(masks.join(fact("method_impl", "type_id AS m_type", "method", "recv_node", "param_node"), F.col("type_id") == F.col("m_type")).select("method", F.lit(True), "recv_node", "param_node", "k_block", *(f"k_{c}" for c in _LANES))))
    common = [F.col(c).bitwiseAND(F.col(f"k_{c}")).alias(c) for c in _LANES]
    sets = held = keep(_packed(frame(spark, sf_dir, "obj_addr", seen).select("node", "label"), "node"))
    fresh, edges = sets, [keep(fact("obj_copy", "src AS a", "dst AS b").distinct())]
    for _ in range(max_rounds):
        met = keep(fresh.join(rules, F.col("node") == F.col("at")))
        some = met.where("kind IN ('filter', 'untag', 'call')").join(chosen, (F.col("key") == F.col("k_key")) & ((F.col("kind") == "call") == F.col("is_call")) & (F.col("block") == F.col("k_block")))
        some = keep(_some(some.select("kind", "other", "recv_node", "param_node", "block", *common)))
        single = _unpacked(met.where("kind IN ('load', 'store')").select("kind", "other", "block", *_LANES).union(some.where("kind = 'untag'").select("kind", "other", "block", *_LANES)), "kind", "other")
        found = single.selectExpr("if(kind = 'store', other, -1 - label) AS a", "if(kind = 'store', -1 - label, other) AS b").union(some.where("kind = 'call'").select("other", "param_node"))
        added = keep(found.where("a IS NOT NULL AND b IS NOT NULL").distinct())
        parts = _unpacked(met.where("kind = 'offset'"), "key", "other").join(field, (F.col("label") == F.col("d_label")) & (F.col("key") == F.col("d_off")))
        flow = fresh.join(reduce(DataFrame.union, edges), F.col("node") == F.col("a")).select("b", "block", *_LANES)
        flow = flow.union(sets.join(added, F.col("node") == F.col("a")).select("b", "block", *_LANES))
        flow = flow.union(some.where("kind <> 'untag'").select(F.when(F.col("kind") == "call", F.col("recv_node")).otherwise(F.col("other")), "block", *_LANES))
        flow = flow.union(_packed(parts.select("other", F.col("d_sub").alias("label")), "other"))
        new = [f"n_{c}" for c in _LANES]
        both = sets.select("node", "block", *_LANES, *(F.lit(0).cast("long").alias(c) for c in new)).union(flow.select(F.col("b").alias("node"), "block", *[F.lit(0).cast("long")] * len(new), *_LANES))
        both = both.groupBy("node", "block").agg(*(F.bit_or(c).alias(c) for c in (*_LANES, *new)))
        both = keep(both.select("node", "block", *(F.col(c).bitwiseOR(F.col(n)).alias(c) for c, n in zip(_LANES, new, strict=True)), *(F.col(n).bitwiseAND(F.bitwise_not(F.col(c))).alias(n) for c, n in zip(_LANES, new, strict=True))))
        forget(*{id(df): df for df in (held, fresh, met, some)}.values())
        held, sets, fresh = both, both.select("node", "block", *_LANES), keep(_some(both.select("node", "block", *(F.col(n).alias(c) for c, n in zip(_LANES, new, strict=True)))))
        del both, met, some
        if fresh.isEmpty():
            return _unpacked(sets, "node")
        edges = [*edges, added] if len(edges) < 8 else [keep(reduce(DataFrame.union, [*edges, added]).distinct())]
    raise RuntimeError("points-to sets did not settle")


def cg_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caller, site, callee): functions that calls of interfaces' methods reach, by the types of what their receivers point to."""
    return run_sql(spark, sf_dir, _INVOKED, pts=copied_sets(spark, sf_dir))


def dynamic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, type_id, n_labels): the points-to set of each value by the objects' type."""
    return run_sql(spark, sf_dir, _DYNAMIC, pts=copied_sets(spark, sf_dir))


def guru_pointsto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, labels): the sorted points-to set of each value."""
    pts = copied_sets(spark, sf_dir)
    return pts.groupBy("node").agg(F.array_join(F.transform(F.sort_array(F.collect_set("label")), lambda x: x.cast("string")), ",").alias("labels"))


def _fn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(_rename(frame(spark, sf_dir, "fn_edge"), src="caller", dst="callee"))


def digraph_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node): functions reached from 1, 2 or 3, these included."""
    start = spark.createDataFrame([(0, n) for n in (1, 2, 3)], "root long, node long")
    return reach(start, _fn_edges(spark, sf_dir)).select("node")


def digraph_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node): functions that reach 10, 17 or 24, these included."""
    start = spark.createDataFrame([(0, n) for n in (10, 17, 24)], "root long, node long")
    return reach(start, _rename(_fn_edges(spark, sf_dir), src="dst", dst="src")).select("node")


def digraph_allpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node): functions on some path from 1 to what 1 reaches that is divisible by 5."""
    edges = _fn_edges(spark, sf_dir)
    ahead = keep(reach(spark.createDataFrame([(0, 1)], "root long, node long"), edges).select("node"))
    back = reach(ahead.where("node % 5 = 0").select(F.lit(0).cast("long").alias("root"), "node"), _rename(edges, src="dst", dst="src"))
    return ahead.join(_rename(back, b_node="node"), F.col("node") == F.col("b_node"), "left_semi")


def digraph_sccs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, scc): the smallest function that a function reaches and is reached from."""
    return components(_fn_edges(spark, sf_dir))


def components(edges: DataFrame) -> DataFrame:
    """(node, scc) for edges (src, dst): the smallest node that a node reaches and is reached from.

    Every round finds the lowest node that reaches each node and the lowest that it reaches. Where they are one, it is of the
    component, and done; other nodes of one component agree in both, so only edges between nodes that do are left for the next
    round. Low is by a hash that tells all numbers apart: by number, rounds would follow from how nodes are numbered. Rows are
    narrow and linear in nodes and edges, whatever is reachable from what, and components that are found are written once.
    """
    edges = keep(edges.where("src is not null and dst is not null").distinct())
    nodes = keep(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    done = []
    edges = edges.where("src <> dst")
    while not nodes.isEmpty():
        ends = _spread(nodes, edges)
        done.append(ends.where("up = down").select("node", "up"))
        rest = keep(ends.where("up <> down"))
        nodes, of = rest.select("node"), lambda n, rest=rest: _rename(rest, **{f"{n}_node": "node", f"{n}_up": "up", f"{n}_down": "down"})
        edges = edges.join(of("s"), F.col("src") == F.col("s_node")).join(of("d"), F.col("dst") == F.col("d_node"))
        edges = keep(edges.where("s_up = d_up and s_down = d_down").select("src", "dst"))
    if not done:
        return nodes.select("node", F.col("node").alias("scc"))
    member = reduce(DataFrame.union, done)
    name = member.groupBy(F.col("up").alias("n_up")).agg(F.min("node").alias("scc"))
    return member.join(name, F.col("up") == F.col("n_up")).select("node", "scc")


def _spread(nodes: DataFrame, edges: DataFrame, hops: int = 12) -> DataFrame:
    """(node, up, down): the lowest hash among a node and all that reach it, and among it and all that it reaches.

    Both spread at once, `hops` edges a job: an edge from each node to itself keeps what it has, so a hop is one shuffle of what
    is offered, and all hops of a job share that of the edges.
    """
    way = lambda a, b, up: edges.select(F.lit(up).alias("e_up"), F.col(a).alias("e_src"), F.col(b).alias("e_dst"))
    own = nodes.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("up"), "node", F.xxhash64("node").alias("low"))
    arcs = keep(way("src", "dst", True).union(way("dst", "src", False)).union(own.select("up", "node", F.col("node").alias("self"))))
    low = own
    while True:
        for _ in range(hops):
            met = low.hint("shuffle_hash").join(arcs, (F.col("up") == F.col("e_up")) & (F.col("node") == F.col("e_src")))
            low = met.groupBy("up", F.col("e_dst").alias("node")).agg(F.min("low").alias("low"), F.max(F.when(F.col("e_src") == F.col("e_dst"), F.col("low"))).alias("was"))
        low = keep(low)
        if low.where("low < was").isEmpty():
            sides = low.where("up").select("node", F.col("low").alias("up")), low.where("not up").select(F.col("node").alias("o_node"), F.col("low").alias("down"))
            return keep(sides[0].join(sides[1], F.col("node") == F.col("o_node")).drop("o_node"))
        low = low.drop("was")


def cg_path_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, depth): the length of a shortest call path from function 1, to every function that it reaches."""
    edges = _rename(_fn_edges(spark, sf_dir), e_src="src", e_dst="dst")
    level = total = keep(spark.createDataFrame([(1, 0)], "node long, depth int"))
    for depth in count(1):
        new = level.join(edges, F.col("node") == F.col("e_src")).select(F.col("e_dst").alias("node"), F.lit(depth).alias("depth")).distinct()
        level = keep(new.join(_rename(total, t_node="node"), F.col("node") == F.col("t_node"), "left_anti"))
        if level.isEmpty():
            break
        total = keep(total.union(level))
    return total.select("node", F.col("depth").cast("long").alias("depth"))


def guru_callstack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, caller): a last call on a shortest path from the root, the smallest caller where there are several."""
    dist = keep(cg_path_search(spark, sf_dir))
    edges = _rename(_fn_edges(spark, sf_dir), e_src="src", e_dst="dst")
    from_ = _rename(dist, p_node="node", p_depth="depth")
    step = dist.join(edges, F.col("node") == F.col("e_dst")).join(from_, (F.col("e_src") == F.col("p_node")) & (F.col("p_depth") == F.col("depth") - 1))
    return step.groupBy("node").agg(F.min("p_node").alias("caller"))


def cg_delete_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caller, callee): the call graph with functions of number 3 mod 10 bypassed."""
    edges = _fn_edges(spark, sf_dir)
    through = keep(edges.where("src % 10 = 3")).select(F.col("src").alias("t_src"), F.col("dst").alias("t_dst"))
    whole = semi_naive(edges.where("src % 10 <> 3"), lambda d: d.join(through, d["dst"] == F.col("t_src")).select("src", F.col("t_dst").alias("dst")))
    return whole.where("dst % 10 <> 3").select(F.col("src").alias("caller"), F.col("dst").alias("callee"))


def _levels(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): every (root, node) at each depth up to the bound."""
    level = total = keep(start.select("root", "node", F.lit(0).alias("depth")))
    e = _rename(edges, e_src="src", e_dst="dst")
    for k in range(1, depth + 1):
        level = keep(level.join(e, F.col("node") == F.col("e_src")).select("root", F.col("e_dst").alias("node"), F.lit(k).alias("depth")).distinct())
        total = total.union(level)
    return total


def bounded_call_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, node, depth): what each function calls within three layers, at its least depth."""
    edges = _fn_edges(spark, sf_dir)
    start = edges.select(F.col("src").alias("root"), F.col("src").alias("node")).distinct()
    return _levels(start, edges, 3).groupBy("root", "node").agg(F.min("depth").cast("long").alias("depth"))


def cond_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(op_fn, wrapper): callers, up to three layers and not by go, of functions with a condition variable's operation."""
    calls = keep(frame(spark, sf_dir, "call_edge").where("site_kind <> 'Go'").select(F.col("callee").alias("src"), F.col("caller").alias("dst")).distinct())
    start = run_sql(spark, sf_dir, "SELECT DISTINCT s.fn_id AS root, s.fn_id AS node FROM {sync_op} s WHERE s.callee = '(*sync.Cond).Wait'")
    return _levels(start, calls, 3).where("depth > 0").select(F.col("root").alias("op_fn"), F.col("node").alias("wrapper")).distinct()


def prims_of_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, prim): primitives on which a function or what it calls, up to seven layers and by one-callee sites, blocks."""
    own = frame(spark, sf_dir, "inst").where("op in ('Send', 'Recv')").select("fn_id", "prim").distinct()
    calls = run_sql(spark, sf_dir, "SELECT DISTINCT caller AS u_caller, callee AS u_callee FROM (SELECT *, count(*) OVER (PARTITION BY site) AS n FROM {call_edge}) WHERE n = 1")
    calls = keep(calls)
    return semi_naive(own, lambda d: d.join(calls, F.col("fn_id") == F.col("u_callee")).select(F.col("u_caller").alias("fn_id"), "prim"), depth=7)


_MADE = "SELECT CAST(floor(inst_id / 10) AS BIGINT) AS ch, min_by(fn_id, inst_id) AS make_fn FROM {inst} GROUP BY CAST(floor(inst_id / 10) AS BIGINT)"


def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p1, p2): an operation that may unblock p1 comes after one that may block on p2 in some function."""
    seen: dict = {}
    seen["inst"] = keep(frame(spark, sf_dir, "inst"))
    nodes = seen["inst"].select("fn_id", F.col("inst_id").alias("id"), "op", F.floor(F.col("inst_id") / 10).cast("long").alias("ch"), "bb_id", "idx")
    edges = frame(spark, sf_dir, "bb_edge", seen).select("fn_id", F.col("src_bb").alias("src"), F.col("dst_bb").alias("dst"))

    def solve(g, s):
        op, ch = dict(zip(g["id"], g["op"], strict=True)), dict(zip(g["id"], g["ch"], strict=True))
        out = set()
        for b in (n for n in s if op[n] in ("Send", "Recv")):
            out |= {(ch[n], ch[b]) for n in after(s, b) if op[n] in ("Send", "Recv", "Unlock")}
        return sorted(out)

    return per_function(nodes, edges, solve, "fn_id long, p1 long, p2 long").select("p1", "p2").distinct()


def circular_dep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p1, p2), p1 < p2: primitives that depend on each other."""
    dep = keep(dependency_edges(spark, sf_dir))
    back = _rename(dep, b1="p1", b2="p2")
    return dep.join(back, (F.col("p1") == F.col("b2")) & (F.col("p2") == F.col("b1")), "left_semi").where("p1 < p2")


def same_parent_dep_prims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p1, p2, make_fn), p1 < p2: primitives that depend on each other and are made in one function: they make one task.

    A primitive is made in the function of its first instruction.
    """
    made = keep(run_sql(spark, sf_dir, _MADE))
    pairs = circular_dep(spark, sf_dir).join(_rename(made, c1="ch", make_fn="make_fn"), F.col("p1") == F.col("c1"))
    return pairs.join(_rename(made, c2="ch", other_fn="make_fn"), (F.col("p2") == F.col("c2")) & (F.col("make_fn") == F.col("other_fn"))).select("p1", "p2", "make_fn")


def scan_all_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id): package members (every seventh function) and every function that occurs in one already found."""
    edges = _fn_edges(spark, sf_dir)
    start = edges.where("src % 7 = 0").select(F.lit(0).cast("long").alias("root"), F.col("src").alias("node")).distinct()
    return reach(start, edges).select(F.col("node").alias("fn_id"))


_FIELDS = "SELECT DISTINCT p_brand AS owner, concat('Brand#', CAST(p_size % 25 AS STRING)) AS inner_type, p_type LIKE 'PROMO%' AND p_size > 47 AS is_sync FROM {part}"


def sync_struct_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(struct_name): structs with a synchronisation field, or with a field of such a struct."""
    fields = keep(run_sql(spark, sf_dir, _FIELDS))
    e = _rename(fields, f_owner="owner", f_inner="inner_type")
    return semi_naive(fields.where("is_sync").select(F.col("owner").alias("struct_name")), lambda d: d.join(e, F.col("struct_name") == F.col("f_inner")).select(F.col("f_owner").alias("struct_name")))


def type_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type_name, method): methods of a type and of the types embedded in it, at any depth."""
    fields = keep(run_sql(spark, sf_dir, _FIELDS))
    e = _rename(fields, f_owner="owner", f_inner="inner_type")
    own = run_sql(spark, sf_dir, "SELECT DISTINCT p_brand AS type_name, concat(p_brand, '.', p_type) AS method FROM {part}")
    return semi_naive(own, lambda d: d.join(e, F.col("type_name") == F.col("f_inner")).select(F.col("f_owner").alias("type_name"), "method"))




def package_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pkg, depth): packages that package 1 imports at any depth, with the longest import chain to each."""
    edges = keep(run_sql(spark, sf_dir, "SELECT DISTINCT ps_a % 60 AS e_src, ps_a % 60 + 1 + ps_b % 3 AS e_dst FROM (SELECT l_partkey AS ps_a, l_suppkey AS ps_b FROM {lineitem} WHERE l_linenumber = 1)"))
    rows = semi_naive(
        spark.createDataFrame([(1, 0)], "pkg long, depth long"),
        lambda d: d.join(edges, F.col("pkg") == F.col("e_src")).select(F.col("e_dst").alias("pkg"), (F.col("depth") + 1).alias("depth")),
    )
    return rows.groupBy("pkg").agg(F.max("depth").alias("depth"))


def fp_recursive_vote(spark: SparkSession, sf_dir: str, at_cap: bool = False) -> DataFrame:
    """(fn_id, is_fp): a function whose unlocked uses of fields are no faults: by its name, or because more than half of its call
    sites have the function's mutex (any lock, where it is not known) held or lie in such functions, judged the same way up to three levels up.

    at_cap is the vote beyond the third level. With true, every function that has callers three levels up is excused, whatever
    is held anywhere; with false, a vote rests on names and locks that were found.
    """
    held = locks.held_at_calls(spark, sf_dir).groupBy(F.col("site").alias("h_site")).agg(F.collect_set("prim").alias("held"))
    edges = run_sql(spark, sf_dir, "SELECT DISTINCT c.callee AS c_fn, c.site, c.caller, m.prim FROM {call_edge} c LEFT JOIN {fn_mutex} m ON c.callee = m.fn_id")
    met = edges.join(held, F.col("site") == F.col("h_site"), "left")
    alive = F.col("held").isNotNull() & (F.col("prim").isNull() | F.coalesce(F.array_contains("held", F.col("prim")), F.lit(False)))
    edges = keep(met.select("c_fn", "caller", alive.alias("alive")))
    fns = keep(run_sql(spark, sf_dir, f"SELECT fn_id, {_SOLE} AS own FROM {{fn_name}}"))
    vote = fns.select("fn_id", F.lit(at_cap).alias("is_fp"))
    for _ in range(3):
        above = _rename(vote, v_fn="fn_id", v_fp="is_fp")
        sites = edges.join(above, F.col("caller") == F.col("v_fn"), "left").select("c_fn", (F.col("alive") | F.coalesce("v_fp", F.lit(False))).alias("fp"))
        share = sites.groupBy("c_fn").agg(F.count_if("fp").alias("yes"), F.count(F.lit(1)).alias("all"))
        vote = fns.join(share, F.col("fn_id") == F.col("c_fn"), "left").select("fn_id", (F.col("own") | F.coalesce(2 * F.col("yes") > F.col("all"), F.lit(False))).alias("is_fp"))
    return vote


def fp_trim_and_rerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(struct_name, field, n_uses, n_locked): fields whose uses are mostly locked when the uses that fp_recursive_vote excuses count as
    locked, but not all, and that are used at four places or more."""
    return run_sql(spark, sf_dir, _RERATED, votes=fp_recursive_vote(spark, sf_dir))


def struct_field_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(struct_name, field, file, line): unlocked uses that nothing excuses, of fields that are mostly used under a lock, both before
    and after excused uses count as locked."""
    return run_sql(spark, sf_dir, _RACE, votes=keep(fp_recursive_vote(spark, sf_dir)))


_DYNAMIC = "SELECT p.node, t.type_id, count(*) AS n_labels FROM {pts} p JOIN {obj_type} t ON p.label = t.label GROUP BY p.node, t.type_id"
_INVOKED = """SELECT DISTINCT i.caller, i.site, m.fn_id AS callee FROM {obj_invoke} i JOIN {pts} p ON i.recv = p.node JOIN {obj_type} t ON p.label = t.label
JOIN {method_impl} m ON t.type_id = m.type_id AND i.method = m.method"""
_SOLE = "(" + " OR ".join(f"lower(name) LIKE '%{word}%'" for word in SOLE_OWNER) + ")"
_RERATED = """SELECT struct_name, field, n_uses, n_locked FROM (SELECT u.struct_name, u.field, count(*) AS n_uses,
CAST(sum(CASE WHEN u.locked OR coalesce(v.is_fp, false) THEN 1 ELSE 0 END) AS BIGINT) AS n_locked, count(DISTINCT concat(u.file, ':', CAST(u.line AS STRING))) AS places
FROM {field_use} u LEFT JOIN {votes} v ON u.fn_id = v.fn_id GROUP BY u.struct_name, u.field) WHERE 4 * n_locked >= 3 * n_uses AND n_locked < n_uses AND places >= 4"""
_RACE = f"""SELECT u.struct_name, u.field, u.file, u.line FROM {{field_use}} u JOIN {{field_ratio}} r ON u.struct_name = r.struct_name AND u.field = r.field
JOIN ({_RERATED}) t ON u.struct_name = t.struct_name AND u.field = t.field LEFT JOIN {{votes}} w ON u.fn_id = w.fn_id
WHERE NOT u.locked AND NOT coalesce(w.is_fp, false) AND 4 * r.n_locked >= 3 * r.n_uses AND r.n_locked < r.n_uses"""


def guru_implements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type_id, iface_id): functions with all the methods that another needs.

    Equal sets of methods are one class on either side. Classes meet by method; the pairs of members, which are the answer and may
    be very many, are only written and never shuffled for a count.
    """
    have, need = frame(spark, sf_dir, "method_set"), frame(spark, sf_dir, "method_need").where("fn_id is not null")
    have = keep(have.groupBy("fn_id").agg(F.sort_array(F.collect_set("prim")).alias("prims")))
    need = need.groupBy("fn_id").agg(F.sort_array(F.collect_set("prim")).alias("prims"), F.count_if(F.col("prim").isNull()).alias("unknown"))
    need = keep(need.where("unknown = 0").select("fn_id", "prims"))
    ours = keep(have.select("prims").distinct().withColumn("t_class", F.monotonically_increasing_id()))
    theirs = keep(need.select("prims").distinct().withColumn("q_class", F.monotonically_increasing_id()))
    sides = ours.select("t_class", F.explode("prims").alias("t_prim")), theirs.select("q_class", F.size("prims").alias("n"), F.explode("prims").alias("q_prim"))
    met = sides[0].join(sides[1], F.col("t_prim") == F.col("q_prim")).groupBy("t_class", "q_class", "n").agg(F.count(F.lit(1)).alias("met"))
    met = keep(met.where("met = n").select(F.col("t_class").alias("m_t"), F.col("q_class").alias("m_q")))
    types = keep(have.join(ours, "prims").select(F.col("fn_id").alias("type_id"), "t_class"))
    ifaces = keep(need.join(theirs, "prims").select(F.col("fn_id").alias("iface_id"), "q_class"))
    return types.join(met, F.col("t_class") == F.col("m_t")).join(ifaces, F.col("m_q") == F.col("q_class")).select("type_id", "iface_id")


def const_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, first_bb, n_cases): longest runs of consecutive blocks that compare the same value, of two blocks or more."""
    return run_sql(spark, sf_dir, _SWITCH)


_SWITCH = """SELECT fn_id, min(bb_id) AS first_bb, count(*) AS n_cases FROM (SELECT fn_id, bb_id, v, bb_id - row_number() OVER (PARTITION BY fn_id, v ORDER BY bb_id) AS run FROM
(SELECT fn_id, bb_id, min(prim) AS v FROM {inst} GROUP BY fn_id, bb_id) a) b GROUP BY fn_id, v, run HAVING count(*) > 1"""

_LEVEL = """(SELECT f.fn_id, f.own OR coalesce(2 * s.yes > s.n, false) AS is_fp FROM fns f LEFT JOIN (SELECT e.callee, count(*) AS n, sum(CASE WHEN e.alive OR coalesce(v.is_fp, false) THEN 1 ELSE 0 END) AS yes
FROM e LEFT JOIN ABOVE v ON e.caller = v.fn_id GROUP BY e.callee) s ON f.fn_id = s.callee)"""
_VOTES = (
    locks._HELD
    + f""", e AS (SELECT DISTINCT c.callee, c.site, c.caller, EXISTS (SELECT 1 FROM held h LEFT JOIN {{fn_mutex}} m ON m.fn_id = c.callee WHERE h.at = c.site AND (m.prim IS NULL OR m.prim = h.prim)) AS alive FROM {{call_edge}} c),
fns AS (SELECT fn_id, {_SOLE} AS own FROM {{fn_name}}), v0 AS (SELECT fn_id, false AS is_fp FROM fns)"""
    + "".join(f", {name} AS {_LEVEL.replace('ABOVE', above)}" for name, above in (("v1", "v0"), ("v2", "v1"), ("votes", "v2")))
)
_PTS = "pts AS (SELECT node, label FROM {obj_addr} UNION SELECT c.dst, p.label FROM pts p JOIN {obj_copy} c ON p.node = c.src)"
# Sets and copy edges in one relation, since they feed each other; an object's content is the node -1 - label.
_WHOLE = """pta(kind, a, b) USING KEY (kind, a, b) AS (SELECT 'pts', node, label FROM {obj_addr} UNION SELECT 'edge', src, dst FROM {obj_copy}
UNION SELECT s.kind, s.a, s.b FROM (
  SELECT 'pts' AS kind, e.b AS a, p.b AS b FROM pta p JOIN recurring.pta e ON p.kind = 'pts' AND e.kind = 'edge' AND p.a = e.a
  UNION SELECT 'pts', e.b, p.b FROM pta e JOIN recurring.pta p ON e.kind = 'edge' AND p.kind = 'pts' AND p.a = e.a
  UNION SELECT 'edge', -1 - p.b, l.dst FROM pta p JOIN {obj_load} l ON p.kind = 'pts' AND p.a = l.src
  UNION SELECT 'edge', l.src, -1 - p.b FROM pta p JOIN {obj_store} l ON p.kind = 'pts' AND p.a = l.dst
  UNION SELECT 'pts', o.dst, f.sub FROM pta p JOIN {obj_offset} o ON p.kind = 'pts' AND p.a = o.src JOIN {obj_field} f ON p.b = f.label AND o.off = f.off
  UNION SELECT 'pts', o.dst, p.b FROM pta p JOIN {obj_filter} o ON p.kind = 'pts' AND p.a = o.src JOIN {obj_type} t ON p.b = t.label AND o.type_id = t.type_id
  UNION SELECT 'edge', -1 - p.b, o.dst FROM pta p JOIN {obj_untag} o ON p.kind = 'pts' AND p.a = o.src JOIN {obj_type} t ON p.b = t.label AND o.type_id = t.type_id
  UNION SELECT 'pts', m.recv_node, p.b FROM pta p JOIN {obj_invoke} i ON p.kind = 'pts' AND p.a = i.recv JOIN {obj_type} t ON p.b = t.label JOIN {method_impl} m ON t.type_id = m.type_id AND i.method = m.method
  UNION SELECT 'edge', i.arg, m.param_node FROM pta p JOIN {obj_invoke} i ON p.kind = 'pts' AND p.a = i.recv JOIN {obj_type} t ON p.b = t.label JOIN {method_impl} m ON t.type_id = m.type_id AND i.method = m.method
) s WHERE NOT EXISTS (SELECT 1 FROM recurring.pta k WHERE k.kind = s.kind AND k.a = s.a AND k.b = s.b))"""
_FWD = "fwd AS (SELECT CAST(s AS BIGINT) AS node FROM (VALUES (1), (2), (3)) AS t(s) UNION SELECT e.callee FROM fwd f JOIN {fn_edge} e ON f.node = e.caller)"
_DIST = "walk AS (SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION SELECT e.callee, w.depth + 1 FROM walk w JOIN {fn_edge} e ON w.node = e.caller WHERE w.depth < (SELECT n FROM {n_fn})), dist AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"
_DEP = """later AS (SELECT b.inst_id AS b, e.dst AS n FROM {inst} b JOIN {inst_edge} e ON b.inst_id = e.src WHERE b.op IN ('Send', 'Recv') UNION SELECT l.b, e.dst FROM later l JOIN {inst_edge} e ON l.n = e.src),
dep AS (SELECT DISTINCT CAST(floor(l.n / 10) AS BIGINT) AS p1, CAST(floor(l.b / 10) AS BIGINT) AS p2 FROM later l JOIN {inst} i ON l.n = i.inst_id WHERE i.op IN ('Send', 'Recv', 'Unlock'))"""
SQL = {
    "cg_pointer": duck_sql(_INVOKED, _PTS),
    "points_to": duck_sql("SELECT a AS node, b AS label FROM pta WHERE kind = 'pts'", _WHOLE),
    "dynamic_types": duck_sql(_DYNAMIC, _PTS),
    "guru_pointsto": duck_sql("SELECT node, JOINED[label|,|label] AS labels FROM pts GROUP BY node", _PTS),
    "digraph_forward": duck_sql("SELECT node FROM fwd", _FWD),
    "digraph_reverse": duck_sql("SELECT node FROM fwd", _FWD.replace("(1), (2), (3)", "(10), (17), (24)").replace("SELECT e.callee", "SELECT e.caller").replace("f.node = e.caller", "f.node = e.callee")),
    "digraph_allpaths": duck_sql(
        "SELECT f.node FROM fwd f JOIN back b ON f.node = b.node",
        _FWD.replace("(1), (2), (3)", "(1)") + ", back AS (SELECT node FROM fwd WHERE node % 5 = 0 UNION SELECT e.caller FROM back b JOIN {fn_edge} e ON b.node = e.callee)",
    ),
    "digraph_sccs": duck_sql(
        "SELECT a.root AS node, min(a.node) AS scc FROM r a JOIN r b ON a.root = b.node AND a.node = b.root GROUP BY a.root",
        "r AS (SELECT n AS root, n AS node FROM (SELECT caller AS n FROM {fn_edge} UNION SELECT callee FROM {fn_edge}) UNION SELECT r.root, e.callee FROM r JOIN {fn_edge} e ON r.node = e.caller)",
    ),
    "cg_path_search": duck_sql("SELECT node, depth FROM dist", _DIST),
    "guru_callstack": duck_sql("SELECT d.node, min(p.node) AS caller FROM dist d JOIN {fn_edge} e ON d.node = e.callee JOIN dist p ON p.node = e.caller AND p.depth = d.depth - 1 GROUP BY d.node", _DIST),
    "cg_delete_synthetic": duck_sql(
        "SELECT DISTINCT caller, callee FROM via WHERE callee % 10 <> 3",
        "via AS (SELECT caller, callee FROM {fn_edge} WHERE caller % 10 <> 3 UNION SELECT v.caller, e.callee FROM via v JOIN {fn_edge} e ON v.callee = e.caller WHERE v.callee % 10 = 3)",
    ),
    "bounded_call_tree": duck_sql(
        "SELECT root, node, min(depth) AS depth FROM t GROUP BY root, node",
        "t AS (SELECT DISTINCT caller AS root, caller AS node, CAST(0 AS BIGINT) AS depth FROM {fn_edge} UNION SELECT t.root, e.callee, t.depth + 1 FROM t JOIN {fn_edge} e ON t.node = e.caller WHERE t.depth < 3)",
    ),
    "cond_wrappers": duck_sql(
        "SELECT DISTINCT root AS op_fn, node AS wrapper FROM t WHERE depth > 0",
        "t AS (SELECT DISTINCT fn_id AS root, fn_id AS node, 0 AS depth FROM {sync_op} WHERE callee = '(*sync.Cond).Wait' UNION SELECT t.root, e.caller, t.depth + 1 FROM t JOIN {call_edge} e ON t.node = e.callee AND e.site_kind <> 'Go' WHERE t.depth < 3)",
    ),
    "prims_of_function": duck_sql(
        "SELECT DISTINCT fn_id, prim FROM p",
        """uni AS (SELECT DISTINCT caller, callee FROM (SELECT *, count(*) OVER (PARTITION BY site) AS n FROM {call_edge}) WHERE n = 1),
p AS (SELECT DISTINCT fn_id, prim, 0 AS depth FROM {inst} WHERE op IN ('Send', 'Recv') UNION SELECT u.caller, p.prim, p.depth + 1 FROM p JOIN uni u ON p.fn_id = u.callee WHERE p.depth < 7)""",
    ),
    "dependency_edges": duck_sql("SELECT p1, p2 FROM dep", _DEP),
    "circular_dep": duck_sql("SELECT a.p1, a.p2 FROM dep a JOIN dep b ON a.p1 = b.p2 AND a.p2 = b.p1 WHERE a.p1 < a.p2", _DEP),
    "same_parent_dep_prims": duck_sql(
        "SELECT a.p1, a.p2, m.make_fn FROM dep a JOIN dep b ON a.p1 = b.p2 AND a.p2 = b.p1 JOIN made m ON a.p1 = m.ch JOIN made o ON a.p2 = o.ch AND m.make_fn = o.make_fn WHERE a.p1 < a.p2",
        _DEP + f", made AS ({_MADE})",
    ),
    "scan_all_functions": duck_sql("SELECT n AS fn_id FROM r", "r AS (SELECT DISTINCT caller AS n FROM {fn_edge} WHERE caller % 7 = 0 UNION SELECT e.callee FROM r JOIN {fn_edge} e ON r.n = e.caller)"),
    "sync_struct_closure": duck_sql("SELECT n AS struct_name FROM r", f"f AS ({_FIELDS}), r AS (SELECT DISTINCT owner AS n FROM f WHERE is_sync UNION SELECT f.owner FROM r JOIN f ON r.n = f.inner_type)"),
    "type_methods": duck_sql(
        "SELECT type_name, method FROM r",
        f"f AS ({_FIELDS}), r AS (SELECT DISTINCT p_brand AS type_name, concat(p_brand, '.', p_type) AS method FROM {{part}} UNION SELECT f.owner, r.method FROM r JOIN f ON r.type_name = f.inner_type)",
    ),
    "package_dependencies": duck_sql(
        "SELECT pkg, max(depth) AS depth FROM r GROUP BY pkg",
        """e AS (SELECT DISTINCT l_partkey % 60 AS src, l_partkey % 60 + 1 + l_suppkey % 3 AS dst FROM {lineitem} WHERE l_linenumber = 1),
r AS (SELECT CAST(1 AS BIGINT) AS pkg, CAST(0 AS BIGINT) AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON r.pkg = e.src)""",
    ),
    "fp_recursive_vote": duck_sql("SELECT fn_id, is_fp FROM votes", _VOTES),
    "fp_trim_and_rerate": duck_sql(_RERATED, _VOTES),
    "struct_field_race": duck_sql(_RACE, _VOTES),
    "const_switch": duck_sql(_SWITCH),
}
QUERIES = {k: globals()[k] for k in SQL} | {"points_to_full": points_to_full, "guru_implements": guru_implements}
