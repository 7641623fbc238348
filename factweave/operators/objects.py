"""Layout of nested types, and points-to queries by access path: <-x.f, (*x).a[1].b and so on.

A value of a type lies in consecutive nodes, one for each scalar and one for each struct or array that holds them. A path is
resolved on its text: each round takes the operation next to the operand off, and one join with the steps that types allow
finds the type that it leads to. What is left of a path is a list of offsets, and each offset after the first follows one
pointer. So evaluation is one join with the points-to sets for each pointer that a path follows, for all queries at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.facts import duck_sql, frame
from .fixpoint import keep, semi_naive

#: Kinds of types whose values point to something.
POINTING = ("pointer", "slice", "map", "chan", "iface", "func")
OPERAND = r"^([*(<-]*)x($|[^0-9A-Za-z_])"
FIELD, INDEX = r"@\.([A-Za-z_][0-9A-Za-z_]*)", r"@\[((?:[^\[\]]|\[[^\[\]]*\])+)\]"
LOAD, RECEIVE = r"\*@($|\))", r"<-@($|\))"


def _named(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*(F.col(old).alias(new) for new, old in names.items()))


def _layout(spark: SparkSession, sf_dir: str, seen: dict, max_depth: int) -> DataFrame:
    """(type_id, pos, path, leaf_type, part): the nodes of each type; part is the part of the type that the node lies in."""
    types = frame(spark, sf_dir, "obj_typedef", seen)
    parts = _named(frame(spark, sf_dir, "obj_part", seen), p_type="type_id", p_pos="pos", p_name="name", p_part="part_type")
    alone = parts.groupBy(F.col("p_type").alias("a_type")).agg((F.count(F.lit(1)) == 1).alias("alone"))
    inside = types.where("kind in ('struct', 'tuple')").join(parts, F.col("type_id") == F.col("p_type")).join(alone, F.col("type_id") == F.col("a_type"))
    link = F.when(F.col("kind") == "struct", F.concat(F.lit("."), "p_name")).when(F.col("alone"), "").otherwise(F.concat(F.lit("#"), F.col("p_pos").cast("string")))
    below = inside.select(F.col("type_id").alias("c_type"), F.col("p_pos").alias("c_pos"), link.alias("c_link"), F.col("p_part").alias("c_part"))
    below = keep(below.union(types.where("kind = 'array'").select("type_id", F.lit(0).cast("long"), F.lit("[*]"), "elem")))
    every = level = types.select("type_id", F.col("type_id").alias("leaf_type"), F.lit("").alias("path"), F.array().cast("array<bigint>").alias("at"))
    for _ in range(max_depth):
        level = level.join(below, F.col("leaf_type") == F.col("c_type"))
        level = keep(level.select("type_id", F.col("c_part").alias("leaf_type"), F.concat("path", "c_link").alias("path"), F.array_append("at", F.col("c_pos")).alias("at")))
        if level.isEmpty():
            break
        every = every.union(level)
    else:
        raise RuntimeError(f"types are nested deeper than {max_depth}")
    tuples = types.where("kind = 'tuple'").select(F.col("type_id").alias("u_type"))
    nodes = every.join(tuples, F.col("leaf_type") == F.col("u_type"), "left_anti")
    pos = (F.row_number().over(Window.partitionBy("type_id").orderBy("at")) - 1).cast("long")
    return nodes.select("type_id", pos.alias("pos"), "path", "leaf_type", F.get("at", F.lit(0)).alias("part"))


def pta_layout(spark: SparkSession, sf_dir: str, max_depth: int = 64) -> DataFrame:
    """(type_id, pos, path, leaf_type): the nodes of a value of each type in order, with the path and the type of each.

    A struct and an array have a node of their own before their parts' nodes; a tuple has none, and a tuple of one part adds nothing
    to the path. An array has one element for all. Types nested deeper than max_depth (such as one that holds itself) are an error.
    """
    return _layout(spark, sf_dir, {}, max_depth).drop("part")


def _steps(spark: SparkSession, sf_dir: str, seen: dict, max_depth: int = 64) -> DataFrame:
    """(s_type, s_form, s_arg, s_op, s_next, s_load, s_off): what a type allows; a null s_arg takes any index.

    A part of a tuple is found at its number, not behind the nodes of the parts before it, as the checkers have it.
    """
    types = frame(spark, sf_dir, "obj_typedef", seen)
    parts = frame(spark, sf_dir, "obj_part", seen)
    layout = keep(_layout(spark, sf_dir, seen, max_depth))
    begins = layout.where("part is not null").groupBy(F.col("type_id").alias("b_type"), F.col("part").alias("b_part")).agg(F.min("pos").alias("off"))
    sizes = layout.groupBy(F.col("type_id").alias("z_type")).agg(F.count(F.lit(1)).alias("size"))
    fields = parts.join(types.where("kind = 'struct'").select(F.col("type_id").alias("k_type")), F.col("type_id") == F.col("k_type"))
    fields = fields.join(begins, (F.col("type_id") == F.col("b_type")) & (F.col("pos") == F.col("b_part"))).select("type_id", "name", F.concat(F.lit("field "), F.col("pos").cast("string")).alias("op"), "part_type", "off")
    to_struct = types.where("kind = 'pointer'").select(F.col("type_id").alias("p_type"), F.col("elem").alias("p_elem"))
    behind = to_struct.join(fields, F.col("p_elem") == F.col("type_id"))
    indexed = types.where("kind in ('array', 'slice')").select("type_id", F.lit("["), F.lit(None).cast("string"), F.concat("kind", F.lit("elem")), "elem", F.col("kind") == "slice", F.lit(1).cast("long"))
    mapped = types.where("kind = 'map'").join(sizes, F.col("key") == F.col("z_type")).select("type_id", F.lit("["), F.lit(None).cast("string"), F.lit("mapelem"), "elem", F.lit(True), "size")
    tuples = parts.join(types.where("kind = 'tuple'").select(F.col("type_id").alias("k_type")), F.col("type_id") == F.col("k_type"))
    tuples = tuples.select("type_id", F.lit("["), F.col("pos").cast("string"), F.concat(F.lit("index "), F.col("pos").cast("string")), "part_type", F.lit(False), "pos")
    through = types.where("kind in ('pointer', 'chan')").select("type_id", F.when(F.col("kind") == "chan", "<-").otherwise("*"), F.lit(None).cast("string"), F.when(F.col("kind") == "chan", "recv").otherwise("load"), "elem", F.lit(True), F.lit(0).cast("long"))
    every = fields.select("type_id", F.lit("."), "name", "op", "part_type", F.lit(False), "off")
    every = every.union(behind.select("p_type", F.lit("."), "name", F.concat(F.lit("load,"), "op"), "part_type", F.lit(True), "off"))
    return every.union(indexed).union(mapped).union(tuples).union(through).toDF("s_type", "s_form", "s_arg", "s_op", "s_next", "s_load", "s_off")


def _resolved(spark: SparkSession, sf_dir: str, seen: dict) -> DataFrame:
    """(query_id, node, ops, type_id, offs, error) of each query. offs[0] is added to the node, the others behind a pointer each."""
    steps, kinds = keep(_steps(spark, sf_dir, seen)), _named(frame(spark, sf_dir, "obj_typedef", seen), k_type="type_id", kind="kind")
    text = F.regexp_replace(F.coalesce("query", F.lit("")), r"\s", "")
    begun = frame(spark, sf_dir, "path_query", seen).select(
        "query_id", "node", "type_id", F.regexp_replace(text, OPERAND, r"$1@$2").alias("rest"), F.lit("").alias("ops"),
        F.array(F.lit(0).cast("long")).alias("offs"), F.when(~text.rlike(OPERAND), "operand must be named x").alias("error"),
    )
    done = []
    while True:
        rest = F.col("rest")
        form = (
            F.when(rest.rlike("@[.]"), F.when(rest.rlike(FIELD), "."))
            .when(rest.rlike(r"@\["), F.when(rest.rlike(INDEX), "["))
            .when(rest.rlike(r"\(@\)"), "(").when(rest.rlike(RECEIVE), "<-").when(rest.rlike(LOAD), "*")
        )
        done.append(keep(begun.where("error is not null or rest = '@'")))
        begun = keep(begun.where("error is null and rest <> '@'").withColumn("form", form))
        if begun.isEmpty():
            break
        index = F.regexp_extract("rest", INDEX, 1)
        arg = F.when(F.col("form") == ".", F.regexp_extract("rest", FIELD, 1)).when(F.col("form") == "[", F.coalesce(F.expr("nullif(regexp_replace(regexp_extract(rest, '@\\\\[([0-9]+)\\\\]', 1), '^0+(?=[0-9])', ''), '')"), index))
        left = F.when(F.col("form") == ".", F.regexp_replace("rest", FIELD, "@")).when(F.col("form") == "[", F.regexp_replace("rest", INDEX, "@")).when(F.col("form") == "(", F.regexp_replace("rest", r"\(@\)", "@"))
        left = left.when(F.col("form") == "*", F.regexp_replace("rest", LOAD, "@$1")).otherwise(F.regexp_replace("rest", RECEIVE, "@$1"))
        fits = (F.col("type_id") == F.col("s_type")) & (F.col("form") == F.col("s_form")) & (F.col("s_arg").isNull() | (F.col("arg") == F.col("s_arg")))
        tried = begun.withColumn("arg", arg).withColumn("left", left).join(steps, fits, "left")
        none, plain = F.col("s_op").isNull(), F.col("form") == "("
        last = F.element_at("offs", -1)
        added = F.when(F.col("s_load"), F.array_append("offs", F.col("s_off"))).otherwise(F.array_append(F.slice("offs", F.lit(1), F.size("offs") - 1), last + F.col("s_off")))
        begun = tried.select(
            "query_id", "node", F.when(none, F.col("type_id")).otherwise(F.col("s_next")).alias("type_id"), F.when(F.col("form").isNull(), F.col("rest")).otherwise(F.col("left")).alias("rest"),
            F.when(none, F.col("ops")).when(F.col("ops") == "", F.col("s_op")).otherwise(F.concat("ops", F.lit(","), "s_op")).alias("ops"),
            F.when(none, F.col("offs")).otherwise(added).alias("offs"),
            F.when(F.col("form").isNull(), "not an access path").when(none & ~plain, F.concat(F.lit("the type allows no "), "form")).alias("error"),
        )
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    whole = whole.join(kinds, F.col("type_id") == F.col("k_type"), "left")
    no_pointer = F.when(~F.coalesce(F.col("kind"), F.lit("")).isin(*POINTING), "not pointer-like")
    return whole.select("query_id", "node", "ops", "type_id", "offs", F.coalesce("error", no_pointer).alias("error"))


def pta_query_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, ops, type_id, error): operations that each path takes, the type that it leads to, and why it can't be asked.

    Operands are named x; fields (through a pointer too), indexes, receives, loads and parentheses apply, as in the language. White
    space is dropped. An index may hold one more pair of brackets. ops and type_id go as far as the path could be followed.
    """
    return _resolved(spark, sf_dir, {}).select("query_id", "ops", "type_id", "error")


def pta_extended_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, label): what the values may point to that each path reaches from its node; queries with an error have no rows."""
    seen: dict = {}
    copies = keep(_named(frame(spark, sf_dir, "cell_copy", seen), c_src="src", c_dst="dst"))
    pts = semi_naive(frame(spark, sf_dir, "cell_addr", seen), lambda d: d.join(copies, d["node"] == F.col("c_src")).select(F.col("c_dst").alias("node"), "label"))
    pts = keep(_named(pts, p_node="node", label="label"))
    asked = _resolved(spark, sf_dir, seen).where("error is null")
    level = keep(asked.select("query_id", (F.col("node") + F.get("offs", F.lit(0))).alias("at"), F.slice("offs", F.lit(2), F.size("offs")).alias("offs")))
    answers = []
    while True:
        found = keep(level.join(pts, F.col("at") == F.col("p_node")).select("query_id", "label", "offs").distinct())
        answers.append(found.where(F.size("offs") == 0).select("query_id", "label"))
        level = found.where(F.size("offs") > 0)
        if level.isEmpty():
            break
        level = level.select("query_id", (F.col("label") + F.get("offs", F.lit(0))).alias("at"), F.slice("offs", F.lit(2), F.size("offs")).alias("offs"))
    out = answers[0]
    for part in answers[1:]:
        out = out.union(part)
    return out


_BELOW = """below AS (SELECT p.type_id, p.pos, p.part_type, CASE WHEN t.kind = 'struct' THEN concat('.', p.name) WHEN (SELECT count(*) FROM {obj_part} q WHERE q.type_id = p.type_id) > 1 THEN concat('#', CAST(p.pos AS STRING)) ELSE '' END AS link
FROM {obj_part} p JOIN {obj_typedef} t ON p.type_id = t.type_id WHERE t.kind IN ('struct', 'tuple') UNION ALL SELECT type_id, 0, elem, '[*]' FROM {obj_typedef} WHERE kind = 'array'),
lay AS (SELECT type_id, type_id AS leaf, '' AS path, CAST([] AS BIGINT[]) AS at FROM {obj_typedef} UNION ALL SELECT l.type_id, b.part_type, concat(l.path, b.link), list_append(l.at, b.pos) FROM lay l JOIN below b ON l.leaf = b.type_id),
layout AS (SELECT l.type_id, row_number() OVER (PARTITION BY l.type_id ORDER BY l.at) - 1 AS pos, l.path, l.leaf, l.at[1] AS part FROM lay l WHERE NOT EXISTS (SELECT 1 FROM {obj_typedef} t WHERE l.leaf = t.type_id AND t.kind = 'tuple'))"""
_STEP = (
    _BELOW
    + r""", fld AS (SELECT p.type_id, p.name, p.pos, p.part_type, (SELECT min(l.pos) FROM layout l WHERE l.type_id = p.type_id AND l.part = p.pos) AS off FROM {obj_part} p JOIN {obj_typedef} t ON p.type_id = t.type_id WHERE t.kind = 'struct'),
step AS (SELECT type_id AS t, '.' AS form, name AS arg, concat('field ', pos) AS op, part_type AS nxt, 0 AS ld, off FROM fld
UNION ALL SELECT t.type_id, '.', f.name, concat('load,field ', f.pos), f.part_type, 1, f.off FROM {obj_typedef} t JOIN fld f ON t.kind = 'pointer' AND t.elem = f.type_id
UNION ALL SELECT type_id, '[', NULL, CASE kind WHEN 'array' THEN 'arrayelem' WHEN 'slice' THEN 'sliceelem' ELSE 'mapelem' END, elem, CASE kind WHEN 'array' THEN 0 ELSE 1 END, CASE WHEN kind = 'map' THEN (SELECT count(*) FROM layout l WHERE l.type_id = key) ELSE 1 END FROM {obj_typedef} WHERE kind IN ('array', 'slice', 'map')
UNION ALL SELECT p.type_id, '[', CAST(p.pos AS STRING), concat('index ', p.pos), p.part_type, 0, p.pos FROM {obj_part} p JOIN {obj_typedef} t ON p.type_id = t.type_id WHERE t.kind = 'tuple'
UNION ALL SELECT type_id, CASE kind WHEN 'chan' THEN '<-' ELSE '*' END, NULL, CASE kind WHEN 'chan' THEN 'recv' ELSE 'load' END, elem, 1, 0 FROM {obj_typedef} WHERE kind IN ('chan', 'pointer')),
s0 AS (SELECT query_id, node, type_id, regexp_replace(query, '^([*(<-]*)x($|[^0-9A-Za-z_])', '\1@\2') AS rest, '' AS ops, CAST([0] AS BIGINT[]) AS offs, CASE WHEN NOT regexp_matches(query, '^[*(<-]*x($|[^0-9A-Za-z_])') THEN 'operand must be named x' END AS error FROM {path_query}),
st AS (SELECT * FROM s0 UNION ALL SELECT a.query_id, a.node, coalesce(s.nxt, a.type_id),
CASE a.form WHEN '.' THEN regexp_replace(a.rest, '@\.\w+', '@') WHEN '[' THEN regexp_replace(a.rest, '@\[[^\[\]]+\]', '@') WHEN '(' THEN replace(a.rest, '(@)', '@') WHEN '*' THEN replace(a.rest, '*@', '@') WHEN '<-' THEN replace(a.rest, '<-@', '@') ELSE a.rest END,
CASE WHEN s.op IS NULL THEN a.ops WHEN a.ops = '' THEN s.op ELSE concat(a.ops, ',', s.op) END,
CASE WHEN s.op IS NULL THEN a.offs WHEN s.ld = 1 THEN list_append(a.offs, s.off) ELSE list_append(a.offs[1:len(a.offs) - 1], a.offs[len(a.offs)] + s.off) END,
CASE WHEN a.form IS NULL THEN 'not an access path' WHEN s.op IS NULL AND a.form <> '(' THEN concat('the type allows no ', a.form) END
FROM (SELECT *, CASE WHEN form = '.' THEN regexp_extract(rest, '@\.(\w+)', 1) WHEN form = '[' THEN regexp_extract(rest, '@\[([^\[\]]+)\]', 1) END AS arg
FROM (SELECT *, CASE WHEN regexp_matches(rest, '@\.\w') THEN '.' WHEN contains(rest, '@.') THEN NULL WHEN regexp_matches(rest, '@\[[^\[\]]+\]') THEN '[' WHEN contains(rest, '@[') THEN NULL WHEN contains(rest, '(@)') THEN '(' WHEN contains(rest, '<-@') THEN '<-' WHEN contains(rest, '*@') THEN '*' END AS form FROM st) WHERE error IS NULL AND rest <> '@') a
LEFT JOIN step s ON a.type_id = s.t AND a.form = s.form AND (s.arg IS NULL OR s.arg = a.arg)),
res AS (SELECT a.query_id, a.node, a.ops, a.type_id, a.offs, coalesce(a.error, CASE WHEN t.kind IN ('pointer', 'slice', 'map', 'chan', 'iface', 'func') THEN NULL ELSE 'not pointer-like' END) AS error FROM st a LEFT JOIN {obj_typedef} t ON a.type_id = t.type_id WHERE a.error IS NOT NULL OR a.rest = '@')"""
)
_ASK = (
    _STEP
    + """, pts AS (SELECT node, label FROM {cell_addr} UNION SELECT c.dst, p.label FROM pts p JOIN {cell_copy} c ON p.node = c.src),
ask AS (SELECT query_id, node + offs[1] AS at, 2 AS nr, offs FROM res WHERE error IS NULL UNION SELECT a.query_id, p.label + a.offs[a.nr], a.nr + 1, a.offs FROM ask a JOIN pts p ON a.at = p.node WHERE a.nr <= len(a.offs))"""
)
SQL = {
    "pta_layout": duck_sql("SELECT type_id, pos, path, leaf AS leaf_type FROM layout", _BELOW),
    "pta_query_ops": duck_sql("SELECT query_id, ops, type_id, error FROM res", _STEP),
    "pta_extended_query": duck_sql("SELECT DISTINCT a.query_id, p.label FROM ask a JOIN pts p ON a.at = p.node WHERE a.nr > len(a.offs)", _ASK),
}
QUERIES = {k: globals()[k] for k in SQL}
