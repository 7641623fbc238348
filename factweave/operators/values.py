"""Questions on values' operands: which values are computed alike, and what a value comes from.

value has value_id, fn_id, kind, type and text (an operator, a constant, a name); operand has value_id, pos and arg_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.facts import duck_sql, frame, run_sql
from .fixpoint import keep, semi_naive

#: Kinds that are compared by their operands, and leaves that are compared by their text; any other value equals itself only.
INNER, BY_TEXT = ("BinOp", "Call", "UnOp", "FieldAddr"), ("Const", "Global")
MIRRORED = {">": "<", ">=": "<="}


def value_equal_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value_id, class_id): values computed alike are of one class, named by its smallest value.

    Constants and globals are alike by type and text; operators, calls, dereferences and fields by kind, type, text and the
    classes of their operands. == and != do not mind the order of theirs; a > b is b < a, a >= b is b <= a. Classes are found from
    the leaves up, a level a round; keys are compared as they are, not by hashes. An operand that is missing, or a cycle, leaves a
    value alone in its class.
    """
    values, operands = keep(frame(spark, sf_dir, "value").select("value_id", "kind", "type", "text")), keep(frame(spark, sf_dir, "operand").select("value_id", "pos", "arg_id"))
    is_inner = F.col("kind").isin(*INNER)
    named = values.where(F.col("kind").isin(*BY_TEXT))
    own = values.where(~is_inner & ~F.col("kind").isin(*BY_TEXT)).select("value_id", F.col("value_id").alias("class_id"))
    first = _classed(named, ["kind", "type", "text"])
    counts = operands.groupBy(F.col("value_id").alias("n_id")).agg(F.count(F.lit(1)).alias("n_args"))
    left = keep(values.where(is_inner).join(counts, F.col("value_id") == F.col("n_id")).drop("n_id"))
    level = keep(own.union(first))
    done, known = [level], keep(operands.limit(0).select("value_id", "pos", F.col("arg_id").alias("arg_class")))
    while True:
        fresh = operands.join(level.select(F.col("value_id").alias("c_id"), F.col("class_id").alias("arg_class")), F.col("arg_id") == F.col("c_id")).select("value_id", "pos", "arg_class")
        known = keep(known.union(fresh))
        met = known.groupBy(F.col("value_id").alias("k_id")).agg(F.count(F.lit(1)).alias("met"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "arg_class"))), lambda p: p["arg_class"]).alias("args"))
        ready = keep(left.join(met, (F.col("value_id") == F.col("k_id")) & (F.col("met") == F.col("n_args"))).select("value_id", "kind", "type", "text", "args"))
        if ready.isEmpty():
            break
        level = keep(_classed(_canonical(ready), ["kind", "type", "text", "args"]))
        done.append(level)
        left = keep(left.join(level.select(F.col("value_id").alias("l_id")), F.col("value_id") == F.col("l_id"), "left_anti"))
        known = keep(known.join(level.select(F.col("value_id").alias("l_id")), F.col("value_id") == F.col("l_id"), "left_anti"))
    rest = reduce(DataFrame.union, done).select(F.col("value_id").alias("r_id"), "class_id")
    return values.join(rest, F.col("value_id") == F.col("r_id"), "left").select("value_id", F.coalesce("class_id", "value_id").alias("class_id"))


def _canonical(ready: DataFrame) -> DataFrame:
    mirrored = (F.col("kind") == "BinOp") & F.col("text").isin(*MIRRORED)
    either = (F.col("kind") == "BinOp") & F.col("text").isin("==", "!=")
    args = F.when(mirrored, F.reverse("args")).when(either, F.sort_array("args")).otherwise(F.col("args"))
    text = reduce(lambda c, item: F.when(mirrored & (F.col("text") == item[0]), item[1]).otherwise(c), MIRRORED.items(), F.col("text"))
    return ready.select("value_id", "kind", "type", text.alias("text"), args.alias("args"))


def _classed(rows: DataFrame, key: list[str]) -> DataFrame:
    """(value_id, class_id): rows of equal keys under the smallest of their values."""
    heads = rows.groupBy(*key).agg(F.min("value_id").alias("class_id")).withColumnsRenamed({c: f"h_{c}" for c in key})
    return rows.join(heads, [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in key]).select("value_id", "class_id")


# What a value comes from, by its kind: a dereference or field of its first operand, a phi of any of them; others are ends.
_FROM = "SELECT o.value_id AS e_id, o.arg_id FROM {operand} o JOIN {value} v ON o.value_id = v.value_id WHERE (v.kind IN ('UnOp', 'FieldAddr') AND o.pos = 0)"


def _walked(spark: SparkSession, sf_dir: str, steps: str) -> DataFrame:
    """(value_id, at, kind, type): values that a value comes from by one step or more and that no step leads on from."""
    edges = keep(run_sql(spark, sf_dir, steps))
    walk = semi_naive(edges.select(F.col("e_id").alias("value_id"), F.col("arg_id").alias("at")), lambda d: d.join(edges, F.col("at") == F.col("e_id")).select("value_id", F.col("arg_id").alias("at")))
    ends = frame(spark, sf_dir, "value").select(F.col("value_id").alias("v_id"), "kind", "type")
    on = edges.select(F.col("e_id").alias("s_id")).distinct()
    return walk.join(on, F.col("at") == F.col("s_id"), "left_anti").join(ends, F.col("at") == F.col("v_id")).select("value_id", "at", "kind", "type")


def get_base_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value_id, base_id, base_type): the value at the root of a chain of dereferences and fields, and its type."""
    return _walked(spark, sf_dir, _FROM).select("value_id", F.col("at").alias("base_id"), F.col("type").alias("base_type"))


def find_primitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value_id, prim, kind): allocations and globals that a value may come from through dereferences, fields and phis."""
    ends = _walked(spark, sf_dir, _FROM + " OR v.kind = 'Phi'").where("kind in ('Alloc', 'Global')")
    return ends.select("value_id", F.col("at").alias("prim"), "kind")


def _forms(levels: int = 8) -> str:
    """For DuckDB: each value written out, by ranges of positions, as the facts' operands stand at half and a third of a position."""
    leaf = "CASE WHEN v.kind IN ('Const', 'Global') THEN concat(v.kind, '[', v.type, ' ', v.text, ']') ELSE concat('#', v.value_id) END"
    inner = """CASE WHEN v.kind = 'BinOp' AND v.text IN ('==', '!=') THEN concat('B[', v.type, ' ', v.text, ' ', least(a.form, b.form), ' ', greatest(a.form, b.form), ']')
WHEN v.kind = 'BinOp' AND v.text IN ('>', '>=') THEN concat('B[', v.type, ' ', replace(v.text, '>', '<'), ' ', b.form, ' ', a.form, ']') WHEN v.kind = 'BinOp' THEN concat('B[', v.type, ' ', v.text, ' ', a.form, ' ', b.form, ']')
WHEN v.kind IN ('Call', 'UnOp', 'FieldAddr') THEN concat(v.kind, '[', v.type, ' ', v.text, ' ', a.form, ']') ELSE """ + leaf + " END"
    out = [f"form0 AS (SELECT v.value_id, {leaf} AS form FROM {{value}} v WHERE v.idx = 0)"]
    for k in range(1, levels + 1):
        out.append(
            f"""form{k} AS (SELECT * FROM form{k - 1} UNION ALL SELECT v.value_id, {inner} AS form FROM {{value}} v LEFT JOIN {{operand}} p ON p.value_id = v.value_id AND p.pos = 0 LEFT JOIN form{k - 1} a ON p.arg_id = a.value_id
LEFT JOIN {{operand}} q ON q.value_id = v.value_id AND q.pos = 1 LEFT JOIN form{k - 1} b ON q.arg_id = b.value_id WHERE v.idx >= {2 ** (k - 1)} AND v.idx < {2**k})"""
        )
    return ", ".join(out)


_WALK = "e AS ({0}), w AS (SELECT e_id AS value_id, arg_id AS at FROM e UNION SELECT w.value_id, e.arg_id FROM w JOIN e ON w.at = e.e_id), z AS (SELECT w.value_id, w.at, v.kind, v.type FROM w JOIN {{value}} v ON w.at = v.value_id WHERE w.at NOT IN (SELECT e_id FROM e))"
SQL = {
    "value_equal_limited": duck_sql("SELECT value_id, min(value_id) OVER (PARTITION BY form) AS class_id FROM form8", _forms()),
    "get_base_type": duck_sql("SELECT value_id, z.at AS base_id, z.type AS base_type FROM z", _WALK.replace("{0}", _FROM).replace("{{", "{").replace("}}", "}")),
    "find_primitive": duck_sql("SELECT value_id, z.at AS prim, kind FROM z WHERE kind IN ('Alloc', 'Global')", _WALK.replace("{0}", _FROM + " OR v.kind = 'Phi'").replace("{{", "{").replace("}}", "}")),
}
QUERIES = {k: globals()[k] for k in SQL}
