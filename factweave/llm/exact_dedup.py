"""Exact de-duplication by a 128-bit content hash, with the bytes compared inside each hash group. JVM operators only.

Texts count as equal when they are identical after the ASCII white space is deleted; a null text counts as empty.
Of equal texts the row with the most code points stays, then the smallest doc_id.

Plan: (1) rows are aggregated by (hash, normalised text) with a map-side combine, so a hot group of copies leaves each
task as one row; grouping on the text itself compares bytes, so two texts that share a hash stay apart. (2) Each
document looks its group up by (hash, SHA-256): narrow rows without text. Groups of a thousandth of all rows or more, of which
there are a thousand at most, are broadcast, and their rows spread over all tasks.
Two different texts with the same 128-bit hash and the same SHA-256 stop the query instead of being merged.

Cases: empty table -> no rows; null doc_id -> kept apart from no one (it can be the row that stays, as the largest id);
several rows with one doc_id -> each is a row of its own group count; extra columns of any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import SPACE_RE, keep

_MAX = 9223372036854775807
#: Groups with 1 / HOT_SHARE of all rows or more are hot; so there are at most HOT_SHARE of them.
HOT_SHARE = 1000
#: More than any id: a decimal literal.
_STEP = "10000000000000000000"


def _groups(base: DataFrame) -> DataFrame:
    """g_h128, g_sha, keep_id, group_size of each different text; base has doc_id, chars, norm."""
    # The most code points, then the smallest id, as one number, which a hash aggregate can hold.
    rank = F.col("chars").cast("decimal(38,0)") * F.expr(_STEP) + (F.lit(_MAX).cast("decimal(20,0)") - F.coalesce("doc_id", F.lit(_MAX)))
    texts = (
        base.select(F.unhex(F.md5("norm")).alias("h128"), "norm", rank.cast("decimal(38,0)").alias("rank"))
        .groupBy("h128", "norm")
        .agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("size"))
    )
    keep_id = F.lit(_MAX).cast("decimal(20,0)") - F.col("rank") % F.expr(_STEP)
    hashed = texts.select("h128", F.unhex(F.sha2("norm", 256)).alias("sha"), keep_id.cast("long").alias("keep_id"), "size")
    merged = hashed.groupBy("h128", "sha").agg(F.max("keep_id").alias("keep_id"), F.max("size").alias("size"), F.count(F.lit(1)).alias("texts"))
    stop = F.raise_error(F.lit("two different texts share both hashes")).cast("long")
    return merged.select(
        F.col("h128").alias("g_h128"), F.col("sha").alias("g_sha"), F.when(F.col("texts") > 1, stop).otherwise(F.col("keep_id")).alias("keep_id"), F.col("size").alias("group_size")
    )


def _base(docs: DataFrame, text_col: str, id_col: str) -> list:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.length(text).alias("chars"), F.regexp_replace(text, SPACE_RE + "+", "").alias("norm")]


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row for each row of docs."""
    base = docs.select(*_base(docs, text_col, id_col))
    groups = keep(_groups(base))
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hot = groups.where(F.col("group_size") * HOT_SHARE >= max(total, HOT_SHARE))
    hot = hot.select(F.col("g_h128").alias("hot_h128"), F.col("g_sha").alias("hot_sha"), F.col("keep_id").alias("hot_keep"), F.col("group_size").alias("hot_size"))
    rows = base.select("doc_id", F.unhex(F.md5("norm")).alias("h128"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    rows = rows.join(F.broadcast(hot), (F.col("h128") == F.col("hot_h128")) & (F.col("sha") == F.col("hot_sha")), "left")
    # A row of a hot group is answered; it goes through the next join under a key of its own, so that it lands anywhere.
    key = F.when(F.col("hot_size").isNull(), F.col("h128")).otherwise(F.unhex(F.md5(F.concat_ws(":", "doc_id", F.monotonically_increasing_id()))))
    found = rows.withColumn("key", key).join(groups, (F.col("key") == F.col("g_h128")) & (F.col("sha") == F.col("g_sha")), "left")
    keep_id = F.coalesce("hot_keep", "keep_id")
    keep_id = F.when(keep_id != _MAX, keep_id)
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("hot_size", "group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of docs for each different text, with docs' own columns."""
    base = docs.select(*_base(docs, text_col, id_col))
    groups = _groups(base).select(F.col("keep_id").alias("k_id"), "g_h128")
    whole = docs.select(F.struct("*").alias("row"), *_base(docs, text_col, id_col))
    rows = whole.select("row", F.coalesce("doc_id", F.lit(_MAX)).alias("id"), F.unhex(F.md5("norm")).alias("h128"), "chars")
    kept = rows.join(groups, (F.col("id") == F.col("k_id")) & (F.col("h128") == F.col("g_h128")), "left_semi")
    # Rows that repeat an id and its text are one document.
    one = F.row_number().over(Window.partitionBy("id", "h128").orderBy(F.desc("chars")))
    return kept.withColumn("nr", one).where("nr = 1").select("row.*")


def op2_exact_dedup(spark, sf_dir):
    from .tables import documents

    return exact_dedup(documents(spark, sf_dir))


SQL = {
    "op2_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
}
