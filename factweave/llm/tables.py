"""Inputs, checkpoints and small helpers that the operators share."""

from __future__ import annotations

import tempfile
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and words, as Java and DuckDB regular expressions.
SPACE_RE = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder; executors that are lost later cost nothing.

    The folder is what the session's spark.checkpoint.dir names. Where that is unset, a session on one machine gets a
    temporary one, and a cluster gets an error, as its executors share no local folder.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="factweave-ckpt-"))
    return df.checkpoint(eager=True)


def n_words(text: Column) -> Column:
    """Words of a text; null is the empty text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_RE)).cast("long")


def crc_of_id(doc_id: int | None) -> int:
    """CRC-32 of the id as text, as in the SQL function crc32(cast(doc_id as string))."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def hashed_sample(df: DataFrame, rows: int, *cols: str):
    """The `rows` rows of a kept table with the smallest hashes of doc_id and cols (all rows if it has no more), as pandas.

    Executors pass on the rows below a hash that leaves a few more than asked for, so the driver gets a bounded number.
    Where equal rows make that too few, the smallest are taken from all rows. The rows are the same however the table is
    partitioned, a table that has rows gives rows, and null or repeated ids are rows like others.
    """
    names = ["doc_id", *cols]
    n = df.count()
    order = F.xxhash64(F.lit("sample"), *names)
    hashed = df.select(*names, order.alias("h_order"))
    if n > rows:
        share = min(1.0, (rows + 6 * rows**0.5 + 64) / n)
        below = hashed.where(F.col("h_order") <= F.lit(min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))))
        got = below.orderBy("h_order", *names).limit(rows).toPandas()
        if len(got) < rows:
            got = hashed.orderBy("h_order", *names).limit(rows).toPandas()
    else:
        got = hashed.toPandas()
    return got.drop(columns="h_order").sort_values(names, kind="stable")


def with_groups(rows: DataFrame, groups: DataFrame, on: dict[str, str], values: list[str], size: str, total: int, share: int = 1000) -> DataFrame:
    """rows with the columns values of the one row of groups whose columns on[k] equal their columns k; null where none does.

    Groups of at least 1 / share of `total` (by their column size; they sum to total at most, so they are no more than
    share in number) are broadcast and answer their rows in place. Those rows go through the join of the others under a
    random key, so that they lie on all partitions; whatever they may meet there is not used. The first key is a long.
    """
    g = lambda c, kind: F.col(c).alias(f"{kind}_{c}")
    columns = list(dict.fromkeys([*on.values(), *values]))
    hot = groups.where(F.col(size) * share >= max(total, share)).select(*(g(c, "hot") for c in columns), F.lit(True).alias("is_hot"))
    first, *others = on
    met = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"hot_{c}") for k, c in on.items()], "left")
    spread = F.when(F.col("is_hot").isNull(), F.col(first)).otherwise(F.xxhash64(F.monotonically_increasing_id()))
    match = [F.col("spread") == F.col(f"g_{on[first]}"), *(F.col(k) == F.col(f"g_{on[k]}") for k in others)]
    found = met.withColumn("spread", spread).join(groups.select(*(g(c, "g") for c in columns)), match, "left")
    out = [F.when(F.col("is_hot"), F.col(f"hot_{c}")).otherwise(F.col(f"g_{c}")).alias(c) for c in values]
    return found.select(*rows.columns, *out)
