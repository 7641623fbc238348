"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations. JVM operators only.

1. Token shares: words of every whole text, summed by source.
2. Weights: share ** tau, normalised. The exponent tau in [0, 1] is bisected: the smallest tau whose rarest source is
   repeated at most max_repeat times, or the tau whose weights have the entropy target_entropy (a share of the largest
   possible), whichever is asked for. tau = 1 leaves the corpus as it is, tau = 0 gives all sources equal weight.
3. Budgets: weight * total tokens of each source, where the total is `budget` tokens, by default the corpus's own; with
   cover=True it is the least total at which no document is left out.
4. Draws: each source's documents are dealt into blocks of about block_rows by a hash; block totals and their running
   sums fix where in the permutation each block begins, and a window inside each block orders its documents by hash. A
   document is drawn once for every full pass that the budget pays for, and once more if it begins before the rest of
   the budget is used up. Every pass has the same order, so a block is read once.

A source may hold any share of the rows: no step sorts or sums a whole source in one task, only its blocks. What is per
source (weights, at most max_sources rows, more is an error) is broadcast.

Cases: null source is a source of its own; null and empty texts have no tokens and are drawn like their neighbours; with no
tokens at all, or an empty table, every document is drawn once or there are no rows; null doc_id sorts first in its block;
repeated rows are drawn each (equal hashes are ordered by id and text length); extra columns are ignored, and kept by `mix_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import documents, keep, n_words

STEPS = 60


def _weights(shares: Column, tau: Column) -> Column:
    raised = F.transform(shares, lambda s: F.pow(s, tau))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _max_repeat(shares: Column, tau: Column, cover: bool) -> Column:
    """Passes over the source that is repeated most."""
    if cover:
        return F.pow(F.array_min(shares) / F.array_max(shares), tau - 1)
    return F.array_max(F.zip_with(_weights(shares, tau), shares, lambda w, s: w / s))


def _entropy(shares: Column, tau: Column) -> Column:
    h = F.aggregate(_weights(shares, tau), F.lit(0.0), lambda a, w: a - F.when(w > 0, w * F.log(w)).otherwise(0.0))
    return F.when(F.size(shares) > 1, h / F.log(F.size(shares).cast("double"))).otherwise(1.0)


def source_weights(
    tokens: DataFrame, max_repeat: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None, cover: bool = False, max_sources: int = 100_000
) -> DataFrame:
    """source, tokens, rows, tau, weight, repeats, one row for each source; tokens has columns source and n_tokens."""
    per = tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total = F.when(F.count(F.lit(1)) > max_sources, F.raise_error(F.lit("more sources than max_sources")).cast("long")).otherwise(F.sum("tokens"))
    # Sorted, so that sums of floating-point numbers do not hang on the order of arrival.
    one = per.agg(F.sort_array(F.collect_list(F.when(F.col("tokens") > 0, F.col("tokens")))).alias("counts"), total.alias("total"))
    shares = F.transform("counts", lambda c: c / F.col("total"))
    one = one.select(shares.alias("shares"), "total")

    # A large tau repeats least and has the least entropy: both goals ask for the smallest tau on their side.
    def short_of(tau: Column) -> Column:
        if target_entropy is not None:
            return _entropy(F.col("shares"), tau) > target_entropy
        return _max_repeat(F.col("shares"), tau, cover) > max_repeat

    def halve(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2
        up = short_of(mid)
        return F.struct(F.when(up, mid).otherwise(state["lo"]).alias("lo"), F.when(up, state["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)
    tau = F.when(F.size("shares") < 1, 1.0).when(~short_of(F.lit(0.0)), 0.0).otherwise(found["hi"])
    one = one.select("shares", "total", tau.alias("tau"))
    norm = F.aggregate(F.transform("shares", lambda s: F.pow(s, F.col("tau"))), F.lit(0.0), lambda a, b: a + b)
    one = one.select("total", "tau", norm.alias("norm"), F.array_max("shares").alias("top"))
    share = F.col("tokens") / F.col("total")
    weight = F.when(F.col("tokens") > 0, F.pow(share, "tau") / F.col("norm")).otherwise(0.0)
    if cover:
        repeats = F.pow(share / F.col("top"), F.col("tau") - 1)
    else:
        repeats = weight / share * ((F.lit(float(budget)) / F.col("total")) if budget is not None else F.lit(1.0))
    repeats = F.when(F.col("tokens") > 0, repeats).otherwise(1.0)
    return per.crossJoin(F.broadcast(one)).select("source", "tokens", "rows", "tau", weight.alias("weight"), repeats.alias("repeats"))


def draws(rows: DataFrame, narrow: DataFrame, weights: DataFrame, block_rows: int = 2048, seed: int = 1) -> DataFrame:
    """The rows with columns block, at (words before the row in its source's permutation) and draws (times drawn).

    rows has columns doc_id, source, n_tokens; narrow is the same rows with no more than these, for the block totals.
    """
    w = weights.select(F.col("source").alias("w_source"), "tokens", "repeats", F.greatest(F.lit(1), F.ceil(F.col("rows") / block_rows)).alias("blocks"))
    block = F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), F.col("doc_id")), F.col("blocks"))
    deal = lambda df: df.join(F.broadcast(w), F.col("source").eqNullSafe(F.col("w_source"))).withColumn("block", block)
    dealt = deal(rows).withColumn("order", F.xxhash64(F.lit(seed), F.col("doc_id")))
    totals = deal(narrow).groupBy("w_source", "block").agg(F.sum("n_tokens").alias("b_tokens"))
    before = F.coalesce(F.sum("b_tokens").over(Window.partitionBy("w_source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col("w_source").alias("b_source"), F.col("block").alias("b_block"), before.alias("b_before"))
    inside = Window.partitionBy("w_source", "block").orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("at_block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = placed.join(totals, F.col("w_source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    at = F.col("at_block") + F.col("b_before")
    full = F.floor("repeats")
    rest = (F.col("repeats") - full) * F.col("tokens")
    times = full + F.when((at < rest) & (rest > 0.5), 1).otherwise(0)
    return placed.select(*rows.columns, "block", at.alias("at"), times.cast("int").alias("draws"))


def _rows(docs: DataFrame, text_col: str, id_col: str, source_col: str) -> list[Column]:
    c = lambda x: F.col(f"`{x}`")
    return [c(id_col).cast("long").alias("doc_id"), c(source_col).cast("string").alias("source"), n_words(c(text_col)).alias("n_tokens")]


def token_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, source, n_tokens (words) of each row."""
    return docs.select(*_rows(docs, text_col, id_col, source_col))


def mixing(docs: DataFrame, block_rows: int = 2048, seed: int = 1, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **goal) -> DataFrame:
    """doc_id, source, n_tokens, block, at, draws: one row for each row of docs. goal: see source_weights."""
    rows = keep(token_rows(docs, text_col, id_col, source_col))  # the texts are read once
    return draws(rows, rows, source_weights(rows, **goal), block_rows, seed)


def mix_rows(docs: DataFrame, block_rows: int = 2048, seed: int = 1, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **goal) -> DataFrame:
    """The rows of docs, each as often as it is drawn, with docs' own columns."""
    narrow = keep(token_rows(docs, text_col, id_col, source_col))
    rows = docs.select(F.struct("*").alias("row"), *_rows(docs, text_col, id_col, source_col))
    drawn = draws(rows, narrow, source_weights(narrow, **goal), block_rows, seed)
    return drawn.where("draws > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("draws"))).alias("epoch")).select("row.*")


def op9_mixing(spark, sf_dir):
    """One row for each draw (epoch 1, 2, ...) of a document."""
    mixed = mixing(documents(spark, sf_dir)).where("draws > 0")
    return mixed.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("draws"))).alias("epoch"), "block", "at")
