"""Quality classifier: histogram gradient-boosted trees over document statistics, in numpy.

Statistics of every whole text are measured once and written to the checkpoint folder (narrow rows); the trees are fitted
on the driver to at most max_rows labelled rows of the training part, and laid out as arrays in which all documents of a
batch go down one level at a time.

Training part: labelled rows whose crc32(doc_id as text) mod 3 is not 1. Of more than max_rows (default 20,000) such
documents, those of the smallest hashes of id and label are taken; that bound is the only sampling. Only statistics of the
text are inputs of a score.

Cases: no labelled rows, or rows of one class -> the score is their share of label 1 (0.5 without rows); null and empty
texts are scored like any text without words; null doc_id counts as the empty string in crc32; several labels of one
document count as their majority (a tie as 0), null labels are ignored; extra columns are ignored; empty table -> no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import FEATURES, document_stats, features, measure
from .tables import documents, hashed_sample, keep, labels
from .textcols import column, pieces


@dataclass
class Trees:
    """Complete binary trees: node i has children 2i + 1 and 2i + 2; the last level holds the leaves' values."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    value: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Logistic loss, second order; splits are sought in histograms over at most bins quantiles of each feature.

    A node that is not worth splitting keeps an infinite threshold, so all its rows go left.
    """
    n, width = x.shape if len(x) else (0, len(FEATURES))
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    code = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])  # code <= b means x <= cuts[b]
    margin = np.full(n, base)
    all_feature, all_threshold, all_value = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, int)
        for level in range(depth):
            first, size = 2**level - 1, 2**level
            at = node - first
            best = np.full(size, 1e-6)
            for j in range(width):
                if not len(cuts[j]):
                    continue
                cell = at * bins + code[:, j]
                gs = np.bincount(cell, g, size * bins).reshape(size, bins).cumsum(1)
                hs = np.bincount(cell, h, size * bins).reshape(size, bins).cumsum(1)
                gr, hr = gs[:, -1:] - gs, hs[:, -1:] - hs
                gain = gs**2 / (hs + l2) + gr**2 / (hr + l2) - gs[:, -1:] ** 2 / (hs[:, -1:] + l2)
                gain[(hs < least) | (hr < least)] = 0
                gain = gain[:, : len(cuts[j])]
                b = gain.argmax(1)
                top = gain[np.arange(size), b]
                for k in np.flatnonzero(top > best):
                    best[k], all_feature[t, first + k], all_threshold[t, first + k] = top[k], j, cuts[j][b[k]]
            node = 2 * node + 1 + (x[np.arange(n), all_feature[t, node]] > all_threshold[t, node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        all_value[t] = -rate * gs / (hs + l2)
        margin += all_value[t][leaf]
    return Trees(all_feature, all_threshold, all_value, base)


def held_out(doc_id: Column, folds: int = 3) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 1


def labelled(labels_df: DataFrame, label: str = "quality") -> DataFrame:
    """One label for each document: the majority of its labels that are not null, a tie as 0."""
    return (
        labels_df.where(F.col(f"`{label}`").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("l_doc_id"))
        .agg((F.avg(F.col(f"`{label}`")) > 0.5).cast("int").alias("label"))
    )


def training_rows(docs: DataFrame, labels_df: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id") -> DataFrame:
    """l_doc_id, label of the labelled documents to learn from: max_rows at most, so that they can be broadcast.

    Only ids are read to find them.
    """
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("p_id"))
    marks = labelled(labels_df).where(~held_out(F.col("l_doc_id")))
    chosen = hashed_sample(keep(marks.join(ids, F.col("l_doc_id") == F.col("p_id"), "left_semi").withColumnRenamed("l_doc_id", "doc_id")), max_rows, "label")
    rows = [(int(i), int(y)) for i, y in zip(chosen["doc_id"], chosen["label"], strict=True)]
    return docs.sparkSession.createDataFrame(rows, "l_doc_id long, label int")


def train_from(stats: DataFrame, chosen: DataFrame, max_rows: int = 20_000, **options) -> Trees:
    """The trees of the chosen rows' statistics; where documents share an id, max_rows of their rows at most."""
    rows = stats.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_doc_id"))
    train = hashed_sample(keep(rows.select("doc_id", "label", *FEATURES)), max_rows, "label", *FEATURES)
    return fit_trees(train[list(FEATURES)].to_numpy(float), train["label"].to_numpy(float), **options)


def score_stats(stats: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of document_stats."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x = np.column_stack([np.asarray(batch.column(i)) for i in range(1, batch.num_columns)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    scored = stats.select("doc_id", *FEATURES).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_classifier(docs: DataFrame, labels_df: DataFrame, max_rows: int = 20_000, **options) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""
    stats = keep(document_stats(docs))
    return score_stats(stats, train_from(stats, training_rows(stats, labels_df, max_rows), max_rows, **options))


def keep_good(docs: DataFrame, labels_df: DataFrame, max_rows: int = 20_000, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that the classifier takes for good (score >= 0.5), with docs' own columns; texts stay where they are.

    Of the first reading, only the texts to learn from are measured.
    """
    chosen = training_rows(docs, labels_df, max_rows)
    some = docs.join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("l_doc_id"), "left_semi")
    model = train_from(document_stats(some, text_col), chosen, max_rows, **options)
    at = docs.columns.index(text_col)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for t in pieces(column(batch.column(at))):
                good = model.score(features(measure(t))) >= 0.5
                yield batch.slice(t.first, len(t)).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_classifier(spark, sf_dir):
    return quality_classifier(documents(spark, sf_dir), labels(spark, sf_dir))
