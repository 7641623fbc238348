"""Quality rules: fixed base rules, then an isolation forest over rule statistics with a threshold from labelled rows.

Statistics of every whole text are measured once and kept in the checkpoint folder. The forest is grown on the driver from
about sample_rows documents (default 25,600, chosen by a hash of doc_id): trees times subsample rows, the bound of the
published method. All labelled rows that pass the base rules are then scored on the executors and counted in a histogram
of scores by label; the threshold is the score that separates the labels best (hit rate less false alarms) among those
that reject at most max_false of the rows labelled good.

Cases: null and empty texts have no words and fail the base rule; no labelled rows -> the threshold is 0.6, the usual
reading of the score; null doc_id is kept as null; extra columns are ignored; empty table -> no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_classifier import labelled
from .stats import COUNTS, FEATURES, document_stats
from .tables import documents, hashed_sample, keep, labels

#: What the forest splits on: rule statistics that do not follow a text's length.
RULES = (
    "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "punct_ratio",
    "ended_ratio", "capital_ratio", "short_ratio", "bar_ratio", "line_words", "run_ratio",
)
BUCKETS = 1000


def _usual(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of an unsuccessful search among n values."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


@dataclass
class Forest:
    """Complete binary trees; depth_of is the path length that a row ends with at each node of the last level."""

    feature: np.ndarray
    threshold: np.ndarray
    length: np.ndarray  # trees x leaves
    subsample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / usual path length): near 1 for rows that few random splits set apart."""
        total, rows, inner = np.zeros(len(x)), np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, length in zip(self.feature, self.threshold, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] >= threshold[node])
            total += length[node - inner]
        return 2.0 ** (-total / max(1, len(self.length)) / max(float(_usual(self.subsample)), 1e-9))


def grow(x: np.ndarray, trees: int = 100, subsample: int = 256, seed: int = 7) -> Forest:
    """Isolation trees: each node splits a random feature that varies there at a random value between its extremes."""
    rng = np.random.default_rng(seed)
    subsample = min(subsample, len(x))
    depth = max(1, int(np.ceil(np.log2(max(subsample, 2)))))
    inner = 2**depth - 1
    feature, threshold, length = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees if len(x) else 0):
        members = {0: rng.choice(len(x), subsample, replace=False)}
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = members.pop(node, np.zeros(0, int))
                low, high = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
                varied = np.flatnonzero(high > low)
                if len(rows) > 1 and len(varied):
                    j = rng.choice(varied)
                    cut = rng.uniform(low[j], high[j])
                    feature[t, node], threshold[t, node] = j, cut
                    right = x[rows, j] >= cut
                    members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
                else:  # settled here: every row that comes by goes left to one leaf
                    leaf = node
                    for _ in range(depth - level):
                        leaf = 2 * leaf + 1
                    length[t, leaf - inner] = level + float(_usual(len(rows)))
        for node, rows in members.items():
            length[t, node - inner] = depth + float(_usual(len(rows)))
        # Leaves that no training row reached, below a settled node, are not reached by others either (threshold inf).
    return Forest(feature, threshold, length, subsample)


def calibrate(counts: np.ndarray, max_false: float = 0.01) -> float:
    """The threshold from a histogram of scores (BUCKETS x labels bad, good); rows above it are rejected."""
    if not counts.sum(0).all():
        return 0.6
    above = counts[::-1].cumsum(0)[::-1] / counts.sum(0)
    gain = np.where(above[:, 1] <= max_false, above[:, 0] - above[:, 1], -1)
    best = np.flatnonzero(gain == gain.max())  # in the middle of the best ones, away from either label's rows
    return float(best[len(best) // 2] / BUCKETS) if gain.max() > 0 else 1.0


def quality_rules(docs: DataFrame, labels_df: DataFrame, sample_rows: int = 25_600, max_false: float = 0.01) -> DataFrame:
    """doc_id, the base counts, base_failed, anomaly (the forest's score), kept: one row for each row of docs."""
    stats = keep(document_stats(docs))
    sample = hashed_sample(stats, sample_rows, *RULES)
    forest = grow(sample[list(RULES)].to_numpy(float))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 1 + len(COUNTS[:5])
        for batch in rows:
            x = np.column_stack([np.asarray(batch.column(i)) for i in range(n, batch.num_columns)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(forest.score(x))], ["doc_id", *COUNTS[:5], "anomaly"])

    schema = ", ".join(["doc_id long", *(f"{k} long" for k in COUNTS[:5]), "anomaly double"])
    scored = stats.select("doc_id", *COUNTS[:5], *RULES).mapInArrow(run, schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    bucket = F.least(F.floor(F.col("anomaly") * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    counts = np.zeros((BUCKETS, 2))
    for row in scored.where(~failed).join(labelled(labels_df), F.col("doc_id") == F.col("l_doc_id")).groupBy(bucket.alias("bucket"), "label").count().collect():
        counts[row["bucket"], row["label"]] += row["count"]
    threshold = calibrate(counts, max_false)
    return scored.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & (F.col("anomaly") < threshold)).alias("kept"), "anomaly")


def op3_quality_rules(spark, sf_dir):
    return quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))
