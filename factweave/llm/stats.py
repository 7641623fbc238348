"""Statistics of whole texts that the quality rules (op3) and the quality classifier (op5) read.

One pass over the text column in Arrow batches; a batch is worked on in pieces of about a megabyte, so a task needs
memory for one batch of text and one piece, whatever the table's size. Words, windows and lines are compared by their
bytes. Null and empty texts have zero counts; repeated rows, rows that share an id and rows without one are measured each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcols import Spans, Texts, code_points, column, exact_grams, gram_mask, lines, per_text, pieces, symbols, words

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_points", "n_lines", "n_upper", "n_digits",
    "n_punct", "n_high", "n_distinct", "n_ended", "n_capital", "n_text_lines", "n_short_words", "n_long_words", "n_runs",
)
FEATURES = (
    "log_words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio",
    "punct_ratio", "high_ratio", "distinct_ratio", "ended_ratio", "capital_ratio", "line_words", "short_ratio",
    "long_ratio", "byte_entropy", "run_ratio", "bar_ratio",
)
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_PUNCT = np.frombuffer(b".,;:!?", np.uint8)


def _different(text: np.ndarray, number: np.ndarray, width: int, n: int) -> np.ndarray:
    """How many different numbers (below width) each of n texts has."""
    x = np.sort(text * width + number)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.bincount(x[new] // max(1, width), minlength=n)


def measure(t: Texts) -> dict[str, np.ndarray]:
    """Counts of each text, and its byte entropy in bits."""
    n, lens = len(t), np.diff(t.offsets)
    owner = np.repeat(np.arange(n), lens)
    by_byte = np.bincount(owner * 256 + t.data, minlength=n * 256).reshape(n, 256)
    share = by_byte / np.maximum(lens, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    s = words(t)
    points = code_points(t)
    number, one = symbols(t, s)
    n_distinct = _different(s.text, number, len(one), n)
    at = np.flatnonzero(gram_mask(s, 3))
    g = exact_grams(number, 3)[at] if len(at) else at
    # Equal windows in order of place, so those of one text lie together.
    order = np.argsort(g, kind="stable")
    g, owner3 = g[order], s.text[at[order]]
    twin = np.zeros(len(g) + 1, bool)
    twin[1:-1] = (g[1:] == g[:-1]) & (owner3[1:] == owner3[:-1])
    again = at[order[twin[1:] | twin[:-1]]]
    cover = np.zeros(len(number) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 3, -1)
    repeated = np.cumsum(cover)[:-1] > 0
    ln = lines(t)
    ink = np.concatenate([[0], np.cumsum(np.bincount(s.start, minlength=len(t.data)) if len(t.data) else np.zeros(0, int))])
    full = ink[ln.end] > ink[ln.start]
    with_ink = Spans(ln.start[full], ln.end[full], ln.text[full], ln.bounds)
    line, lines_ = symbols(t, with_ink)
    n_full = np.bincount(with_ink.text, minlength=n)
    n_different = _different(with_ink.text, line, len(lines_), n)
    last = t.data[s.end - 1]
    head = t.data[s.start]
    width = points[s.end] - points[s.start]
    same = np.zeros(len(t.data), bool)
    if len(t.data) > 1:
        same[1:] = (t.data[1:] == t.data[:-1]) & (t.data[1:] != 0x20)
    same[t.offsets[:-1][lens > 0]] = False
    return {
        "n_words": s.counts,
        "word_chars": per_text(s.bounds, width),
        "n_symbols": by_byte[:, SYMBOLS].sum(1),
        "n_dup_lines": n_full - n_different,
        "n_repeat_words": per_text(s.bounds, repeated),
        "n_points": points[t.offsets[1:]] - points[t.offsets[:-1]],
        "n_lines": ln.counts,
        "n_upper": by_byte[:, 65:91].sum(1),
        "n_digits": by_byte[:, 48:58].sum(1),
        "n_punct": by_byte[:, _PUNCT].sum(1),
        "n_high": by_byte[:, 0xC0:].sum(1),
        "n_distinct": n_distinct,
        "n_ended": per_text(s.bounds, np.isin(last, _PUNCT)),
        "n_capital": per_text(s.bounds, (head >= 65) & (head <= 90)),
        "n_text_lines": n_full,
        "n_short_words": per_text(s.bounds, width <= 1),
        "n_long_words": per_text(s.bounds, width >= 16),
        "n_runs": per_text(t.offsets, same),
        "n_bars": by_byte[:, 124],
        "byte_entropy": entropy,
    }


def features(x: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios by text, one column for each of FEATURES; all are finite, for empty texts too."""
    f = {k: np.asarray(v, float) for k, v in x.items()}
    w, c, ln = (np.maximum(f[k], 1) for k in ("n_words", "n_points", "n_text_lines"))
    return np.column_stack(
        [
            np.log1p(f["n_words"]), f["word_chars"] / w, f["n_symbols"] / c, f["n_dup_lines"] / ln, f["n_repeat_words"] / w,
            f["n_upper"] / c, f["n_digits"] / c, f["n_punct"] / c, f["n_high"] / c, f["n_distinct"] / w, f["n_ended"] / w,
            f["n_capital"] / w, f["n_words"] / ln, f["n_short_words"] / w, f["n_long_words"] / w, f["byte_entropy"],
            f["n_runs"] / c, f["n_bars"] / c,
        ]
    )


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = (*COUNTS[:5], *FEATURES)
    for batch in rows:
        ids = batch.column(0)
        for t in pieces(column(batch.column(1))):
            x = measure(t)
            f = features(x)
            cols = [ids.slice(t.first, len(t)), *(pa.array(x[k].astype(np.int64)) for k in COUNTS[:5]), *(pa.array(f[:, i]) for i in range(len(FEATURES)))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *names])


def document_stats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, the five base counts (long) and FEATURES (double), one row for each row of docs; other columns are left out."""
    schema = ", ".join(["doc_id long", *(f"{k} long" for k in COUNTS[:5]), *(f"{k} double" for k in FEATURES)])
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_batches, schema)
