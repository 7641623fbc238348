"""Substring de-duplication: words covered by a 20-word window that also begins earlier are removed.

A compressed FM-index per shard, where a shard holds whatever can match: every window belongs to the shard of its
minimiser (the smallest hash of its 7-grams), so equal windows always meet and no document is compared with every shard.

1. Each text is cut into segments, runs of consecutive windows with the same minimiser. Minimisers are counted in their
   shards; a task sends one row for a minimiser, with a count if it has several places. Only the segments whose
   minimiser has two places or more go on.
2. These segments' words are fetched by a join with the documents. Each task builds a wavelet-tree FM-index of the segments
   that share a minimiser among those it holds, streams them through backward search, and reads matching statistics: a
   window whose statistic reaches 20 words stands in all places of its interval, and all but the earliest are repeats. What
   is not a repeat yet goes, as text, to the minimiser's shard, where an index of all tasks' segments is searched in the same
   way.
   The windows of a minimiser that has more than hot_segments places and a millionth of all places are sent one by one to
   the shard of the window's own hash (the list of such minimisers, at most a million, goes to all tasks). A common passage
   so arrives once from each batch of a task, and the windows around a common phrase spread over all shards.
3. The repeats of each document are joined with its text and the covered words dropped.

Windows are judged on the input. Hashes only say where segments meet; there, words are compared by their bytes. "Earlier" means
a smaller doc_id (null counts as the largest), then a smaller hash of the text, then an earlier start.

Memory: a task holds BATCH_BYTES of segments, a shard about SHARD_BYTES; the number of shards follows from the data. An index
holds INDEX_BYTES, all segments of its minimisers among them.

Cases: null and empty texts and texts under 20 words lose nothing; rows that share a doc_id, or have none, are documents of
their own, told apart by a hash of the text; repeated rows (same id and text) are one place, so neither removes the other;
extra columns are ignored; empty table -> no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .tables import documents, keep
from .textcols import Texts, column, gram_mask, grams, hashes, mix, pieces, ranges, symbols, words

WINDOW, GRAM = 20, 7
#: Text of so many bytes is gathered before its minimisers are sent off, and of segments before they are searched.
BATCH_BYTES = 16 << 20
#: Bytes of places, or of segments, that a shard holds on average.
SHARD_BYTES = 16 << 20
#: Bytes of segments that one index holds, unless one minimiser has more: small enough for a processor's cache.
INDEX_BYTES = 1 << 20
#: Windows that are searched at once.
AT_ONCE = 1 << 15
MOST_HOT = 1_000_000
_NULL_ID = np.iinfo(np.int64).max
_PLACE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("rid", "<i8"), ("start", "<i4"), ("n", "<i4"), ("kind", "<i1")])
#: Kinds of a place: the only one of its key in its batch, a count of several (n), one of several.
ONE, COUNT, SEVERAL = 0, 1, 2
_SEGMENT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("rid", "<i8"), ("start", "<i4"), ("n", "<i4"), ("size", "<i4")])


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values."""
    m, w = x, 1
    while 2 * w <= width:
        m, w = np.minimum(m[:-w], m[w:]), 2 * w
    return np.minimum(m[: len(x) - width + 1], m[width - w :]) if w < width else m


def _starts(*by: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.ones(len(by[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in by])
    return np.flatnonzero(new)


def _segments(t: Texts, ids: np.ndarray, rids: np.ndarray) -> np.ndarray:
    """The segments of a piece, in order, as places; a text of fewer than WINDOW words has none.

    A segment in which its minimiser stands twice counts as several places.
    """
    s = words(t)
    ok = gram_mask(s, WINDOW)
    if not ok.any():
        return np.zeros(0, _PLACE)
    gram = grams(hashes(t, s), GRAM)
    low = _slide(gram, WINDOW - GRAM + 1)[: len(ok)]
    owner = s.text[: len(ok)]
    at = _starts(low, owner, ok)
    n = np.diff(np.append(at, len(ok)))[ok[at]]
    at = at[ok[at]]
    out = np.zeros(len(at), _PLACE)
    out["key"], out["doc"], out["rid"] = low[at], ids[t.first + owner[at]], rids[t.first + owner[at]]
    out["start"], out["n"] = at - s.bounds[owner[at]], n
    size = n + WINDOW - GRAM
    equal = gram[ranges(at, size)] == np.repeat(low[at], size)
    out["kind"][np.add.reduceat(equal, np.concatenate([[0], np.cumsum(size)[:-1]]), dtype=np.int64) > 1] = SEVERAL
    return out


def _in_shards(shard: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(shard, kind="stable")
    x, shard = x[order], shard[order]
    at = _starts(shard)
    blocks = [b.tobytes() for b in np.split(x, at[1:])] if len(x) else []
    return pa.RecordBatch.from_arrays([pa.array(shard[at].astype(np.int32)), pa.array(blocks, pa.binary())], ["shard", "block"])


def _by_shard(rows: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of each shard without it, from rows sorted by shard, their first column."""
    now, held = None, []
    for batch in rows:
        for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and shard != now:
                yield held
                held = []
            now = shard
            held.append(tuple(row))
    if held:
        yield held


def _send_places(shards: int):
    """Minimisers with their places, to their shards; columns id, rid, text."""

    def pack(x: np.ndarray) -> pa.RecordBatch:
        x = x[np.argsort(x["key"], kind="stable")]
        at = _starts(x["key"])
        count = np.diff(np.append(at, len(x)))
        many = (count > 1) | (np.add.reduceat(x["kind"] == SEVERAL, at, dtype=np.int64) > 0)
        x["kind"] = np.where(np.repeat(many, count), SEVERAL, ONE)
        sums = np.zeros(int(many.sum()), _PLACE)
        sums["key"], sums["n"], sums["kind"] = x["key"][at[many]], np.maximum(2, count[many]), COUNT
        x = np.concatenate([x, sums])
        # Places that are known to be shared only pass through, by way of any shard.
        return _in_shards((np.where(x["kind"] == SEVERAL, mix(x["rid"].view(np.uint64)), x["key"]) % np.uint64(shards)).astype(np.int64), x)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in rows:
            ids, rids = (batch.column(i).to_numpy() for i in range(2))
            for t in pieces(column(batch.column(2))):
                held.append(_segments(t, ids, rids))
                size += len(t.data)
                if size >= BATCH_BYTES:
                    if len(x := np.concatenate(held)):
                        yield pack(x)
                    held, size = [], 0
        if held and len(x := np.concatenate(held)):
            yield pack(x)

    return run


def _meet(hot_segments: int):
    """Places of minimisers that have several, and (start -1, n places) the minimisers of more than hot_segments places."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _by_shard(rows):
            x = np.frombuffer(b"".join(b for (b,) in blocks), _PLACE)
            known, x = x[x["kind"] == SEVERAL], x[x["kind"] != SEVERAL]
            _, at, = np.unique(x["key"], return_inverse=True)
            places = np.bincount(at, np.where(x["kind"] == COUNT, x["n"], 1)).astype(np.int64)
            first = np.zeros(len(places), np.int64)
            first[at] = np.arange(len(x))
            hot = x[first[places > hot_segments]].copy()
            hot["start"], hot["n"] = -1, np.minimum(places[places > hot_segments], np.iinfo(np.int32).max)
            out = np.concatenate([known, x[(places[at] > 1) & (x["kind"] == ONE)], hot])
            names = ("doc", "rid", "start", "n")
            yield pa.RecordBatch.from_arrays([*(pa.array(out[k]) for k in names), pa.array(out["key"].view(np.int64))], ["id", "rid", "start", "n", "key"])

    return run


def _alike(text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each window (WINDOW symbols from start on) one with the same symbols, itself or another."""
    h = grams(mix(text.astype(np.uint64)), WINDOW)[start]
    order = np.argsort(h)
    at = _starts(h[order])
    like = np.empty(len(start), np.int64)
    like[order] = np.repeat(order[at], np.diff(np.append(at, len(order))))
    other = np.flatnonzero(like != np.arange(len(start)))
    mine, theirs = start[other], start[like[other]]
    same = np.ones(len(other), bool)
    for k in range(WINDOW):
        same &= text[mine + k] == text[theirs + k]
    like[other[~same]] = other[~same]
    return like


def windows(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the segments: its segment, and its number in it."""
    n = place["n"].astype(np.int64)
    return np.repeat(np.arange(len(place)), n), ranges(np.zeros(len(place), np.int64), n)


def search(place: np.ndarray, t: Texts) -> np.ndarray:
    """Whether each window of the segments (place i has the words of text i) also begins earlier in them.

    A window at the very place of the earliest one (a repeated row of the table) is not a repeat. Equal windows have equal
    keys, so the segments are indexed in parts of INDEX_BYTES by their keys.
    """
    late = np.zeros(int(place["n"].sum()), bool)
    first = np.concatenate([[0], np.cumsum(place["n"], dtype=np.int64)])
    part = (mix(place["key"]) % np.uint64(-(-len(t.data) // INDEX_BYTES) or 1)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    for own in np.split(order, _starts(part[order])[1:]) if len(order) else []:
        late[ranges(first[own], place["n"][own].astype(np.int64))] = _repeats(place[own], _cut(t, t.offsets[own], t.offsets[own + 1]))
    return late


def _repeats(place: np.ndarray, t: Texts) -> np.ndarray:
    s = words(t)
    number, one = symbols(t, s)
    size = place["n"].astype(np.int64) + WINDOW - 1
    begin = np.concatenate([[0], np.cumsum(size)])
    text = np.zeros(len(number) + len(place), np.int64)
    text[np.arange(len(number)) + np.repeat(np.arange(len(place)), size)] = number + 1
    index = FMIndex(text, len(one) + 1, WINDOW)
    owner, offset = windows(place)
    start = begin[owner] + owner + offset
    like = _alike(text, start)
    asked = np.flatnonzero(like == np.arange(len(start)))  # a pattern that occurs several times is searched once
    interval = np.full(len(start), -1, np.int64)
    for i in range(0, len(asked), AT_ONCE):
        some = asked[i : i + AT_ONCE]
        length, low, _ = index.matching_statistics(text, start[some] + WINDOW, WINDOW, 2)
        interval[some] = np.where(length == WINDOW, low, -1)
    interval = interval[like]
    hit = np.flatnonzero(interval >= 0)
    doc, rid, start = place["doc"][owner[hit]], place["rid"][owner[hit]], place["start"][owner[hit]] + offset[hit]
    order = np.lexsort((start, rid, doc, interval[hit]))
    at = _starts(interval[hit][order])
    lead = np.repeat(order[at], np.diff(np.append(at, len(order))))
    late = np.zeros(len(owner), bool)
    late[hit[order]] = (doc[order] != doc[lead]) | (rid[order] != rid[lead]) | (start[order] != start[lead])
    return late


def _runs(place: np.ndarray, owner: np.ndarray, offset: np.ndarray, chosen: np.ndarray, single: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of chosen windows as segments, and each one's segment; a segment in single is cut into its windows."""
    w = np.flatnonzero(chosen)
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1] + 1) | (owner[w[1:]] != owner[w[:-1]])
    if single is not None:
        new |= single[owner[w]]
    at = np.flatnonzero(new)
    own, first = owner[w[at]], offset[w[at]]
    out = np.zeros(len(at), _SEGMENT)
    out["doc"], out["rid"], out["start"], out["n"] = place["doc"][own], place["rid"][own], place["start"][own] + first, np.diff(np.append(at, len(w)))
    return out, own


def _cut(t: Texts, start: np.ndarray, end: np.ndarray) -> Texts:
    """The byte ranges as texts."""
    size = end - start
    return Texts(t.data[ranges(start, size)], np.concatenate([[0], np.cumsum(size)]))


def _send_words(shards: int, hot: np.ndarray):
    """Searches the asked segments of each batch; repeats go on as segments without text, the rest to shards with it."""

    def sent(place: np.ndarray, t: Texts) -> pa.RecordBatch:
        owner, offset = windows(place)
        late = np.zeros(len(owner), bool)
        _, at, count = np.unique(place["key"], return_inverse=True, return_counts=True)
        if len(met := np.flatnonzero(count[at] > 1)):  # a minimiser with one segment here has its repeats elsewhere
            late[np.isin(owner, met)] = search(place[met], _cut(t, t.offsets[met], t.offsets[met + 1]))
        repeats, _ = _runs(place, owner, offset, late)
        is_hot = np.isin(place["key"], hot)
        rest, own = _runs(place, owner, offset, ~late, is_hot)
        s = words(t)
        first = s.bounds[own] + rest["start"] - place["start"][own]
        last = first + rest["n"] + WINDOW - 2
        part = _cut(t, s.start[first], s.end[last])
        rest["size"] = np.diff(part.offsets)
        whole = grams(hashes(t, s), WINDOW)
        key = np.where(is_hot[own], whole[np.minimum(first, max(0, len(whole) - 1))] if len(whole) else np.uint64(0), place["key"][own])
        rest["key"] = key
        shard = np.concatenate([(key % np.uint64(shards)), mix(repeats["rid"].view(np.uint64)) % np.uint64(shards)]).astype(np.int64)
        both = np.concatenate([rest, repeats])
        start = np.concatenate([part.offsets[:-1], np.full(len(repeats), part.offsets[-1])])
        order = np.argsort(shard, kind="stable")
        at = _starts(shard[order])
        blocks, texts = [], []
        for rows in np.split(order, at[1:]) if len(order) else []:
            blocks.append(both[rows].tobytes())
            texts.append(part.data[ranges(start[rows], both["size"][rows].astype(np.int64))].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(shard[order][at].astype(np.int32)), pa.array(blocks, pa.binary()), pa.array(texts, pa.binary())], ["shard", "places", "texts"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, Texts]] = []
        size = 0

        def out() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(t.offsets) for _, t in held]))])
            return sent(np.concatenate([p for p, _ in held]), Texts(np.concatenate([t.data for _, t in held]), offsets))

        for batch in rows:
            ids, rids, asked = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            bounds, flat = asked.offsets.to_numpy() - asked.offsets[0].as_py(), asked.flatten()
            ask = {k: flat.field(k).to_numpy() for k in ("start", "n", "key")}
            for t in pieces(column(batch.column(2))):
                s = words(t)
                lo, hi = bounds[t.first], bounds[t.first + len(t)]
                owner = np.repeat(np.arange(len(t)), np.diff(bounds[t.first : t.first + len(t) + 1]))
                start, n, key = (ask[k][lo:hi] for k in ("start", "n", "key"))
                at = s.bounds[owner] + start
                first, last = s.start[at], s.end[at + n + WINDOW - 2]
                i = 0
                while i < len(at):  # a long text's segments in several batches
                    j = max(i + 1, int(np.searchsorted(np.cumsum(last[i:] - first[i:]), BATCH_BYTES - size, "right")) + i)
                    place = np.zeros(j - i, _PLACE)
                    place["key"], place["doc"], place["rid"] = key[i:j].view(np.uint64), ids[t.first + owner[i:j]], rids[t.first + owner[i:j]]
                    place["start"], place["n"] = start[i:j], n[i:j]
                    part = _cut(t, first[i:j], last[i:j])
                    held.append((place, part))
                    size += len(part.data)
                    if size >= BATCH_BYTES or j < len(at):
                        yield out()
                        held, size = [], 0
                    i = j
        if held:
            yield out()

    return run


def _spans(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[k]) for k in ("doc", "rid", "start", "n")], ["id", "rid", "start", "n"])


def _compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeats that a shard's segments show, and those found before."""
    for blocks in _by_shard(rows):
        x = np.frombuffer(b"".join(p for p, _ in blocks), _SEGMENT)
        known, x = x[x["size"] == 0], x[x["size"] > 0]
        yield _spans(known)
        if len(x):
            t = Texts(np.frombuffer(b"".join(w for _, w in blocks), np.uint8), np.concatenate([[0], np.cumsum(x["size"], dtype=np.int64)]))
            yield _spans(_runs(x, *windows(x), search(x, t))[0])


def repeated_spans(docs: DataFrame, hot_segments: int = 5000) -> DataFrame:
    """id, rid, start, n: n consecutive windows from word start on that also begin earlier; docs has id, rid, text."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(least, -(-size // SHARD_BYTES))
    sent = docs.select("id", "rid", "text").mapInArrow(_send_places(shards), "shard int, block binary")
    met = keep(sent.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(_meet(hot_segments), "id long, rid long, start int, n int, key long"))
    places, total = met.where("start >= 0").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") + WINDOW), F.lit(0))).first()
    least_hot = max(hot_segments, places // MOST_HOT)
    hot = np.array([r[0] for r in met.where((F.col("start") < 0) & (F.col("n") > least_hot)).select("key").collect()], np.int64).view(np.uint64)
    asked = met.where("start >= 0").groupBy(F.col("id").alias("a_id"), F.col("rid").alias("a_rid")).agg(F.collect_list(F.struct("start", "n", "key")).alias("asked"))
    fetched = docs.join(asked, (F.col("id") == F.col("a_id")) & (F.col("rid") == F.col("a_rid"))).select("id", "rid", "text", "asked")
    shards = max(least, -(-total * 8 // SHARD_BYTES))
    searched = fetched.mapInArrow(_send_words(shards, hot), "shard int, places binary, texts binary")
    return searched.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(_compare, "id long, rid long, start int, n int")


def _kept_texts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, n_removed, text from id, text, spans."""
    for batch in rows:
        spans = batch.column(2)
        bounds, flat = spans.offsets.to_numpy() - spans.offsets[0].as_py(), spans.flatten()
        start, n = (flat.field(k).to_numpy().astype(np.int64) for k in ("start", "n"))
        ids = pa.array(batch.column(0).to_numpy(), mask=batch.column(0).to_numpy() == _NULL_ID)
        for t in pieces(column(batch.column(1))):
            s = words(t)
            lo, hi = bounds[t.first], bounds[t.first + len(t)]
            at = s.bounds[np.repeat(np.arange(len(t)), np.diff(bounds[t.first : t.first + len(t) + 1]))] + start[lo:hi]
            cover = np.zeros(len(s.start) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n[lo:hi] + WINDOW - 1, -1)
            stays = np.cumsum(cover)[:-1] == 0
            size = s.end[stays] - s.start[stays] + 1  # and a space
            out = t.data[np.minimum(ranges(s.start[stays], size), max(0, len(t.data) - 1))] if len(size) else np.zeros(0, np.uint8)
            edge = np.concatenate([[0], np.cumsum(size)])
            out[edge[1:] - 1] = 0x20
            left = np.concatenate([[0], np.cumsum(stays)])[s.bounds]
            raw = out.tobytes()
            texts = [raw[a : max(a, b - 1)] for a, b in zip(edge[left[:-1]].tolist(), edge[left[1:]].tolist(), strict=True)]
            cols = [ids.slice(t.first, len(t)), pa.array(s.counts), pa.array(s.counts - np.diff(left)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "text"])


def _digests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _kept_texts(rows):
        digest = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _joined(docs: DataFrame, hot_segments: int, text_col: str, id_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(int(_NULL_ID))).alias("id"), F.xxhash64(text).alias("rid"), text.alias("text"))
    spans = repeated_spans(docs, hot_segments).groupBy(F.col("id").alias("s_id"), F.col("rid").alias("s_rid")).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    none = F.array().cast("array<struct<start: int, n: int>>")
    return docs.join(spans, (F.col("id") == F.col("s_id")) & (F.col("rid") == F.col("s_rid")), "left").select("id", "text", F.coalesce("spans", none).alias("spans"))


def substring_dedup(docs: DataFrame, hot_segments: int = 5000, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words joined by one space), one row for each row of docs."""
    return _joined(docs, hot_segments, text_col, id_col).mapInArrow(_kept_texts, "doc_id long, n_words long, n_removed long, text string")


def op10_substring_dedup(spark, sf_dir):
    """The same, with the digest of the kept text in its place."""
    return _joined(documents(spark, sf_dir), 5000, "text", "doc_id").mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


SQL = {
    "op10_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth
  FROM (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS win FROM p)
), g AS (
  SELECT DISTINCT doc_id, i + k AS i FROM f, (SELECT unnest(range(20)) AS k) WHERE nth > 1
), l AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), k AS (
  SELECT l.doc_id, count(*) FILTER (WHERE g.i IS NOT NULL) AS n_removed,
         string_agg(l.word, ' ' ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS kept
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
}
