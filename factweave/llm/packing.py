"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Documents longer than a bin are cut into full bins and a rest; rests and short documents are packed. Two items may share a
bin only if they come from different sources and from different duplicate clusters (equal texts). Within a shard, items
come largest first; the open bins are ordered by residual, each with a bitmap of its sources and one of its clusters; the
search goes from the smallest residual that fits to its successors until it meets the tightest bin with neither bit set,
and opens a bin only if there is none.

Shards are packed apart: a document's shard is a hash of its id over as many shards as give about shard_rows rows each, so
sources and clusters of any size spread evenly, a task holds the narrow rows of one shard (id, source, cluster, length; no
text), and bins never span shards. The loss is at most a few part-filled bins for each shard. Equal rows are counted and
numbered, and the number takes part in the hash: the bins do not depend on how the input is partitioned.

Sources of a shard are numbered by frequency, clusters only where a cluster has two items in the shard: bitmaps are Python
integers of any width. The open bins are kept in groups by which of the HOT most frequent sources they hold, so an item of a
hot source passes by the bins that hold it at one look for each group; the others are met, and passed, one by one.

Cases: null and empty texts have no tokens and take no room, but their conflicts hold (all empty texts are one cluster); null
source is a source; a null cluster is in conflict with nothing; null doc_id is kept and hashed as 0; repeated rows are items of one cluster; a token count that is null
or negative counts as 0; extra columns are ignored; empty table -> no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import documents, keep, n_words

CAPACITY = 2048
#: Sources by which open bins are grouped.
HOT = 3


class Bins:
    """Open bins, in groups by their hot sources; each group is sorted by (residual, bin)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.sources: list[int] = []  # bitmaps of each bin
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin and offset of an item; source and cluster are bitmaps (0: no conflict is possible)."""
        best: tuple[int, int] | None = None
        for hot, group in self.groups.items():
            if hot & source:
                continue
            i = bisect_left(group, (size, -1))
            while i < len(group) and (best is None or group[i] < best):  # the next tightest, until one is compatible
                b = group[i][1]
                if not self.sources[b] & source and not self.clusters[b] & cluster:
                    best = group[i]
                    break
                i += 1
        if best is None:
            best = (self.capacity, len(self.clusters))
            self.sources.append(0)
            self.clusters.append(0)
        else:
            group = self.groups[self.sources[best[1]] & _HOT]
            del group[bisect_left(group, best)]
        residual, b = best
        self.sources[b] |= source
        self.clusters[b] |= cluster
        insort(self.groups[self.sources[b] & _HOT], (residual - size, b))
        return b, self.capacity - residual


_HOT = (1 << HOT) - 1


def pack(items: list[tuple[int, str | None, bytes, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, piece, bin, offset, tokens) for items of (doc_id, source, cluster, tokens); bins are numbered from 0.

    Items come in by falling size of what is to be packed, then doc_id, source and cluster.
    """
    sources = {s: 1 << i for i, (s, _) in enumerate(Counter(x[1] for x in items).most_common())}
    counts = Counter(x[2] for x in items)
    twins = {c: 1 << i for i, c in enumerate(c for c, n in counts.items() if n > 1 and c is not None)}
    out, rests, full = [], [], 0
    for i, (_, _, _, size) in enumerate(items):
        pieces = max(0, -(-size // capacity) - 1)
        for p in range(pieces):
            out.append((i, p, full, 0, capacity))
            full += 1
        rests.append((size - pieces * capacity, i, pieces))
    rests.sort(key=lambda r: (-r[0], items[r[1]][0] if items[r[1]][0] is not None else -1, items[r[1]][1] or "", items[r[1]][2] or b""))
    bins = Bins(capacity)
    for size, i, p in rests:
        b, offset = bins.place(size, sources[items[i][1]], twins.get(items[i][2], 0))
        out.append((i, p, full + b, offset, size))
    return out


def packing(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = 4096) -> DataFrame:
    """doc_id, source, cluster, piece, shard, bin, offset, tokens; items has doc_id, source, cluster (binary), n_tokens.

    (shard, bin) names a bin.
    """
    names = ("doc_id", "source", "cluster", "n_tokens")
    rows = items.select(*names[:3], F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"))
    # Equal rows are told apart by a number of their own. The texts are read once.
    numbered = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("copies")).select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    rows = keep(numbered)
    shards = max(1, -(-rows.count() // shard_rows))
    shard = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("shard"), "source", "cluster", "n_tokens", "copy"), F.lit(shards)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            packed = pack(held, capacity)
            item = [held[i] for i, *_ in packed]
            cols = [[x[k] for x in item] for k in range(3)] + [[x[k] for x in packed] for k in range(1, 5)]
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            c = [pa.array(v, k) for v, k in zip(cols, kinds, strict=True)]
            shard = pa.array([now] * len(packed), pa.int32())
            return pa.RecordBatch.from_arrays([*c[:4], shard, *c[4:]], ["doc_id", "source", "cluster", "piece", "shard", "bin", "offset", "tokens"])

        for batch in batches:
            for s, *item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and s != now:
                    yield out()
                    held = []
                now = s
                held.append(tuple(item))
        if held:
            yield out()

    dealt = rows.select(shard.alias("shard"), *names).repartition("shard").sortWithinPartitions("shard", *names)
    return dealt.mapInArrow(run, "doc_id long, source string, cluster binary, piece int, shard int, bin int, offset long, tokens long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = 4096, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """packing() of documents: tokens are words, duplicate clusters are equal texts."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    items = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.unhex(F.md5(text)).alias("cluster"), n_words(text).alias("n_tokens")
    )
    return packing(items, capacity, shard_rows)


def op1_bestfit_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir)).select("doc_id", "piece", "shard", "bin", "offset", "tokens")
