"""MinHash near-duplicates by a multi-index Hamming join, confirmed on whole shingle sets.

1. Each text's set of 5-word shingles becomes a signature of HASHES values of 16 bits. Equal sets are folded into their
   smallest doc_id; from here on only one document of each different set takes part.
2. Pigeonhole: signatures of CHUNKS chunks that differ in at most MOST_ERRORS values have a chunk with at most
   CHUNK_ERRORS errors. Each chunk therefore yields one key for every way of leaving CHUNK_ERRORS of its values out, and
   all pairs within the threshold share a key. At a similarity of 0.75 a pair has 16 differing values on average; more
   than 31 of 64 is beyond four standard deviations.
3. Inside a key's documents the distance is computed in rounds of comparison with a leader, then between the members of
   different leaders; what comes out is at most one edge a document and one near pair for two leaders, never all pairs, and each
   under the first key that its ends share.
4. Components of these edges are candidate families. A family's whole texts meet, intersections are counted exactly through
   an inverted index of the shingles, and the links with 100 * intersection >= 75 * union are joined into the components
   that count. Shingles are compared word by word, not by hashes.

A key or family of more than `block` documents (or of more than BLOCK_SHINGLES shingles, for whole texts) is dealt into
blocks. Each block meets the smallest document as well; what it connects with that document is settled there, which is
linear in the group. Distances obey the triangle inequality (signatures: Hamming; sets: Jaccard), so a document that is not
settled can only be near those whose distance from the smallest document is within the threshold of its own: only these
meet again, in pairs of blocks. Every key, family and document is handled; there are no caps.

Cases: null and empty texts have an empty set and are linked with nothing; fewer than five words make one shingle of all;
a null doc_id is a document of its own, told apart from others by its text, and larger than any id (a component of such
documents alone has a null component_id; ids must be below 2**62); rows that share a doc_id are one node of the graph;
repeated rows are equal sets; extra columns are ignored; empty table -> no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import documents, keep, with_groups
from .textcols import _WEIGHTS, Texts, column, exact_grams, gram_mask, lowered, mix, pieces, ranges, shingle_sets, symbols, words

HASHES, CHUNKS, CHUNK_ERRORS = 64, 16, 1
MOST_ERRORS = CHUNKS * (CHUNK_ERRORS + 1) - 1
#: Shingles of a family's texts that meet in one task, unless one text has more.
BLOCK_SHINGLES = 1 << 21
#: Rows of a key, an id and a count that may be broadcast (24 bytes each).
MOST_BROADCAST = 200_000
#: Nodes from here on are documents without an id.
NO_ID = 1 << 62
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signatures(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16-bit MinHash values (sets x HASHES) of sorted sets g[bounds[i]:bounds[i + 1]]; zeros for empty sets."""
    out = np.zeros((len(bounds) - 1, HASHES), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        x, at = (g >> np.uint64(32)).astype(np.uint32), bounds[full]
        for i in range(HASHES):
            low = np.minimum.reduceat(x * _A[i] + _B[i], at)
            out[full, i] = ((low ^ (low >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """One key for each chunk and each choice of values left out (sets x keys)."""
    width = HASHES // CHUNKS
    s = sig.astype(np.uint64).reshape(len(sig), CHUNKS, width)
    keys = []
    for k, out in enumerate(combinations(range(width), CHUNK_ERRORS)):
        kept = [j for j in range(width) if j not in out]
        code = np.zeros(s.shape[:2], np.uint64)
        for j in kept:
            code = (code << np.uint64(16)) | s[:, :, j]
        keys.append(mix(code * _WEIGHTS[0] + (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(64) + np.uint64(k + 1)) * _WEIGHTS[1]))
    return np.concatenate(keys, axis=1)


def _profile(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for t in pieces(column(batch.column(1))):
            g, bounds = shingle_sets(t)
            total = [np.concatenate([[np.uint64(0)], np.cumsum(mix(g ^ np.uint64(c)))]) for c in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]
            h1, h2 = ((x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in total)
            sig = signatures(g, bounds)
            cols = [batch.column(0).slice(t.first, len(t)), pa.array(np.diff(bounds)), pa.array(h1), pa.array(h2), pa.array([r.tobytes() for r in sig], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "h1", "h2", "sig"])


def _matrix(x: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), dtype).reshape(len(x), width)


def _emit_keys(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        keys = chunk_keys(_matrix(batch.column(1), np.uint16, HASHES))
        ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "id"])


def near_edges(group: np.ndarray, ids: np.ndarray, low: np.ndarray, at_once: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, row) that connect, in each group (rows sorted by group), what a chain of distances of MOST_ERRORS or less connects.

    The ends of every edge are within MOST_ERRORS themselves; first_shared relies on that.

    low: one byte of each signature value, so the distance here is never more than the true one.
    """
    n = len(ids)
    leader = np.full(n, -1)
    us, vs = [], []
    rest = np.arange(n)
    while len(rest):  # each round, the first unled row of each group leads
        new = np.ones(len(rest), bool)
        new[1:] = group[rest[1:]] != group[rest[:-1]]
        head = rest[np.flatnonzero(new)[np.cumsum(new) - 1]]
        near = (low[rest] != low[head]).sum(1) <= MOST_ERRORS
        leader[rest[near]] = head[near]
        us.append(head[near])
        vs.append(rest[near])
        rest = rest[~near]
    # Left to compare: a led row with rows of other leaders of its group (leaders are compared with all that follow them).
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, int)
    size = np.diff(np.append(cut, n))
    heads = np.add.reduceat((leader == np.arange(n)).astype(int), cut) if n else size
    for a, m in zip(cut[(heads > 1) & (heads < size)].tolist(), size[(heads > 1) & (heads < size)].tolist(), strict=True):
        rows = a + np.argsort(leader[a : a + m], kind="stable")  # by leader
        led = rows[leader[rows] != rows]
        # A led row against all rows whose leader is another: later leaders' rows, and the earlier ones by symmetry.
        after = np.searchsorted(leader[rows], leader[led], "right")
        count = m - after
        step = max(1, at_once // m)
        for s in range(0, len(led), step):
            c = count[s : s + step]
            x = np.repeat(led[s : s + step], c)
            y = rows[ranges(after[s : s + step], c)]
            near = (low[x] != low[y]).sum(1) <= MOST_ERRORS
            x, y = x[near], y[near]
            one = np.unique(leader[x] * n + leader[y], return_index=True)[1]  # a near pair for each pair of leaders
            us.append(x[one])
            vs.append(y[one])
    u, v = (np.concatenate(k).astype(int) if k else np.zeros(0, int) for k in (us, vs))
    own = ids[u] != ids[v]
    return u[own], v[own]


def first_shared(sig: np.ndarray, u: np.ndarray, v: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
    """The first key that rows u[i] and v[i] share.

    Only there is their edge sent on. Where it is left out, both are together under that earlier key, which connects them
    by edges of its own or of keys before it, as they are near; so the components stay the same and an edge comes out once.
    Rows that are not near are not connected there: their edge must not be left out.
    """
    out = np.zeros(len(u), np.int64)
    for i in range(0, len(u), at_once):
        a, b = chunk_keys(sig[u[i : i + at_once]]), chunk_keys(sig[v[i : i + at_once]])
        out[i : i + at_once] = a[np.arange(len(a)), (a == b).argmax(1)].view(np.int64)
    return out


def _whole_groups(rows: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches that hold whole runs of the first column, from sorted batches; several runs share a batch."""
    held, size = [], 0
    for batch in rows:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = table.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield table.slice(0, cut)
        held = [table.slice(cut)]
        size = len(held[0])
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def connected(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Component number of each of n rows under the edges (u, v)."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def _found(edges: np.ndarray, keys: np.ndarray, ids: np.ndarray, home: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
    """Edges, then members of dealt groups, as rows of FOUND."""
    n, m = len(edges), len(ids)
    cols = [
        pa.concat_arrays([pa.array(edges[:, 0]), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(edges[:, 1]), pa.nulls(m, pa.int64())]),
        *(pa.concat_arrays([pa.nulls(n, k), pa.array(x, k)]) for x, k in ((keys, pa.int64()), (ids, pa.int64()), (home, pa.bool_()), (far, pa.float64()))),
    ]
    return pa.RecordBatch.from_arrays(cols, ["u", "v", "key", "id", "home", "far"])


FOUND = "u long, v long, key long, id long, home boolean, far double"


def _near(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND rows of (g, key, id, lead, sig) sorted by g: near edges, and where a group has a leader its members."""
    for batch in _whole_groups(rows):
        g, key, ids = (batch.column(i).to_numpy() for i in range(3))
        sig = _matrix(batch.column(4), np.uint16, HASHES)
        low = np.ascontiguousarray(sig.astype(np.uint8))
        u, v = near_edges(g, ids, low)
        star = np.flatnonzero(batch.column(3).is_valid().to_numpy(zero_copy_only=False))
        home, far = np.zeros(len(star), bool), np.zeros(len(star))
        if len(star):
            label = connected(u, v, len(ids))
            lead = batch.column(3).fill_null(0).to_numpy()
            at = np.flatnonzero(ids[star] == lead[star])  # each dealt group has its leader once
            head = star[at][np.searchsorted(g[star[at]], g[star])]
            home, far = label[star] == label[head], (low[star] != low[head]).sum(1).astype(float)
        own = first_shared(sig, u, v) == key[u]
        a, b = ids[u[own]], ids[v[own]]
        pair = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        yield _found(pair, key[star], ids[star], home, far)


def linked(sets: list[np.ndarray], percent: int = 75) -> np.ndarray:
    """Component of each set under 100 * intersection >= percent * union, by exact counts; empty sets are alone."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    label = np.arange(n)
    if n < 2:
        return label
    g, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(g, kind="stable")
    g, by = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    length = np.diff(np.append(first, len(g)))
    place = np.empty(len(g), int)
    place[order] = run
    begin = np.concatenate([[0], np.cumsum(size)])
    left = n - 1
    for i in np.argsort(-size, kind="stable"):
        own = place[begin[i] : begin[i + 1]]
        both = np.bincount(by[ranges(first[own], length[own])], minlength=n)
        near = np.flatnonzero((100 * both >= percent * (size + size[i] - both)) & (both > 0))
        old = np.unique(label[near])
        if len(old) > 1:
            label[np.isin(label, old)] = old[0]
            left -= len(old) - 1
            if not left:
                break
    return label


def whole_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Each lower-cased text's distinct word k-grams as numbers that are equal for equal words only.

    A text of fewer than k words has none: it can be linked only with a text of the same words, which it is folded with.
    """
    t = lowered(Texts(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])))
    s = words(t)
    ok = gram_mask(s, k)
    g = exact_grams(symbols(t, s)[0], k)[ok] if ok.any() else np.zeros(0, np.int64)
    _, g = np.unique(g, return_inverse=True)
    owned = np.unique(s.text[: len(ok)][ok] * max(1, len(g)) + g)
    owner, g = owned // max(1, len(g)), owned % max(1, len(g))
    return np.split(g, np.searchsorted(owner, np.arange(1, len(texts))))


def _confirm(percent: int):
    """FOUND rows of (g, key, id, lead, text) sorted by g: links of whole sets, and where a group has a leader its members."""

    def done(key: int, ids: list[int], lead: int | None, texts: list[bytes]) -> pa.RecordBatch:
        sets, at = whole_sets(texts), np.array(ids)
        label = linked(sets, percent)
        low = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(low, label, at)
        edges = np.column_stack([low[label], at])
        if lead is None:
            return _found(edges, *(np.zeros(0, k) for k in (np.int64, np.int64, bool, float)))
        head = ids.index(lead)
        both = np.array([len(np.intersect1d(x, sets[head], assume_unique=True)) for x in sets])
        size = np.array([len(x) for x in sets])
        return _found(edges, np.full(len(at), key), at, label == label[head], 1 - both / np.maximum(1, size + size[head] - both))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts, lead = None, [], [], None
        for batch in rows:
            t = column(batch.column(4))
            raw = t.data.tobytes()
            for i, (g, key, x, top) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
                if ids and (g, key) != now:
                    yield done(now[1], ids, lead, texts)
                    ids, texts = [], []
                now, lead = (g, key), top
                ids.append(x)
                texts.append(raw[t.offsets[i] : t.offsets[i + 1]])
        if ids:
            yield done(now[1], ids, lead, texts)

    return run


def _links(members: DataFrame, payload: DataFrame, run, limit: float, kind: str, block: int) -> DataFrame:
    """Edges (u, v) of the groups of members(key, id, lead, blocks), by `run` on (g, key, id, lead, payload's second column).

    See the module's notes on groups of more than one block. payload has one column besides id.
    """
    data = payload.columns[1]
    held = payload.select(F.col("id").alias("p_id"), data)
    met = members.join(held, F.col("id") == F.col("p_id"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.xxhash64("key", j))
    g = F.when(F.col("blocks") <= 1, F.array("key")).when(F.col("id") == F.col("lead"), every).otherwise(F.array(F.xxhash64("key", own)))
    dealt = met.select(F.explode(g).alias("g"), "key", "id", F.when(F.col("blocks") > 1, F.col("lead")).alias("lead"), data)
    found = keep(dealt.repartition("g").sortWithinPartitions("g", "key", "id", data).mapInArrow(run, FOUND))
    edges, whole = found.where("u is not null").select("u", "v"), found.where("id is not null").select("key", "id", "home", "far")
    total = whole.count()
    if not total:
        return edges
    apart = F.when(~F.col("home"), F.col("far"))
    rest = whole.groupBy("key").agg(F.min(apart).alias("lo"), F.max(apart).alias("hi"), F.count(F.lit(1)).alias("size")).where("lo is not null")
    near = with_groups(whole, rest, {"key": "key"}, ["lo", "hi"], "size", total)
    open_ = keep(near.where((~F.col("home")) | F.col("far").between(F.col("lo") - limit - 1e-9, F.col("hi") + limit + 1e-9)).where("lo is not null").select("key", "id").distinct())
    size = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    n_open = open_.count()
    again = with_groups(open_, size.select(F.col("key").alias("s_key"), "n"), {"key": "s_key"}, ["n"], "n", max(1, n_open))
    # Few open rows are broadcast, so that the texts of all others stay where they are.
    again = F.broadcast(again) if n_open <= MOST_BROADCAST else again
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("long")
    mine = F.pmod(F.xxhash64("id"), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.xxhash64(F.lit(kind), F.col("key"), F.least(j, mine), F.greatest(j, mine)))
    meets = held.join(again, F.col("id") == F.col("p_id")).select(F.explode(pairs).alias("g"), "key", "id", F.lit(None).cast("long").alias("lead"), data)
    crossed = meets.repartition("g").sortWithinPartitions("g", "key", "id", data).mapInArrow(run, FOUND).select("u", "v")
    return edges.unionByName(crossed)


def _node(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id, F.lit(NO_ID) + F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(NO_ID)))


def minhash_nodes(docs: DataFrame, percent: int = 75, block: int = 1024, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n, component of each row of docs as nodes (a null doc_id is a number from NO_ID on)."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(_node(F.col(f"`{id_col}`").cast("long"), text).alias("id"), text.alias("text"))
    profile = keep(rows.mapInArrow(_profile, "id long, n long, h1 long, h2 long, sig binary"))
    folded = profile.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("size"))
    reps = keep(folded)
    keys = reps.select("id", "sig").mapInArrow(_emit_keys, "key long, id long")
    one = F.lit(1).cast("long")
    shared = keys.groupBy(F.col("key").alias("s_key")).agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("lead")).where("members > 1")
    shared = shared.withColumn("blocks", F.greatest(one, F.ceil(F.col("members") / block)).cast("long"))
    n_keys = reps.count() * CHUNKS * comb(HASHES // CHUNKS, CHUNK_ERRORS)
    of_keys = with_groups(keys, shared, {"key": "s_key"}, ["lead", "blocks"], "members", n_keys).where("lead is not null")
    families = components(_links(of_keys, reps.select("id", "sig"), _near, MOST_ERRORS, "near", block))
    heavy = families.join(reps.select(F.col("id").alias("r_id"), "n"), F.col("id") == F.col("r_id")).select("component", "id", "n")
    sizes = heavy.groupBy(F.col("component").alias("key")).agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    sizes = sizes.withColumn("blocks", F.greatest(one, F.ceil(F.col("members") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long"))
    of_families = heavy.join(sizes, F.col("component") == F.col("key")).select("key", "id", F.col("key").alias("lead"), "blocks")
    final = components(_links(of_families, rows, _confirm(percent), 1 - percent / 100, "confirm", block))
    known = reps.join(final.select(F.col("id").alias("f_id"), "component"), F.col("id") == F.col("f_id"), "left")
    known = known.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("n").alias("rn"), F.coalesce("component", "id").alias("component"), "size")
    # Rows without a set have no group; they go on under keys of their own.
    apart = profile.select("id", "n", F.when(F.col("n") > 0, F.col("h1")).otherwise(F.monotonically_increasing_id()).alias("h1"), "h2")
    out = with_groups(apart, known, {"h1": "r1", "h2": "r2", "n": "rn"}, ["component"], "size", max(1, profile.count()))
    return out.select("id", "n", F.coalesce("component", "id").alias("component"))


def minhash_components(docs: DataFrame, percent: int = 75, block: int = 1024, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    back = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    nodes = minhash_nodes(docs, percent, block, text_col, id_col)
    return nodes.select(back("id").alias("doc_id"), F.col("n").alias("n_shingles"), back("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def keep_one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose component they lead (the smallest id), with docs' own columns."""
    kept = minhash_nodes(docs, text_col=text_col, id_col=id_col, **options).where("id = component").select(F.col("id").alias("k_id"))
    whole = docs.select(F.struct("*").alias("row"), _node(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).alias("id"))
    return whole.join(kept, F.col("id") == F.col("k_id"), "left_semi").select("row.*")


def op8_minhash_dedup(spark, sf_dir):
    return minhash_components(documents(spark, sf_dir))


SQL = {
    "op8_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), b AS (
  SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT u, v FROM b JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * common >= 75 * (x.size + y.size - common)
), e AS (
  SELECT u, v FROM l UNION ALL SELECT v, u FROM l
), r AS (
  SELECT doc_id, doc_id AS node FROM n UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.node = e.u
), c AS (
  SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id
)
SELECT w.doc_id, coalesce(size, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.doc_id
"""
}
