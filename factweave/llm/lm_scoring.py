"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation, in numpy, beside a unigram base.

Counts: every token of every training text (crc32(doc_id as text) mod 5 is not 1) is counted; the table of distinct tokens
stays distributed, and a token's count reaches the documents either through the `head` most frequent ones (a broadcast of
fixed size) or, for all others, through a shuffle join.

Model: symbols are the FREQUENT most frequent tokens and CLASSES classes of the others by their ending. The score of a
symbol after two context symbols is (C1[c1] + C2[c2]) . Q[w] + b[w]; probabilities are normalised over all symbols, with the
normalisers of all contexts from one product of matrices, exp(C1 Q' + b) exp(C2 Q')'. A token outside the frequent ones
takes its class's probability times (c + 0.5) / (N_class + 0.5 (V_class + 1)), with c = 0 standing for all unseen tokens.

Training: each task runs noise-contrastive Adagrad over all its training tokens, from the same start, and hands back one
set of parameters (under 1 MB, whatever the data); their mean, weighted by tokens, is the next start. ROUNDS passes. So all
training texts take part, tasks can be lost and run again, and the driver holds one set of parameters. Small partitions are
put together to TASK_TOKENS, so that a task trains long enough to count. START is what Adagrad's sums of squares begin with.
The symbols are of fixed number; what grows with the corpus is the counts, which reach every token's score in its class.

Cases: null and empty texts are the end token alone; null doc_id counts as the empty string in crc32; rows that share a
doc_id are scored each (a running number tells them apart); no training rows -> counts are 0 and probabilities come from the
0.5 terms; extra columns are ignored; empty table -> no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_classifier import held_out
from .tables import documents, keep
from .textcols import Spans, Texts, column, hashes, lowered, mix, pieces, symbols, words

FREQUENT, CLASSES, DIM, NOISE, BATCH, ROUNDS, RATE, START = 1536, 512, 16, 128, 8192, 1, 0.1, 100.0
SYMBOLS = FREQUENT + CLASSES
HEAD = 1 << 18
COUNT_BYTES = 8 << 20
#: Text that a task scores at once: a token takes some twenty numbers meanwhile.
SCORE_BYTES = 1 << 18
#: Hash of the end token, which is no word: the empty byte string.
END = int(mix(np.zeros(1, np.uint64))[0])
PARTS = 32
#: Training tokens of a task: with fewer, the mean of the tasks' parameters has hardly moved from the start.
TASK_TOKENS = 2_000_000


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens (words, then an end token, text after text), their classes, byte ranges, and bounds by text."""
    t = lowered(t)
    s = words(t)
    n = len(t)
    bounds = s.bounds + np.arange(n + 1)
    at = np.arange(len(s.start)) + s.text
    h = np.full(bounds[-1], END, np.uint64)
    h[at] = hashes(t, s)
    start, end = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    start[at], end[at] = s.start, s.end
    # The class of a rare token: its last two bytes that are no punctuation.
    stop = s.end.copy()
    for _ in range(3):
        odd = (stop - s.start > 2) & ~_LETTER[t.data[np.maximum(stop - 1, 0)]]
        stop -= odd
    last = t.data[np.maximum(stop - 1, 0)].astype(np.uint64) if len(stop) else np.zeros(0, np.uint64)
    prior = np.where(stop - s.start > 1, t.data[np.maximum(stop - 2, 0)], 0).astype(np.uint64) if len(stop) else last
    kind = np.zeros(len(h), np.int64)
    kind[at] = (mix(last * np.uint64(257) + prior + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int64)
    return h, kind, start, end, bounds


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[48:58] = True
_LETTER[128:] = True


def lookup(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Position of each hash in a sorted table, or -1."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


class Model:
    """Symbols and parameters."""

    def __init__(self, frequent: np.ndarray, prior: np.ndarray, seed: int = 5):
        """frequent: hashes of the frequent tokens, most frequent first; prior: symbols' shares of the training tokens."""
        self.sorted = np.sort(frequent)
        self.symbol = np.argsort(frequent)
        self.prior = prior
        rng = np.random.default_rng(seed)
        self.params = (rng.normal(0, 0.1, (3 * SYMBOLS, DIM)).astype(np.float32), np.log(prior).astype(np.float32))

    def symbols(self, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        at = lookup(h, self.sorted)
        return np.where(at >= 0, self.symbol[at] if len(self.symbol) else 0, FREQUENT + kind)

    def contexts(self, w: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols one and two places before; before a text stands the end token."""
        one, two = np.empty_like(w), np.empty_like(w)
        one[1:], two[2:] = w[:-1], w[:-2]
        starts = bounds[:-1]
        one[starts], two[starts] = end, end
        second = starts + 1
        two[second[second < bounds[1:]]] = end
        return one, two

    def train(self, streams: Iterator[tuple[np.ndarray, np.ndarray]], end: int, rate: float = RATE, seed: int = 11) -> int:
        """Adagrad on the noise-contrastive loss over (symbols, bounds by text); returns the tokens seen."""
        e, b = (x.copy() for x in self.params)
        c1, c2, q = e[:SYMBOLS], e[SYMBOLS : 2 * SYMBOLS], e[2 * SYMBOLS :]
        sums = [np.full(x.shape, START, np.float32) for x in (c1, c2, q)] + [np.full(SYMBOLS, START, np.float32)]
        rng = np.random.default_rng(seed)
        cumulative = np.cumsum(self.prior)
        log_noise = (np.log(self.prior) + np.log(NOISE)).astype(np.float32)
        column_of = np.arange(DIM)

        def spread(at: np.ndarray, grad: np.ndarray) -> np.ndarray:
            return np.bincount((at[:, None] * DIM + column_of).ravel(), grad.ravel(), SYMBOLS * DIM).reshape(SYMBOLS, DIM).astype(np.float32)

        def step(x: np.ndarray, total: np.ndarray, grad: np.ndarray) -> None:
            total += grad * grad
            x += rate * grad / np.sqrt(total)

        seen = 0
        for w, bounds in streams:
            one, two = self.contexts(w, bounds, end)
            for i in range(0, len(w), BATCH):
                y, x1, x2 = w[i : i + BATCH], one[i : i + BATCH], two[i : i + BATCH]
                noise = np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]).clip(0, SYMBOLS - 1)
                h = c1[x1] + c2[x2]
                qy, qn = q[y], q[noise]
                good = 1 / (1 + np.exp(-((h * qy).sum(1) + b[y] - log_noise[y])))
                bad = 1 / (1 + np.exp(-(h @ qn.T + b[noise] - log_noise[noise])))
                gy, gn = 1 - good, -bad
                dh = gy[:, None] * qy + gn @ qn
                dq = spread(y, gy[:, None] * h)
                np.add.at(dq, noise, gn.T @ h)
                db = np.bincount(y, gy, SYMBOLS).astype(np.float32)
                np.add.at(db, noise, gn.sum(0))
                d1, d2 = spread(x1, dh), spread(x2, dh)
                for k, (p, g) in enumerate(((c1, d1), (c2, d2), (q, dq), (b, db))):
                    step(p, sums[k], g)
                seen += len(y)
        self.params = (e, b)
        return seen

    def log10(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Normalised log-probability of each symbol in its context."""
        (e, b), norm = self.params, _normaliser(self.params[0].tobytes(), self.params[1].tobytes())
        c1, c2, q = e[:SYMBOLS], e[SYMBOLS : 2 * SYMBOLS], e[2 * SYMBOLS :]
        out = np.empty(len(w))
        for i in range(0, len(w), BATCH):
            at = slice(i, i + BATCH)
            out[at] = np.einsum("ij,ij->i", c1[one[at]] + c2[two[at]], q[w[at]], dtype=np.float64) + b[w[at]] - norm[one[at], two[at]]
        return out / np.log(10)


@lru_cache(maxsize=1)
def _normaliser(embeddings: bytes, bias: bytes) -> np.ndarray:
    """The log-normaliser of each pair of context symbols, made once in each worker process: the one table that a worker holds."""
    e, b = np.frombuffer(embeddings, np.float32).reshape(3, SYMBOLS, DIM), np.frombuffer(bias, np.float32)
    a1, a2 = e[0] @ e[2].T, e[1] @ e[2].T
    a1 += b
    top1, top2 = a1.max(1), a2.max(1)
    for a, top in ((a1, top1), (a2, top2)):
        a -= top[:, None]
        np.exp(a, out=a)
    norm = a1 @ a2.T
    np.log(norm, out=norm)
    norm += top1[:, None]
    norm += top2
    return norm


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        h, n, kind = (np.concatenate([x[k] for x in held]) for k in range(3))
        whole = pa.table([pa.concat_arrays([x[3] for x in held]), pa.array(h.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(n)], ["token", "hash", "kind", "c"])
        one = whole.group_by(["token", "hash", "kind"]).aggregate([("c", "sum")])
        return one.select([0, 1, 2, 3]).rename_columns(["token", "hash", "kind", "c"]).combine_chunks().to_batches()[0]

    size = 0
    for batch in rows:
        for t in pieces(column(batch.column(0))):
            h, kind, start, end, _ = tokens(t)
            number, first = symbols(t := lowered(t), Spans(start, end, start, start), h)
            raw = t.data.tobytes()
            names = pa.array([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], pa.binary())
            held.append((h[first], np.bincount(number), kind[first], names))
            size += len(t.data)
            if size >= COUNT_BYTES:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _train(model: Model, end: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def streams() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in rows:
                for t in pieces(column(batch.column(0))):
                    h, kind, _, _, bounds = tokens(t)
                    yield model.symbols(h, kind), bounds

        seen = model.train(streams(), end)
        if seen:
            e, b = model.params
            whole = np.concatenate([e.ravel(), b])
            blocks = [x.tobytes() for x in np.array_split(whole, PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([seen] * PARTS, pa.int64()), pa.array(blocks, pa.binary())], ["part", "seen", "block"])

    return run


def _mean(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in rows:
        for part, seen, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total = sums.setdefault(part, [0, 0.0])
            total[0] += seen
            total[1] = total[1] + seen * np.frombuffer(block, np.float32).astype(np.float64)
    if sums:
        cols = [pa.array(sums, pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1].tobytes() for x in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["part", "seen", "block"])


def _head(counts: DataFrame):
    """The HEAD most frequent tokens (hash, c, kind), the smaller hashes first among equal counts, as pandas.

    Every count has a token at least, so HEAD + 1 counts from the top say which count the head ends in. Of that one the tokens
    below a hash that leaves a few more than wanted are fetched, so the driver gets a bounded number however many tie.
    """
    bins = counts.groupBy("c").count().orderBy(F.desc("c")).limit(HEAD + 1).toPandas()
    upto = bins["count"].cumsum()
    whole = int((upto <= HEAD).sum())
    fields, order = ["hash", "c", "kind"], {"by": ["c", "hash"], "ascending": [False, True]}
    least = int(bins["c"].iloc[whole - 1]) if whole else 1 << 62
    head = counts.where(F.col("c") >= least).select(*fields).toPandas()
    want = HEAD - len(head)
    if whole == len(bins) or not want:
        return head.sort_values(**order)
    last, size = int(bins["c"].iloc[whole]), int(bins["count"].iloc[whole])
    share = (want + 6 * want**0.5 + 64) / size
    while True:
        bound = min((1 << 63) - 1, int(min(1.0, share) * 2.0**64) - (1 << 63))
        tied = counts.where((F.col("c") == last) & (F.col("hash") <= F.lit(bound))).select(*fields).toPandas()
        if len(tied) >= want or share >= 1:
            break
        share *= 2
    return pd.concat([head, tied.sort_values("hash").head(want)]).sort_values(**order)


def fit(train: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> tuple[Model, dict]:
    """The model, and what scoring needs of the counts: N, V, per-class N and V, and the head's hashes and counts."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    head = _head(counts)
    hashes_, c = head["hash"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64)
    frequent = hashes_[:FREQUENT]
    is_end = np.flatnonzero(frequent == np.uint64(END))
    end = int(is_end[0]) if len(is_end) else FREQUENT
    kinds = counts.groupBy("kind").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in kinds:
        n_class[row["kind"]], v_class[row["kind"]] = row["n"], row["v"]
    kind = head["kind"].to_numpy(int)[:FREQUENT]
    n_class -= np.bincount(kind, c[:FREQUENT], CLASSES)
    v_class -= np.bincount(kind, minlength=CLASSES)
    prior = np.full(SYMBOLS, 0.5)
    prior[: len(frequent)] += c[:FREQUENT]
    prior[FREQUENT:] += n_class
    model = Model(frequent, prior / prior.sum())
    tasks = -(-int(total[0]) // TASK_TOKENS) or 1
    for _ in range(rounds):
        sent = train.coalesce(tasks).mapInArrow(_train(model, end), "part int, seen long, block binary")
        parts = sorted(sent.repartition("part").mapInArrow(_mean, "part int, seen long, block binary").collect(), key=lambda r: r["part"])
        if parts:
            whole = np.concatenate([np.frombuffer(r["block"]) / r["seen"] for r in parts]).astype(np.float32)
            model.params = (whole[:-SYMBOLS].reshape(3 * SYMBOLS, DIM), whole[-SYMBOLS:])
    order = np.argsort(hashes_)
    return model, {"N": int(total[0]), "V": int(total[1]), "n": n_class, "v": v_class, "hash": hashes_[order], "c": c[order], "end": end}


def _score(model: Model, k: dict):
    """For each text one row without a token and one for each distinct token outside the head."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = k["N"] + 0.5 * (k["V"] + 1)
        by_class = k["n"] + 0.5 * (k["v"] + 1)
        for batch in rows:
            for t in pieces(column(batch.column(1)), SCORE_BYTES):
                h, kind, start, end, bounds = tokens(t)
                own = np.repeat(np.arange(len(t)), np.diff(bounds))
                w = model.symbols(h, kind)
                one, two = model.contexts(w, bounds, k["end"])
                s = model.log10(w, one, two)
                at = lookup(h, k["hash"])
                known = at >= 0
                c = np.where(known, k["c"][at] if len(k["c"]) else 0, 0)
                rare = w >= FREQUENT
                s[rare] -= np.log10(by_class[kind[rare]])
                s[rare & known] += np.log10(c[rare & known] + 0.5)
                base = np.where(known, np.log10(c + 0.5), 0) - np.log10(whole)
                sums = lambda x: np.bincount(own, x, len(t))
                rest = np.flatnonzero(~known)
                raw = (low := lowered(t)).data.tobytes()
                number, one = symbols(low, Spans(start[rest], end[rest], own, own), h[rest])
                _, first, times = np.unique(own[rest] * max(1, len(one)) + number, return_index=True, return_counts=True)
                first = rest[first]
                names = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
                ids = batch.column(0).slice(t.first, len(t))
                n = len(t)
                row = np.concatenate([np.arange(n), own[first]])
                cols = [
                    ids.take(pa.array(row)),
                    pa.array([None] * n + names, pa.binary()),
                    pa.array(np.concatenate([np.diff(bounds), times])),
                    pa.array(np.concatenate([sums(known), np.zeros(len(first))]).astype(np.int64)),
                    pa.array(np.concatenate([sums(base), np.zeros(len(first))])),
                    pa.array(np.concatenate([sums(s), np.zeros(len(first))])),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["row", "token", "times", "known", "base", "score"])

    return run


def lm_scores(docs: DataFrame, rounds: int = ROUNDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs."""
    c = lambda x: F.col(f"`{x}`")
    rows = docs.select(c(id_col).cast("long").alias("doc_id"), c(text_col).alias("text"))
    out = held_out(F.col("doc_id"), 5)
    train = rows.where(~out).select("text")
    counts = keep(train.mapInArrow(_count, "token binary, hash long, kind int, c long").groupBy("token").agg(F.min("hash").alias("hash"), F.min("kind").alias("kind"), F.sum("c").alias("c")))
    model, known = fit(train, counts, rounds)
    ids = "row struct<doc_id: bigint, held_out: boolean, nr: bigint>"
    named = rows.select(F.struct("doc_id", out.alias("held_out"), F.monotonically_increasing_id().alias("nr")).alias("row"), "text")
    parts = named.mapInArrow(_score(model, known), f"{ids}, token binary, times long, known long, base double, score double")
    rare = counts.select(F.col("token").alias("c_token"), F.col("c"))
    # A row without a token joins nothing, under a key of its own: a space, which no token has, and the row's number.
    found = F.col("token").isNotNull()
    key = F.coalesce("token", F.concat(F.lit(" "), F.col("row.nr").cast("string")).cast("binary"))
    whole = parts.withColumn("key", key).join(rare, F.col("key") == F.col("c_token"), "left")
    term = F.when(found, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5)))
    scored = whole.groupBy("row").agg(
        F.sum(F.when(~found, F.col("times"))).alias("n_tokens"),
        F.sum(F.when(found & F.col("c").isNotNull(), F.col("times")).otherwise(F.col("known"))).alias("n_known"),
        (F.sum("base") + F.coalesce(F.sum(term), F.lit(0.0))).alias("base_score"),
        (F.sum("score") + F.coalesce(F.sum(term), F.lit(0.0))).alias("score"),
    )
    return scored.select("row.doc_id", "row.held_out", "n_tokens", "n_known", F.lit(known["N"]).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_scoring(spark, sf_dir):
    return lm_scores(documents(spark, sf_dir))
