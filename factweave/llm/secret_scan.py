"""Secret scans: three fixed patterns, and a token-efficiency test for random strings.

Base kinds (leftmost matches that do not overlap, per kind): assign, access, hex; see _ASSIGN and the lengths below.
The method: a run of 16 or more of [A-Za-z0-9+/_-] with a digit and a letter is encoded with a tiktoken vocabulary. Text that
a vocabulary was made for yields many characters a token, a random string few; runs below max_ratio characters a token
become spans of kind random, unless the run is a digest (hexadecimal digits of a usual digest length), a UUID, or meets a
base span. All texts are read whole; runs are found by byte class over the whole batch, and only the few documents with a
key word and only candidate runs are handled one by one.

The vocabulary is read once by the driver from the path given and sent to the workers (0.8 MB, a fixed size).

Cases: null and empty texts have no spans (base_sha256 is that of the empty string); repeated rows are scanned each; null
doc_id is kept; extra columns are ignored; empty table -> no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import documents
from .textcols import Texts, code_points, column, pieces

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_KEYS = (b"passw", b"secret", b"token", b"api")
_UUID = re.compile(rb"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_HEX = re.compile(rb"[0-9a-f]+|[0-9A-F]+")
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
MIN_RUN, MIN_HEX, MIN_ACCESS, MIN_VALUE = 16, 24, 20, 6


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_DIGIT, _LOWER, _UPPER = b"0123456789", bytes(range(97, 123)), bytes(range(65, 91))
_IS_HEX, _IS_RUN, _IS_ACCESS = _class(_DIGIT + b"abcdef"), _class(_DIGIT + _LOWER + _UPPER + b"+/_-"), _class(_DIGIT + _UPPER)
_IS_DIGIT, _IS_LETTER = _class(_DIGIT), _class(_LOWER + _UPPER)


def _runs(t: Texts, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs, within one text each, of at least so many bytes of a class."""
    inside = np.zeros(len(t.data) + 2, bool)
    inside[1:-1] = member[t.data]
    change = inside[1:] != inside[:-1]
    cut = np.zeros(len(t.data) + 1, bool)
    cut[t.offsets] = True
    cut &= inside[:-1] & inside[1:]
    start = np.flatnonzero((change & inside[1:]) | cut)
    end = np.flatnonzero((change & inside[:-1]) | cut)
    long = end - start >= least
    return start[long], end[long]


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("secret-scan", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def find_spans(t: Texts, ranks: bytes, pattern: str, max_ratio: float) -> list[tuple[int, int, int, int]]:
    """(text, start, kind, end) of all spans, in bytes of the piece, sorted by text, start and kind."""
    found: list[tuple[int, int, int, int]] = []
    owner = lambda at: int(np.searchsorted(t.offsets, at, "right")) - 1
    raw = t.data.tobytes()
    low = raw.lower()
    keyed: set[int] = set()
    for key in _KEYS:
        at = low.find(key)
        while at >= 0:
            keyed.add(i := owner(at))
            at = low.find(key, int(t.offsets[i + 1]) - len(key) + 1) if at < int(t.offsets[i + 1]) else -1
    for i in keyed:
        first = int(t.offsets[i])
        for m in _ASSIGN.finditer(raw[first : int(t.offsets[i + 1])]):
            if len(m[2]) >= MIN_VALUE:
                found.append((i, first + m.start(), 0, first + m.end()))
    for start, end in zip(*_runs(t, _IS_ACCESS, MIN_ACCESS), strict=True):
        at = raw.find(b"AKIA", start, end)
        if at >= 0 and end - at >= MIN_ACCESS:
            found.append((owner(start), at, 1, int(end)))
    for start, end in zip(*_runs(t, _IS_HEX, MIN_HEX), strict=True):
        found.append((owner(start), int(start), 2, int(end)))
    start, end = _runs(t, _IS_RUN, MIN_RUN)
    digits, letters = (np.concatenate([[0], np.cumsum(c[t.data])]) for c in (_IS_DIGIT, _IS_LETTER))
    mixed = (digits[end] > digits[start]) & (letters[end] > letters[start])
    base = sorted((s, e) for _, s, _, e in found)
    starts = np.array([s for s, _ in base], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in base], np.int64)) if base else starts
    for s, e in zip(start[mixed].tolist(), end[mixed].tolist(), strict=True):
        k = int(np.searchsorted(starts, e)) - 1
        text = raw[s:e]
        if (k >= 0 and reach[k] > s) or _UUID.fullmatch(text) or (len(text) in DIGESTS and _HEX.fullmatch(text)):
            continue
        if len(text) < max_ratio * len(_encoding(ranks, pattern).encode_ordinary(text.decode())):
            found.append((owner(s), s, 3, e))
    return sorted(found)


def secret_scan(docs: DataFrame, vocabulary: str, pattern: str, max_ratio: float = 2.1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, spans as array<struct<kind, start, end>> in code points (end exclusive), by start and kind."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in rows:
            for t in pieces(column(batch.column(1))):
                spans: list[list[dict]] = [[] for _ in range(len(t))]
                if found := find_spans(t, ranks, pattern, max_ratio):
                    points = code_points(t)
                    for i, s, k, e in found:
                        zero = points[t.offsets[i]]
                        spans[i].append({"kind": KINDS[k], "start": int(points[s] - zero), "end": int(points[e] - zero)})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, len(t)), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>")


def op6_secret_scan(spark, sf_dir):
    import public_tokenizers

    found = secret_scan(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] != KINDS[3])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
