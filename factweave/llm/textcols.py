"""Columnar text primitives on numpy: tokenising, hashing and shingling of whole Arrow string columns.

A batch of texts is one byte buffer with offsets; every function here works on that buffer at once, with no loop over
words. Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D), which in UTF-8 is the same as
runs of code points. Hashes have 64 bits and chain a non-linear mixer over eight bytes at a time, so no pattern in a text
makes two of them meet; where a result must not hang on them at all, symbols() numbers spans by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
#: Spans of more bytes are hashed and compared one by one.
LONG_SPAN = 256
_SEED, _STEP = np.uint64(0x243F6A8885A308D3), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit hangs on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Texts:
    """Texts as bytes: text i is data[offsets[i]:offsets[i + 1]]; first is the row of text 0 in its batch."""

    data: np.ndarray
    offsets: np.ndarray
    first: int = 0

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Spans:
    """Words or lines: byte range and text of each, and how many each text has."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    bounds: np.ndarray  # of text i: bounds[i]:bounds[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def column(x: pa.Array | pa.ChunkedArray | list) -> Texts:
    """Bytes and offsets of an Arrow string column; null is the empty text."""
    if isinstance(x, list):
        x = pa.array(x, pa.string())
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    x = x.cast(pa.large_string()).fill_null("")
    buffers = x.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(x) + 1, x.offset * 8) if len(x) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def pieces(t: Texts, limit: int = PIECE_BYTES) -> Iterator[Texts]:
    """The same texts in runs of about limit bytes; no text is split."""
    i, n = 0, len(t)
    while i < n:
        j = max(i + 1, int(np.searchsorted(t.offsets, t.offsets[i] + limit, "right")) - 1)
        yield Texts(t.data[t.offsets[i] : t.offsets[j]], t.offsets[i : j + 1] - t.offsets[i], i)
        i = j


def lowered(t: Texts) -> Texts:
    return Texts(LOWER[t.data], t.offsets, t.first)


def words(t: Texts) -> Spans:
    n = len(t.data)
    ink = ~SPACE[t.data]
    edge = np.zeros(n + 1, bool)
    edge[t.offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0], before[1:] = True, ~ink[:-1]
        after[-1], after[:-1] = True, ~ink[1:]
    start = np.flatnonzero(ink & (before | edge[:-1]))
    end = np.flatnonzero(ink & (after | edge[1:])) + 1
    bounds = np.searchsorted(start, t.offsets)
    return Spans(start, end, np.repeat(np.arange(len(t)), np.diff(bounds)), bounds)


def lines(t: Texts) -> Spans:
    """Lines between newlines; a text has one more line than newlines, an empty text one empty line."""
    cut = np.flatnonzero(t.data == 10)
    start = np.sort(np.concatenate([t.offsets[:-1], cut + 1]), kind="stable")
    end = np.sort(np.concatenate([t.offsets[1:], cut]), kind="stable")
    counts = np.diff(np.searchsorted(cut, t.offsets)) + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return Spans(start, end, np.repeat(np.arange(len(t)), counts), bounds)


def _eights(t: Texts) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the last byte."""
    padded = np.concatenate([t.data, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.ndarray(len(t.data) + 1, "<u8", padded, strides=(1,)))


def _ends(left: np.ndarray) -> np.ndarray:
    """Masks of the low min(8, left) bytes; left is 1 or more."""
    return ~np.uint64(0) >> (np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8))


def hashes(t: Texts, s: Spans) -> np.ndarray:
    """64-bit hash of each span's bytes and length."""
    eights, size = _eights(t), s.end - s.start
    out = mix(size.astype(np.uint64) * _STEP ^ _SEED)
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at, left = s.start[live], size[live]
    while len(live):
        out[live] = mix(out[live] ^ ((eights[at] & _ends(left)) * _STEP))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(t.data[s.start[i] : s.end[i]], digest_size=8).digest(), "little")
    return out


def same_bytes(t: Texts, s: Spans, other: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of the span that other names."""
    eights, size = _eights(t), s.end - s.start
    same = size == size[other]
    live = np.flatnonzero(same & (size > 0) & (size <= LONG_SPAN) & (other != np.arange(len(size))))
    at, to, left = s.start[live], s.start[other[live]], size[live]
    while len(live):
        differ = (eights[at] ^ eights[to]) & _ends(left) != 0
        same[live[differ]] = False
        more = (left > 8) & ~differ
        live, at, to, left = live[more], at[more] + 8, to[more] + 8, left[more] - 8
    for i in np.flatnonzero(same & (size > LONG_SPAN)).tolist():
        j = other[i]
        same[i] = i == j or np.array_equal(t.data[s.start[i] : s.end[i]], t.data[s.start[j] : s.end[j]])
    return same


def symbols(t: Texts, s: Spans, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, equal for equal bytes only, and one span of each number.

    Spans are sorted by hash and each is compared with the bytes of its number's span; should two different ones share a
    hash, those that differ are numbered by a dictionary.
    """
    h = hashes(t, s) if h is None else h
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    one = order[new]
    odd = np.flatnonzero(~same_bytes(t, s, one[number])) if len(h) else order
    if len(odd):
        known: dict[bytes, int] = {}
        added = []
        for i in odd.tolist():
            raw = t.data[s.start[i] : s.end[i]].tobytes()
            if raw not in known:
                known[raw] = len(one) + len(known)
                added.append(i)
            number[i] = known[raw]
        one = np.concatenate([one, added])
    return number, one


def exact_grams(number: np.ndarray, k: int) -> np.ndarray:
    """A number for each k consecutive symbols (across texts as well), equal for equal ones only."""
    m = len(number) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    width = int(number.max()) + 1
    out, most = number[:m], width
    for j in range(1, k):
        if most * width >= 1 << 63:  # no room for another digit: number anew
            _, out = np.unique(out, return_inverse=True)
            most = m
        out, most = out * width + number[j : j + m], most * width
    return out


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] values each, one after another."""
    skip = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(count) else np.zeros(0, np.int64)
    return skip + np.arange(len(skip))


_WEIGHTS = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) | 1 for i in range(64)], np.uint64)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (across texts as well: callers mask with gram_mask)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] * _WEIGHTS[0]
    for j in range(1, k):
        out += h[j : j + m] * _WEIGHTS[j]
    return mix(out)


def gram_mask(s: Spans, k: int) -> np.ndarray:
    m = len(s.text) - k + 1
    return s.text[:m] == s.text[k - 1 :] if m > 0 else np.zeros(0, bool)


def per_text(bounds: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of x over each text's range of bounds."""
    total = np.concatenate([[0], np.cumsum(x)])
    return total[bounds[1:]] - total[bounds[:-1]]


def shingle_sets(t: Texts, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word k-grams of each lower-cased text as sorted hashes, and their bounds by text.

    A text with fewer than k words has its whole word sequence as its only shingle; one without words has none.
    """
    t = lowered(t)
    s = words(t)
    h = hashes(t, s)
    ok = gram_mask(s, k)
    g, owner = grams(h, k)[ok], s.text[: max(0, len(h) - k + 1)][ok]
    short = np.flatnonzero((s.counts > 0) & (s.counts < k))
    if len(short):
        extra = []
        for i in short:
            own = h[s.bounds[i] : s.bounds[i + 1]]
            extra.append(np.add.reduce(own * _WEIGHTS[: len(own)], keepdims=True) + np.uint64(len(own)))
        g = np.concatenate([g, mix(np.concatenate(extra))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[new], owner[new]
    return g, np.searchsorted(owner, np.arange(len(t) + 1))


def code_points(t: Texts) -> np.ndarray:
    """For each byte position, how many code points begin before it (length len(data) + 1)."""
    return np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
