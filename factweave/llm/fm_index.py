"""Compressed FM-index over integer symbols: an entropy-shaped wavelet tree with popcount rank, and batched backward search.

Symbols are 0 .. sigma-1; 0 separates the indexed pieces and is in no pattern. The Burrows-Wheeler transform is stored as the
bits of a wavelet tree whose paths are the symbols' Shannon codes, so that a frequent symbol takes few bits (n (H0 + 1) bits
at most for n symbols), with a directory of half of that. The suffixes are sorted by their first `depth` symbols only,
which is exact for every pattern of at most that length.
"""

from __future__ import annotations

import numpy as np

#: Masks of the bits below each place of a word.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by depth or more symbols that begin there; beyond the end sorts first."""
    n = len(text)
    rank, h = text.astype(np.int64) + 1, 1
    width = int(rank.max(initial=0)) + 1
    while h < depth and width ** (h + 1) < 1 << 62 and h < 3:  # the first symbols as one number
        first = np.zeros(n, np.int64)
        first[: max(0, n - h)] = text[h:] + 1
        rank, h = rank * width + first, h + 1
    order = np.argsort(rank)
    while h < depth:
        new = np.ones(n, np.int64)
        new[1:] = rank[order[1:]] != rank[order[:-1]]
        rank[order] = np.cumsum(new)
        if n == 0 or rank[order[-1]] == n:
            break
        key = rank * (n + 2)
        key[: max(0, n - h)] += rank[h:]
        rank, order, h = key, np.argsort(key), 2 * h
    return order


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        self.n, self.sigma = len(text), sigma
        counts = np.bincount(text, minlength=sigma)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        # Shannon codes: a symbol's path has about log2(n / count) branches; paths of one length follow each other.
        some = np.maximum(counts, 1)
        self.size = np.ceil(np.log2((int(some.sum()) + 1) / some)).astype(np.int64).clip(1, 62)
        order = np.argsort(self.size, kind="stable")
        deepest = int(self.size.max(initial=1))
        room = np.int64(1) << (deepest - self.size[order])
        self.code = np.empty(sigma, np.int64)
        self.code[order] = (np.cumsum(room) - room) >> (deepest - self.size[order])
        self._branch(text[suffix_order(text, depth) - 1])  # the first suffix is preceded by the last symbol, a separator

    def _branch(self, seq: np.ndarray) -> None:
        """The bits of all nodes, level by level; a node's symbols lie together and in their order in the transform."""
        bits, starts, child = [], [np.zeros(1, np.int64)], [np.full((1, 2), -1, np.int64)]
        node, nodes, base, level = np.zeros(len(seq), np.int64), 1, 0, 0
        while len(seq):
            size = self.size[seq]
            one = (self.code[seq] >> (size - 1 - level)) & 1 == 1
            bits.append(one)
            base += len(seq)
            on = size > level + 1  # the others have arrived
            zero_on, one_on = on & ~one, on & one
            seq = np.concatenate([seq[zero_on], seq[one_on]])
            edge = np.concatenate([2 * node[zero_on], 2 * node[one_on] + 1])
            at = np.flatnonzero(np.concatenate([[True], edge[1:] != edge[:-1]])) if len(edge) else np.zeros(0, np.int64)
            starts.append(base + at)
            child.append(np.full((len(at), 2), -1, np.int64))
            links = np.concatenate(child)
            links[edge[at] >> 1, edge[at] & 1] = nodes + np.arange(len(at))
            child = [links]
            node = np.repeat(nodes + np.arange(len(at)), np.diff(np.append(at, len(edge))))
            nodes, level = nodes + len(at), level + 1
        every = np.concatenate(bits) if bits else np.zeros(0, bool)
        # 64 bits a word, and for each word the set bits before it.
        self.words = np.packbits(np.concatenate([every, np.zeros(-len(every) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
        self.counts = np.zeros(len(self.words), np.uint32 if len(every) < 1 << 32 else np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.counts[1:])
        self.start, self.child = np.concatenate(starts), np.concatenate(child)
        self.ones = self._ones(self.start)

    def _ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        return np.bitwise_count(self.words[word] & _BELOW[at & 63]) + self.counts[word]

    @property
    def bits(self) -> int:
        """Size of the tree with its directory and nodes."""
        return 8 * sum(x.nbytes for x in (self.words, self.counts, self.start, self.ones, self.child))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] stands in the first at[..., i] places of the transform; at may have several rows."""
        # The longest paths first, so that those still on their way are a prefix at each level.
        order = np.argsort(-self.size[symbol])
        symbol, at = symbol[order], at[..., order].astype(np.int64)
        code, left, node = self.code[symbol], self.size[symbol], np.zeros(len(symbol), np.int64)
        going = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")
        for live in going.tolist():
            place, where = at[..., :live], node[:live]
            ones = self._ones(self.start[where] + place) - self.ones[where]
            left[:live] -= 1
            bit = (code[:live] >> left[:live]) & 1
            at[..., :live] = np.where(bit == 1, ones, place - ones)
            node[:live] = self.child[where, bit]
        out = np.empty_like(at)
        out[..., order] = at
        return out

    def matching_statistics(self, text: np.ndarray, end: np.ndarray, most: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end: how many of the symbols of a streamed text before it, up to most, stand together in at least
        `least` places of the index; and the rows low, high of the index that begin with them.

        Backward search of all ends at once, one symbol a step; an end drops out when too few places go on. Symbols of
        sigma or more are not in the index. text needs `most` symbols before each end, or a separator among them.
        """
        length, first, last = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64), np.full(len(end), self.n)
        live, low, high = np.arange(len(end)), first.copy(), last.copy()
        for back in range(1, most + 1):
            symbol = text[end[live] - back]
            known = (symbol > 0) & (symbol < self.sigma)
            live, low, high, symbol = live[known], low[known], high[known], symbol[known]
            if back == 1:
                low, high = self.before[symbol], self.before[symbol + 1]
            else:
                low, high = self.before[symbol] + self.rank(symbol, np.stack([low, high]))
            more = high - low >= least
            live, low, high = live[more], low[more], high[more]
            if not len(live):
                break
            length[live], first[live], last[live] = back, low, high
        return length, first, last
