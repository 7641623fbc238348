"""Token counts by a tokenizer compiled to a deterministic finite-state transducer.

The vocabulary (a sentencepiece BPE model with byte fallback) merges greedily by score. A sequence of pieces is the result
for its text exactly if every two neighbours are the result for theirs, so the last piece of a prefix is the one piece that
ends there and agrees with the last piece of the prefix before it. What this needs of the past is bounded: a state is the
longest end of the text read that begins a piece (a node of an Aho-Corasick automaton over the pieces) and, for each position
in it, the last piece and the token count there, relative to the count now. A transition on a character carries the change of
the token count, which may be negative where a character joins tokens; the changes of a text add up to its tokens. States
and transitions are made when a text first needs them and are kept by the worker, in a table of bounded size that is begun
anew when it is full, so memory does not grow with the texts.

No piece holds certain pairs of neighbouring characters (nor any character outside the vocabulary, which becomes a token a
byte). Between such two characters the state is the start state, whatever came before.

All texts of a batch form one sequence, cut into chunks of CHUNK characters, and all chunks take each step together in numpy.
A chunk's state map takes the state at its entry to the state at its exit and the counts of its characters. The chunks run
from the start state first; then an exclusive scan gives every chunk its predecessor's exit as entry. From its first reset on
a chunk's map is constant, so only the characters before it run again; a chunk without a reset passes its new exit on, until
no entry changes. Counts of texts come from the prefix sums over all characters.

Cases: null and empty texts have no tokens; very long texts are counted whole (many chunks); repeated rows are counted each;
null doc_id is kept; extra columns are ignored; an empty table gives no rows; strings of special tokens are ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import documents
from .textcols import Texts, code_points, column, pieces

SPACE = "▁"
#: Characters of a chunk, chunks that run together, and slots of the transition table, of which half are filled at most.
CHUNK, MOST_CHUNKS, SLOTS_LOG2 = 128, 1 << 13, 20
#: The piece before the first one; every piece may follow it.
NONE = -1
_MULTIPLIER = 0x9E3779B97F4A7C15


class Transducer:
    """Characters are classes: 0 outside the vocabulary, else 1 and up. State 0 is the start, class 0 leads back to it."""

    def __init__(self, model: bytes, slots_log2: int = SLOTS_LOG2):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        special = (processor.is_byte, processor.is_control, processor.is_unknown, processor.is_unused)
        ids = [i for i in range(processor.get_piece_size()) if not any(x(i) for x in special)]
        self.score = {processor.id_to_piece(i): processor.get_score(i) for i in ids}
        alphabet = sorted({c for piece in self.score for c in piece})
        self.classes = np.zeros(0x110000, np.int32)
        for k, c in enumerate(alphabet, 1):
            self.classes[ord(c)] = k
        self.classes[ord(" ")] = self.classes[ord(SPACE)]
        self.k = len(alphabet) + 1
        number = {c: i for i, c in enumerate(alphabet, 1)}
        self.joined = np.zeros((self.k, self.k), bool)
        # Trie of the pieces; every character is a piece, of as many tokens as bytes if the vocabulary lacks it.
        self.pieces = [*self.score, *(c for c in alphabet if c not in self.score)]
        self.tokens = [1 if p in self.score else len(p.encode()) for p in self.pieces]
        self.child: list[dict[int, int]] = [{}]
        self.depth, self.piece_at = [0], [NONE]
        for i, piece in enumerate(self.pieces):
            node, last = 0, 0
            for c in piece:
                k = number[c]
                if last:
                    self.joined[last, k] = True
                if k not in self.child[node]:
                    self.child[node][k] = len(self.child)
                    self.child.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.piece_at.append(NONE)
                node, last = self.child[node][k], k
            self.piece_at[node] = i
        self.fail, level = [0] * len(self.child), list(self.child[0].values())
        while level:
            for node in level:
                for k, v in self.child[node].items():
                    self.fail[v] = self._goto(self.fail[node], k)
            level = [v for node in level for v in self.child[node].values()]
        self.whole: dict[int, bool] = {}
        self.agree: dict[tuple[int, int], bool] = {}
        self.shift, self.slots = 64 - slots_log2, 1 << slots_log2
        self._clear()
        self._probe(processor)

    def _probe(self, processor) -> None:
        """The transducer reads characters as they are, after one space; a model that does otherwise is refused."""
        for text in ("a", " a  b ", "AéＡﬁ x\ty\n", "½́하"):
            if int(self.count(column([text]))[0]) != len(processor.encode(text)):
                raise ValueError("the model normalises texts, or is no BPE model with byte fallback")

    def _goto(self, node: int, k: int) -> int:
        while node and k not in self.child[node]:
            node = self.fail[node]
        return self.child[node].get(k, 0)

    def merged(self, text: str) -> list[str]:
        """The vocabulary's greedy merges: highest score first, leftmost of equal ones."""
        parts, none = list(text), float("-inf")
        scores = [self.score.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = self.score.get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = self.score.get(parts[i] + parts[i + 1], none)
        return parts

    def _is_whole(self, piece: int) -> bool:
        """Whether the merges of a piece's own characters end in it; any other piece never comes about."""
        if piece not in self.whole:
            self.whole[piece] = len(self.merged(self.pieces[piece])) == 1
        return self.whole[piece]

    def _may_follow(self, before: int, piece: int) -> bool:
        if before == NONE:
            return True
        if (before, piece) not in self.agree:
            a, b = self.pieces[before], self.pieces[piece]
            self.agree[before, piece] = self.merged(a + b) == [a, b]
        return self.agree[before, piece]

    def _clear(self) -> None:
        self.states: list[tuple] = [(0, ((NONE, 0),))]
        self.number = {self.states[0]: 0}
        self.keys = np.full(self.slots, -1, np.int64)
        self.next, self.change = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int16)
        self.filled = 0
        if len(self.agree) > self.slots:
            self.agree = {}
        self._insert(0, 0, 0)

    def _insert(self, key: int, state: int, change: int) -> None:
        slot = (key * _MULTIPLIER & (1 << 64) - 1) >> self.shift
        while self.keys[slot] != -1:
            slot = (slot + 1) & (self.slots - 1)
        self.keys[slot], self.next[slot], self.change[slot] = key, state, change
        self.filled += 1

    def _step(self, state: tuple, k: int) -> tuple[tuple, int]:
        """The state after a character of class k, and the change of the token count."""
        node, window = state  # window: (last piece, count relative to now) at the positions of the node's characters, now last
        node = self._goto(node, k)
        at = node
        while at:
            piece = self.piece_at[at]
            if piece != NONE and self._is_whole(piece):
                before, count = window[-self.depth[at]]
                if self._may_follow(before, piece):
                    change = count + self.tokens[piece]
                    kept = window[len(window) - self.depth[node] :]
                    return (node, (*((p, n - change) for p, n in kept), (piece, 0))), change
            at = self.fail[at]
        raise AssertionError("a character is a piece of its own")

    def _look_up(self, key: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 where a key is not in the table."""
        slot = ((key.astype(np.uint64) * np.uint64(_MULTIPLIER)) >> np.uint64(self.shift)).astype(np.int64)
        found = self.keys[slot]
        odd = np.flatnonzero(found != key)
        while len(odd):
            slot[odd] = np.where(found[odd] == -1, -1, (slot[odd] + 1) & (self.slots - 1))
            odd = odd[slot[odd] >= 0]
            found[odd] = self.keys[slot[odd]]
            odd = odd[found[odd] != key[odd]]
        return slot

    def _learn(self, keys: np.ndarray) -> None:
        for key in keys.tolist():
            state, change = self._step(self.states[key // self.k], key % self.k)
            if state not in self.number:
                self.number[state] = len(self.states)
                self.states.append(state)
            self._insert(key, self.number[state], change)

    def _renewed(self, *live: np.ndarray) -> list[np.ndarray]:
        """Begins the table anew with the states that are in use; the arrays of their new numbers."""
        states = self.states
        self._clear()
        out = []
        for numbers in live:
            used, where = np.unique(numbers, return_inverse=True)
            for s in used.tolist():
                if states[s] not in self.number:
                    self.number[states[s]] = len(self.states)
                    self.states.append(states[s])
            out.append(np.array([self.number[states[s]] for s in used.tolist()], np.int64)[where])
        return out

    def changes(self, symbols: np.ndarray, reset: np.ndarray) -> np.ndarray:
        """Change of the token count at every character; reset marks characters that are read from the start state."""
        out, state = [np.zeros(0, np.int16)], 0
        size = CHUNK * min(MOST_CHUNKS, self.slots // 4)  # so many chunks need no more transitions at a step than the table has
        for at in range(0, len(symbols), size):
            part, state = self._section(symbols[at : at + size], reset[at : at + size], state)
            out.append(part)
        return np.concatenate(out)

    def _section(self, symbols: np.ndarray, reset: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """The changes, and the state after the last character, of characters that are read from that state."""
        n = len(symbols)
        rows = -(-n // CHUNK)
        symbol, fresh = np.zeros(rows * CHUNK, np.int64), np.zeros(rows * CHUNK, bool)
        symbol[:n], fresh[:n] = symbols, reset
        symbol, fresh = (np.ascontiguousarray(x.reshape(rows, CHUNK).T) for x in (symbol, fresh))
        steps = np.full(rows, CHUNK)
        steps[-1] = n - (rows - 1) * CHUNK
        has, first = fresh.any(0), fresh.argmax(0)
        out = np.zeros((CHUNK, rows), np.int16)
        entry, exit_ = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        entry[0] = state
        todo, upto, last = np.arange(rows), steps, np.ones(rows, bool)  # chunks to run, how far, and whether that is to the exit
        while len(todo):
            now = entry[todo]
            for p in range(int(upto.max())):
                if not (on := upto > p).all():
                    ended = ~on & last
                    exit_[todo[ended]] = now[ended]
                    todo, upto, last, now = todo[on], upto[on], last[on], now[on]
                key = np.where(fresh[p, todo], 0, now) * self.k + symbol[p, todo]
                slot = self._look_up(key)
                while len(missing := np.unique(key[slot < 0])):
                    if room := max(0, self.slots // 2 - self.filled):
                        self._learn(missing[:room])
                    else:
                        entry, exit_, now = self._renewed(entry, exit_, now)
                        key = np.where(fresh[p, todo], 0, now) * self.k + symbol[p, todo]
                    slot = self._look_up(key)
                now = self.next[slot].astype(np.int64)
                out[p, todo] = self.change[slot]
            exit_[todo[last]] = now[last]
            scanned = np.concatenate([entry[:1], exit_[:-1]])
            todo = np.flatnonzero(scanned != entry)
            entry[todo] = scanned[todo]
            todo = todo[~has[todo] | (first[todo] > 0)]
            last = ~has[todo]
            upto = np.where(last, steps[todo], first[todo])
        return out.T.reshape(-1)[:n], int(exit_[-1])

    def count(self, t: Texts) -> np.ndarray:
        """Tokens of every text."""
        points = np.frombuffer(t.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        ends = code_points(t)[t.offsets]
        some = np.diff(ends) > 0
        begins = ends[:-1][some]
        symbols = np.insert(self.classes[points], begins, self.classes[ord(SPACE)])
        width = np.insert(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), begins, 0)
        reset = np.ones(len(symbols), bool)
        reset[1:] = ~self.joined[symbols[:-1], symbols[1:]]
        starts = begins + np.arange(len(begins))
        reset[starts] = True
        tokens = np.concatenate([[0], np.cumsum(np.where(symbols == 0, width, self.changes(symbols, reset)))])
        out = np.zeros(len(t), np.int64)
        out[some] = np.diff(tokens[np.append(starts, len(symbols))])
        return out


@lru_cache(maxsize=2)
def transducer(model: bytes) -> Transducer:
    return Transducer(model)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text; model is the path of a sentencepiece model on the driver."""
    with open(model, "rb") as f:
        vocabulary = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for batch in batches:
            for t in pieces(column(batch.column(1))):
                n = machine.count(t)
                columns = [batch.column(0).slice(t.first, len(t)), pa.array(np.diff(t.offsets)), pa.array(n), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op12_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
