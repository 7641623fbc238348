"""The columnar text primitives against regular expressions and sets, on arbitrary texts."""

from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.llm import textcols

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0bab é☃\U0001f600AZ", max_size=40)), max_size=6)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_lines(texts):
    t = textcols.column(texts)
    s = textcols.words(t)
    raw = t.data.tobytes()
    found = [raw[a:b].decode() for a, b in zip(s.start, s.end, strict=True)]
    want = [WORD.findall(x or "") for x in texts]
    assert found == [w for ws in want for w in ws]
    assert s.counts.tolist() == [len(ws) for ws in want]
    ln = textcols.lines(t)
    assert [raw[a:b].decode() for a, b in zip(ln.start, ln.end, strict=True)] == [x for y in texts for x in (y or "").split("\n")]
    points = textcols.code_points(t)
    assert np.diff(points[t.offsets]).tolist() == [len(x or "") for x in texts]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_hashes_and_shingles(texts):
    t = textcols.column(texts)
    s = textcols.words(t)
    h = textcols.hashes(t, s)
    raw = t.data.tobytes()
    by_word: dict = {}
    for a, b, x in zip(s.start, s.end, h, strict=True):
        assert by_word.setdefault(raw[a:b], x) == x
    assert len(set(by_word.values())) == len(by_word)
    _, bounds = textcols.shingle_sets(t)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = []
    for x in texts:
        w = WORD.findall((x or "").translate(lower))
        want.append(len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)
    assert np.diff(bounds).tolist() == want


@settings(max_examples=50, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_pieces_hold_whole_texts(texts, limit):
    t = textcols.column(texts)
    got = [p.data[a:b].tobytes().decode() for p in textcols.pieces(t, limit) for a, b in zip(p.offsets[:-1], p.offsets[1:], strict=True)]
    assert got == [x or "" for x in texts]
