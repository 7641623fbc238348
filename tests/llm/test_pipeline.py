"""The stages of corpus_pipeline.py on their predecessors' rows, against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_operators import ROWS, SCHEMA

import corpus_pipeline
from factweave.llm import quality_classifier

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, outs = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outs.append(docs)
        assert k == 4 or docs.columns == columns
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good = {r["doc_id"] for r in quality_classifier.op5_quality_classifier(spark, sf_dir).collect() if r["predicted"]}
    assert {r["doc_id"] for r in outs[0].collect()} == good

    groups = defaultdict(list)
    for i in good:
        groups[re.sub(r"[\x20\x09-\x0D]", "", before[i] or "")].append(i)
    one = {min(g, key=lambda i: (-len(before[i] or ""), i)) for g in groups.values()}
    assert sorted(r["doc_id"] for r in outs[1].collect()) == sorted(one)

    sets = {}
    for i in one:
        w = WORD.findall((before[i] or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    top = {i: i for i in one}
    for a in sorted(one):
        for b in sorted(one):
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                old, new = top[b], top[a]
                top = {i: (min(old, new) if t in (old, new) else t) for i, t in top.items()}
    leaders = {i for i in one if top[i] == i}
    assert sorted(r["doc_id"] for r in outs[2].collect()) == sorted(leaders)

    mixed = Counter(r["doc_id"] for r in outs[3].collect())
    assert set(mixed) == leaders and max(mixed.values()) <= 2

    tokens, bins = Counter(), defaultdict(list)
    source = {r["doc_id"]: r["source"] for r in outs[2].collect()}
    for r in outs[4].collect():
        tokens[r["doc_id"]] += r["tokens"]
        bins[r["shard"], r["bin"]].append(r)
    assert tokens == Counter({i: n * len(WORD.findall(before[i] or "")) for i, n in mixed.items()})
    for b in bins.values():
        assert sum(r["tokens"] for r in b) <= 2048
        assert len({source[r["doc_id"]] for r in b}) == len(b)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "shard", "bin", "offset", "tokens"] and out.count() > 0


@pytest.fixture(scope="module")
def marked(tmp_path_factory):
    """A folder with labels for the awkward rows."""
    at = tmp_path_factory.mktemp("marked")
    pq.write_table(pa.table({"doc_id": [1, 2, 3, None, 5, 7], "quality": [1, 0, 1, 1, None, 0], "toxic": [0] * 6}), at / "labels.parquet")
    return str(at)


def test_stages_on_awkward_rows(spark, marked):
    # Null and empty texts, repeated rows, rows without an id, a very long text, columns with the operators' own names.
    rows = ROWS[:60] + ROWS[-12:]
    docs = spark.createDataFrame(rows, SCHEMA)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, marked)
        got = out.collect()
        if k < 4:
            assert out.columns == docs.columns and {tuple(r) for r in got} <= set(rows), name
        if name == "exact dedup":
            norm = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in got]
            assert len(norm) == len(set(norm)) == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows})
        if name == "MinHash near-dedup":
            assert {r[0] for r in rows if r[1] in (None, "", " \t\n")} <= {r["doc_id"] for r in got}
        if name == "mixing":
            assert {tuple(r) for r in got} == set(rows)
        if k == 4:
            want = Counter()
            for r in rows:
                want[r[0]] += len(WORD.findall(r[1] or ""))
            tokens = Counter()
            for r in got:
                tokens[r["doc_id"]] += r["tokens"]
            assert tokens == want
        assert stage(spark, docs.limit(0), marked).count() == 0, name
