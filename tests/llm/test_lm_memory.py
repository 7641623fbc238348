"""What a worker of op4 holds while it scores."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from factweave.llm import lm_scoring


def test_a_worker_scores_a_long_batch_in_little_memory():
    rng = np.random.default_rng(1)
    word = [f"w{i}" for i in range(5000)]
    texts = [" ".join(word[i] for i in rng.integers(0, 5000, 900)) for _ in range(400)]
    prior = np.full(lm_scoring.SYMBOLS, 1 / lm_scoring.SYMBOLS)
    model = lm_scoring.Model(np.arange(1, lm_scoring.FREQUENT + 1, dtype=np.uint64), prior)
    k = {"N": 10, "V": 5, "n": np.ones(lm_scoring.CLASSES), "v": np.ones(lm_scoring.CLASSES), "hash": np.zeros(0, np.uint64), "c": np.zeros(0, np.int64), "end": lm_scoring.FREQUENT}
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], ["row", "text"])
    tracemalloc.start()
    for _ in lm_scoring._score(model, k)(iter([batch])):
        pass
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    print("held, peak", held, peak)
    assert peak < 70 << 20 and held < 30 << 20
