import numpy as np

import corpus_pipeline as pipeline
from sojourn.llm import overlap
from sojourn.llm.exact import STATE_STORE
from sojourn.llm.store import saved


def test_near_takes_groups_of_the_fingerprint_operator(spark, monkeypatch):
    """Without the MinHash bands near copies are still found, and the whole texts still decide."""
    monkeypatch.setattr(overlap, "ROUNDS", overlap.ROUNDS[:1])
    rng, texts = np.random.default_rng(31), []
    for k in range(12):
        words = [f"d{k}w{i}" for i in rng.integers(0, 5000, 1500)]
        texts += [" ".join(words), " ".join(words) + " end"]
    texts += [None, "", "a b c d", "A b c d"]
    table = spark.createDataFrame([(i // 2 * 2 + (i % 2) * 100, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id bigint, text string")
    got = sorted(r.doc_id for r in pipeline.near(spark, saved(table, "table"), "").collect())
    assert got == [2 * k for k in range(14)]


def test_memory_of_the_state_is_bounded():
    assert STATE_STORE["spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"] == "true"
