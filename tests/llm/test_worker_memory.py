"""What a stage of the pipeline leaves behind in workers and state stores."""

import numpy as np
import pyarrow as pa

from sojourn.llm import simhash, store
from sojourn.llm.exact import STATE_STORE, state_on_disk


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_a_stage_gives_freed_memory_back():
    def run(batches):
        for batch in batches:
            # many small blocks under one that stays: freed, but not at the top of the heap
            blocks = [bytearray(60_000) for _ in range(3000)]
            kept.append(bytearray(60_000))
            del blocks
            yield batch

    kept = []
    before = _resident()
    batch = pa.record_batch([pa.array([1, 2])], ["x"])
    assert list(store.released(run)(iter([batch]))) == [batch]
    assert _resident() - before < 100 << 20


def test_a_search_of_like_codes_keeps_few_comparisons_open(monkeypatch):
    codes = np.unique(np.random.default_rng(1).integers(0, 1 << 11, 4000, dtype=np.uint64))
    sizes, real = [], simhash.GrayTree.search

    def watched(self, queries, *rest):
        sizes.append(len(queries) * len(self.codes))
        return real(self, queries, *rest)

    monkeypatch.setattr(simhash.GrayTree, "search", watched)
    simhash._links(codes, np.zeros(len(codes), np.int64), 4)
    assert max(sizes) <= 1 << 18


def test_ended_streams_close_their_stores_soon(spark):
    with state_on_disk(spark):
        for key, value in STATE_STORE.items():
            assert spark.conf.get(key) == value
        assert spark.conf.get("spark.sql.streaming.stateStore.maintenanceInterval") == "10s"
