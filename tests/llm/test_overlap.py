import numpy as np
import pytest
from test_pipeline import jaccard_components

import corpus_pipeline as pipeline
from sojourn.llm import overlap
from sojourn.llm.exact import packed
from sojourn.llm.overlap import band_keys, links, similar_groups
from sojourn.llm.simhash import shingles
from sojourn.llm.store import saved


def kept(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id for r in pipeline.near(spark, saved(table, "table"), "").select("doc_id").collect()}


def test_versions_of_a_template_are_all_checked(spark):
    rng = np.random.default_rng(11)
    base, texts = [f"w{i}" for i in rng.integers(0, 5000, 300)], []
    for k in range(80):
        words = list(base)
        for at in rng.choice(300, 4, replace=False):
            words[at] = f"new{k}x{at}"
        texts.append(" ".join(words))
    assert kept(spark, texts) == set(jaccard_components(texts))


def test_repeated_passages_count_once(spark):
    rng, texts = np.random.default_rng(12), []
    for k in range(20):
        words = [f"d{k}w{i}" for i in rng.integers(0, 5000, 300)]
        texts += [" ".join(words), " ".join(words + words[100:130] * 20)]
    assert kept(spark, texts) == set(range(0, 40, 2)) == set(jaccard_components(texts))


@pytest.mark.parametrize("piece_rows, sent", [(4096, 500_000), (8, 0)])
def test_pieces_of_a_bucket_meet(spark, monkeypatch, piece_rows, sent):
    monkeypatch.setattr(overlap, "BROADCAST_ROWS", sent)
    rng = np.random.default_rng(13)
    base, texts = [f"w{i}" for i in range(200)], []
    for k in range(120):
        words = list(base)
        for at in rng.choice(200, k % 8, replace=False):
            words[at] = f"new{k}x{at}"
        texts.append(" ".join(words))
    rows = packed(saved(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "table"))
    numbered, labels = similar_groups(rows, piece_rows=piece_rows)
    ids = {r.n: r.doc_id for r in numbered.collect()}
    group = {ids[r.node]: r.component for r in labels.collect()}
    mine, want = {}, {}
    for i, root in enumerate(jaccard_components(texts)):
        mine.setdefault(group.get(i, f"own{i}"), []).append(i)
        want.setdefault(root, []).append(i)
    assert sorted(mine.values()) == sorted(want.values())


@pytest.mark.parametrize("side", [None, np.arange(60) % 2])
def test_links_span_what_is_verified(side):
    rng = np.random.default_rng(15)
    base = rng.integers(0, 1 << 60, 50).astype(np.uint64)
    sets = [np.unique(np.r_[base[: rng.integers(35, 51)], rng.integers(0, 1 << 60, rng.integers(0, 12)).astype(np.uint64)]) for _ in range(58)]
    sets += [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]  # texts without words are alike
    label = np.r_[np.arange(50), np.full(10, 7)]
    found = links(np.arange(60), label, sets, 0.8, side)
    parent = label.copy()

    def merge(a, b):
        if parent[a] == parent[b]:
            return False
        parent[parent == parent[a]] = parent[b]
        return True

    assert all(merge(a, b) for a, b in found)  # no link is more than needed
    spanned, parent = parent, label.copy()
    for a in range(60):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and (side is None or side[a] != side[b]):
                merge(a, b)
    assert len(np.unique(np.c_[spanned, parent], axis=0)) == len(np.unique(parent)) == len(np.unique(spanned))


def test_bands_propose_nearly_all_pairs_just_above_the_threshold():
    rng, pairs, found = np.random.default_rng(14), 0, 0
    for k in range(600):
        words = [f"w{i}" for i in rng.integers(0, 5000, 300)]
        other = list(words)
        for at in rng.choice(300, 6, replace=False):
            other[at] = f"new{k}x{at}"
        a, b = " ".join(words), " ".join(other)
        x, y = set(shingles(a, 5)), set(shingles(b, 5))
        if 0.8 <= len(x & y) / len(x | y) < 0.85:
            pairs += 1
            found += bool((band_keys(a, 5)[1] == band_keys(b, 5)[1]).any())
    assert pairs > 100 and found >= 0.99 * pairs
