import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from sojourn.llm import search
from sojourn.llm.search import Shard, SparseTable, ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, queries, best):
    """Every document scored for every query."""
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    count, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries:
        scored = []
        for doc, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * count) // length
            score = 0
            for t in terms(text):
                if c[t]:
                    score += floor(1000 * log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored, key=lambda s: s[:3])[:best])]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def random_text(rng, words):
    return " ".join(f"w{int(60 * rng.random() ** 3)}" for _ in range(words))


@pytest.mark.parametrize("rows, cells, at_once", [(search.SHARD_DOCS, search.PANEL_CELLS, 256), (40, 64, 2)])
def test_same_as_scoring_all(spark, monkeypatch, rows, cells, at_once):
    rng = np.random.default_rng(rows)
    docs = [(i, random_text(rng, int(rng.integers(0, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)]  # equal scores
    queries = [(i, random_text(rng, int(rng.integers(0, 25)))) for i in range(25)] + [(99, docs[7][1]), (100, "nowhere")]
    monkeypatch.setattr(search, "SHARD_DOCS", rows)
    monkeypatch.setattr(search, "PANEL_CELLS", cells)
    monkeypatch.setattr(search, "SPLITS_AT_ONCE", at_once)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    asked = spark.createDataFrame(queries, "item_id bigint, text string")
    assert result(ranked_search(frame, asked)) == plain(docs, queries, 10)
    monkeypatch.setattr(search, "BLOCK_TERMS", 20)
    assert result(ranked_search(frame, asked, 3)) == plain(docs, queries, 3)


def test_edges(spark):
    long = "Alpha beta " * 30_000
    docs = [(None, "alpha"), (1, None), (2, ""), (3, long), (3, long), (4, "ÉTÉ alpha-été 12"), (5, "!!"), (None, "beta")]
    queries = [(1, "alpha ALPHA beta"), (1, "Été 12"), (None, "alpha"), (2, None), (3, ""), (4, "?")]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id bigint, text string, q int, score int")
    asked = spark.createDataFrame([(*q, "x") for q in queries], "item_id bigint, text string, terms string")
    assert result(ranked_search(frame, asked)) == plain(docs, queries, 10)
    assert ranked_search(frame.limit(0), asked).count() == 0
    assert ranked_search(frame, asked.limit(0)).count() == 0


def test_range_maximum():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 50, 300)
    table = SparseTable(values, 300)
    start = rng.integers(0, 300, 500)
    end = start + 1 + (rng.random(500) * (300 - start)).astype(int)
    found = table.argmax(start, end)
    assert all(a <= i < b and values[i] == values[a:b].max() for a, b, i in zip(start, end, found))


def test_search_leaves_documents_unscored():
    """A few documents with a rare term end the search before the many with a common one are split."""
    rng = np.random.default_rng(6)
    doc = np.r_[np.arange(20_000), np.arange(0, 20_000, 1000)]
    term = np.r_[np.zeros(20_000, int), np.ones(20, int)]
    impact = np.r_[rng.integers(1, 50, 20_000), rng.integers(1000, 2000, 20)]
    shard = Shard(doc, term, impact, 20_000)
    asked = []
    whole = shard.table.argmax
    shard.table.argmax = lambda a, b: asked.append(len(a)) or whole(a, b)
    docs, scores = shard.search(np.array([0, 1]), np.array([1, 1]), 10)
    total = np.bincount(doc, impact, 20_000).astype(int)
    order = np.lexsort((np.arange(20_000), -total))[:10]
    assert docs.tolist() == order.tolist() and scores.tolist() == total[order].tolist()
    assert sum(asked) < 500
