import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from sojourn.llm import divergence
from sojourn.llm.divergence import block_distances, reordered, run_distance, runs, source_divergence, whole_shares

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    """The same table by dictionaries and fractions."""
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        found = TERM.findall((text or "").translate(UPPER))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda n, words: 1 + int(Fraction(10**9 * (n + 5), words + 5 * len(kept)))
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s][t], n[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(n.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda f: (-f[1], f[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def random_rows(seed, docs, words):
    rng = np.random.default_rng(seed)
    names = ["Été", "the", "OF", "x", "中文", "ß", *[chr(97 + i) * 2 for i in range(words)]]
    rows = []
    for i in range(docs):
        source = "hot" if rng.random() < 0.5 else f"s{rng.integers(5)}"
        text = " ".join(names[int(len(names) * rng.random() ** 2)] + str(rng.integers(3)) for _ in range(rng.integers(1, 20)))
        rows.append((i, text, ["en", "de", None][rng.integers(3)], source))
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string"


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("cells", [divergence.BLOCK_CELLS, 8])
def test_same_as_plain_counts(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)  # many small blocks give the same sums
    rows = random_rows(1, 150, 20)
    assert result(source_divergence(spark.createDataFrame(rows, SCHEMA), 3, 4)) == plain(rows, 3, 4)


def test_edges(spark):
    long = "word other " * 20_000
    rows = [(1, None, None, None), (1, None, None, None), (2, "", "en", "a"), (3, long, "en", "b"), (3, long, "en", "b"), (None, "1 2 3", "xx", "a"), (5, "q", "xx", None)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", total bigint, term string")
    for least in (1, 2, 30):
        assert result(source_divergence(docs, least, 50)) == plain(rows, least, 50)
    assert source_divergence(docs.limit(0)).count() == 0


def test_run_columns():
    rng = np.random.default_rng(2)
    table = rng.integers(0, 4, (500, 3)) * rng.integers(0, 2, (500, 3))
    moved = reordered(table)
    assert sorted(map(tuple, moved)) == sorted(map(tuple, table))
    assert sum(len(runs(c)[0]) for c in moved.T) < sum(len(runs(c)[0]) for c in table.T)
    a, b = moved[:, 0], moved[:, 2]
    assert run_distance(runs(a), runs(b), 500) == np.abs(a - b).sum()
    term, source = (x.ravel() for x in np.indices(table.shape))
    totals = np.array([5000, 7000, 123])
    want = {(i, j): sum(abs(1 + 10**9 * (int(r[i]) + 5) // int(totals[i]) - 1 - 10**9 * (int(r[j]) + 5) // int(totals[j])) for r in table) for i in range(3) for j in range(i + 1, 3)}
    assert {(i, j): v for i, j, v in block_distances(term, source, table.ravel(), totals)} == want


def test_whole_shares_are_exact():
    total = 8_999_999_999_999_999
    count = np.array([0, 1, 5, total // 3, total - 1, total])
    assert whole_shares(count, total).tolist() == [1 + 10**9 * int(c) // total for c in count]
