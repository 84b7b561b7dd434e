import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sojourn.llm.simhash import GrayTree, fingerprint, gray_rank, hamming_links, near_duplicates
from sojourn.llm.components import connected_components


def plain_fingerprint(text, words):
    tokens = [t for t in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if t]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, radius):
    codes = np.array(codes, dtype=np.uint64)
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


@pytest.mark.parametrize("text", ["", "  \n\t ", None, "one", "One two\nTHREE", "a b c d e f g a b c d", "É é x " * 400])
def test_fingerprint_of_words(text):
    assert fingerprint(text, 4) == plain_fingerprint(text, 4)


def test_gray_rank_inverts_the_gray_code(spark):
    rows = spark.range(200).select("id", gray_rank(F.col("id").bitwiseXOR(F.shiftright("id", 1))).alias("rank"))
    assert rows.filter("id <> rank").count() == 0


@pytest.mark.parametrize("radius", [0, 3, 4])
def test_tree_finds_all_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(400)], dtype=np.uint64)
    codes = np.sort(np.unique(np.concatenate([base, np.repeat(base, 10) ^ flips])))
    tree = GrayTree(codes, np.zeros(len(codes), dtype=np.int64))
    q, found = tree.search(codes, np.zeros(len(codes), dtype=np.int64), radius, np.arange(len(codes)))
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= radius}
    assert set(zip(q.tolist(), found.tolist())) == want


@pytest.mark.parametrize("piece_rows", [4096, 16])
def test_links_join_what_brute_force_joins(spark, piece_rows):
    rng = np.random.default_rng(5)
    hub = int(rng.integers(0, 1 << 63))
    codes = {int(c) for c in rng.integers(0, 1 << 63, 300)} | {0, (1 << 64) - 1}
    codes |= {hub ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (300, 3))}  # one dense group
    codes = sorted(codes)
    rows = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "code bigint")
    got = {r.node: r.component for r in connected_components(hamming_links(rows, 4, piece_rows)).collect()}
    signed = [int(np.uint64(c).astype(np.int64)) for c in codes]
    want = brute_components(codes, 4)
    groups = {}
    for s, w in zip(signed, want):
        groups.setdefault(w, set()).add(s)
    mine = {}
    for s in signed:
        mine.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_every_document_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [plain_fingerprint(t, 4) for _, t in rows]
    roots = brute_components(prints, 4)
    first = {}
    for (i, _), root in zip(rows, roots):
        first[root] = min(i, first.get(root, i))
    want = {(i, f"{p:016x}", first[root], i == first[root]) for (i, _), p, root in zip(rows, prints, roots)}
    assert {tuple(r) for r in near_duplicates(docs, 4, 4).collect()} == want


def test_nulls_ties_and_empty_tables(spark):
    schema = "doc_id bigint, text string, fingerprint string, component_id int"
    rows = [(3, None, "x", 1), (2, "", "x", 1), (None, " \n", "x", 1), (9, "a b c d e f", "x", 1), (9, "A b c d e f", "x", 1), (None, "z" * 50000, "x", 1)]
    got = near_duplicates(spark.createDataFrame(rows, schema), 4, 4).collect()
    assert len(got) == 6
    assert sorted(r.component_id for r in got if r.fingerprint == "0" * 16) == [2, 2, 2]
    assert [r.component_id for r in got if r.doc_id == 9] == [9, 9]
    assert [r.component_id for r in got if r.doc_id is None and r.fingerprint != "0" * 16] == [None]
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
