import os

import numpy as np
import pytest

from sojourn.llm.embeddings import Hashing, buckets_of, hadamard, near_vectors, unit


def brute(rows, least=0.95):
    """vec_id, n_links, component_id, kept by all cosines."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [set() for _ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(ok):
        for j in ok[a + 1 :]:
            x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(x) == len(y) and (rows[i][1] == rows[j][1] or x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least):
                links[i].add(j)
                links[j].add(i)
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    names = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        names[r] = k if names.get(r) is None else min(names[r], k if k is not None else names[r])
    return [(k, len(links[i]), names[find(i)], k == names[find(i)]) for i, (k, _) in enumerate(rows)]


def got(rows):
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def test_hadamard_is_orthonormal():
    h = hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def test_probability_to_meet_at_the_threshold():
    rng = np.random.default_rng(1)
    a = unit(rng.standard_normal((4000, 64)))
    other = rng.standard_normal((4000, 64))
    other = unit(other - (other * a).sum(1, keepdims=True) * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * other
    x, y = (buckets_of(v, Hashing()).reshape(len(v), -1) for v in (a, b))
    assert np.mean((x[:, :, None] == y[:, None, :]).any(axis=(1, 2))) > 0.99


@pytest.mark.parametrize("piece_rows", [1024, 8])
def test_all_embeddings_against_all_cosines(spark, piece_rows):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    want = sorted(brute(rows), key=repr)
    assert got(near_vectors(table, piece_rows=piece_rows)) == want


def test_recall_and_groups_on_many_links(spark):
    folder = "/root/testdata/check_s"
    if not os.path.isdir(folder):
        pytest.skip("these tables are absent")
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    frame = table.toPandas().sort_values("vec_id")
    x = unit(np.stack(frame.embedding).astype(float))
    links = np.zeros(len(x), dtype=int)
    for s in range(0, len(x), 1000):
        links[s : s + 1000] = (x[s : s + 1000] @ x.T >= 0.95).sum(axis=1) - 1
    mine = near_vectors(table).toPandas().sort_values("vec_id")
    assert links.sum() > 10_000
    assert (mine.n_links.to_numpy() <= links).all() and mine.n_links.sum() >= 0.99 * links.sum()
    assert ((mine.component_id == mine.vec_id) == mine.kept).all() and (mine.kept | (links > 0)).all()


def test_odd_vectors_and_large_groups(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8)
    rows = [(i, (base + 0.02 * rng.standard_normal(8)).tolist()) for i in range(60)] + [(100 + i, base.tolist()) for i in range(200)]
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0, None] + [0.0] * 6), (404, [float("nan")] * 8), (405, [float("inf")] * 8)]
    rows += [(406, [1e-300] * 8), (407, [1e300] * 8), (408, [2.0]), (409, [3.0]), (410, [-2.0]), (None, base.tolist()), (411, [1.0, 2.0, 3.0]), (411, [1.0, 2.0, 3.0]), (412, None)]
    table = spark.createDataFrame([(k, v, 1, "n") for k, v in rows], "vec_id bigint, embedding array<double>, node int, links string")
    want = brute([(k, v) for k, v in rows if k not in (406, 407)])
    mine = [tuple(r) for r in near_vectors(table, piece_rows=16).collect()]
    pair = [r for r in mine if r[0] in (406, 407)]
    assert sorted(pair) == [(406, 1, 406, True), (407, 1, 406, False)]
    assert sorted((r for r in mine if r not in pair), key=repr) == sorted(want, key=repr)
    assert near_vectors(table.limit(0)).count() == 0
