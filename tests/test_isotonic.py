import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression

from sojourn.operators.isotonic import isotonic_values, pool, pooled_blocks


def plain(points):
    """Every value by the max-min formula."""
    n = len(points)
    sums, weights = [0.0], [0.0]
    for _, t, w in points:
        sums.append(sums[-1] + t)
        weights.append(weights[-1] + w)
    mean = lambda a, b: (sums[b] - sums[a]) / (weights[b] - weights[a])
    return [max(min(mean(j, k) for k in range(i + 1, n + 1)) for j in range(i + 1)) for i in range(n)]


def points_of(kind, n, rng):
    makers = {
        "random": lambda i: rng.randrange(9),
        "falling": lambda i: n - i,
        "rising": lambda i: i,
        "saw": lambda i: i + 30 * (i % 7),
        "steps": lambda i: i // 40 * 3 + rng.randrange(4),
    }
    rows = []
    for i in range(n):
        w = rng.randrange(1, 6)
        rows.append((i / 7, float(makers[kind](i) * w), float(w)))
    return rows


@pytest.mark.parametrize("kind", ["random", "falling", "rising", "saw", "steps"])
@pytest.mark.parametrize("slice_rows", [None, 20])
def test_equals_plain_pooling(spark, kind, slice_rows):
    points = points_of(kind, 150, random.Random(kind))
    frame = spark.createDataFrame(random.Random(1).sample(points, len(points)), "s double, t double, w double")
    blocks = pooled_blocks(frame, score="s", total="t", weight="w", slice_rows=slice_rows)
    found = blocks.orderBy("low").collect()
    assert all(a.high < b.low and a.value < b.value for a, b in zip(found, found[1:]))
    assert sum(r.weight for r in found) == sum(w for _, _, w in points)
    out = isotonic_values(frame, blocks, score="s", output="v", slice_rows=slice_rows).orderBy("s").collect()
    assert [r.v for r in out] == pytest.approx(plain(points))


def test_values_between_and_beyond_blocks_equal_the_library(spark):
    rng = random.Random(5)
    points = points_of("random", 60, rng)
    frame = spark.createDataFrame([(s, t / w, w) for s, t, w in points], "s double, label double, w double")
    model = IsotonicRegression(featuresCol="v", labelCol="label", weightCol="w").fit(VectorAssembler(inputCols=["s"], outputCol="v").transform(frame))
    asked = spark.createDataFrame([(rng.uniform(-3, 12),) for _ in range(80)] + [(0.0,), (59 / 7,), (0.0,)], "s double")
    want = model.transform(VectorAssembler(inputCols=["s"], outputCol="v").transform(asked)).orderBy("s").collect()
    sums = spark.createDataFrame(points, "s double, t double, w double")
    blocks = pooled_blocks(sums, score="s", total="t", weight="w", slice_rows=10)
    got = isotonic_values(asked, blocks, score="s", output="v", slice_rows=9).orderBy("s").collect()
    assert [r.v for r in got] == pytest.approx([r.prediction for r in want])


def test_nulls_and_no_points(spark):
    rows = spark.createDataFrame([(None, 1.0, 1.0), (0.5, None, 1.0), (0.4, 1.0, 0.0), (0.3, 1.0, 2.0)], "s double, t double, w double")
    blocks = pooled_blocks(rows, score="s", total="t", weight="w")
    assert [(r.low, r.high, r.value) for r in blocks.collect()] == [(0.3, 0.3, 0.5)]
    out = isotonic_values(rows.select("s"), blocks, score="s", output="v").collect()
    assert sorted((r.s or -1, r.v) for r in out if r.s) == [(0.3, 0.5), (0.4, 0.5), (0.5, 0.5)] and [r.v for r in out if r.s is None] == [None]
    none = pooled_blocks(rows.limit(0), score="s", total="t", weight="w")
    assert none.count() == 0 and isotonic_values(rows, none, score="s", output="v").filter("v is not null").count() == 0


def test_pool_keeps_sums():
    rows = [(float(i), float(i), float(t), 1.0, i) for i, t in enumerate([3, 1, 2, 2, 9, 0])]
    assert pool(rows) == [(0.0, 3.0, 8.0, 4.0, 0), (4.0, 5.0, 9.0, 2.0, 4)]
