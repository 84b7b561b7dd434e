import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sojourn.operators.skew import exact_quantiles, running_totals, shuffled_place, stacked_sums, with_slices


def values(rng, n):
    makers = [
        lambda: rng.gauss(0, 1), lambda: rng.expovariate(1e-6), lambda: -rng.expovariate(1e3), lambda: 0.0,
        lambda: float(rng.randrange(-4, 5)), lambda: 2.0 ** rng.randrange(-20, 20), lambda: 1e9 + rng.random(),
    ]
    return [rng.choice(makers)() for _ in range(n)]


def slice_sizes(rows, order, slice_rows):
    found = with_slices(rows, order, slice_rows).groupBy("_slice").agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high"))
    found = found.orderBy("_slice").collect()
    assert all(a.high < b.low for a, b in zip(found, found[1:]))
    return [r.n for r in found]


def test_slices_never_break_the_order(spark):
    vs = sorted(set(values(random.Random(1), 4000)))
    sizes = slice_sizes(spark.createDataFrame([(v,) for v in vs], "v double"), "v", 40)
    assert sum(sizes) == len(vs) and len(sizes) > len(vs) / 60 and max(sizes) < 80


def test_slices_follow_the_rows(spark):
    """All values in [0.5, 1), all times within a second: a hundred times the rows are a hundred times the slices."""
    for value in (F.rand(3) / 2 + 0.5, F.col("id") + 1_700_000_000_000_000):
        for n in (1_000, 100_000):
            sizes = slice_sizes(spark.range(n).select(value.alias("v")), "v", 500)
            assert max(sizes) < 750 and len(sizes) > n / 750


def test_one_slice_for_few_rows_and_none_for_no_rows(spark):
    rows = spark.createDataFrame([(1.0,), (None,), (float("inf"),), (float("-inf"),), (-0.0,)], "v double")
    assert {r._slice for r in with_slices(rows, "v").collect()} == {0}
    assert with_slices(rows.limit(0), "v", 1).collect() == []
    many = spark.createDataFrame([(float(v),) for v in range(50)] + [(7.0,)] * 500, "v double")
    by_slice = with_slices(many, "v", 5).groupBy("v").agg(F.count_distinct("_slice").alias("k")).collect()
    assert {r.k for r in by_slice} == {1}


def test_borders_are_found_once(spark):
    """Both sides of a running total use the same borders, and the borders the shuffle that made the rows."""
    rows = spark.range(5000).groupBy((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v")).agg(F.count("*").alias("n"))
    out = running_totals(rows, ["k"], "v", {"t": "n"}, slice_rows=100)
    assert len(out.collect()) == 5000
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(set(re.findall(r"Subquery (subquery#\d+)", plan))) == 1 and "ReusedSubquery" in plan
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("slice_rows", [None, 60])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_with_a_dominant_group(spark, descending, slice_rows):
    rng = random.Random(2)
    data = {}
    for v in values(rng, 900):
        data[("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", v)] = rng.randrange(1, 9)
    rows = spark.createDataFrame([(k, v, n) for (k, v), n in data.items()], "k string, v double, n bigint")
    for r in running_totals(rows, ["k"], "v", {"t": "n"}, descending=descending, slice_rows=slice_rows).collect():
        same = {v: n for (k, v), n in data.items() if k == r.k}
        assert r.t_all == sum(same.values())
        assert r.t_before == sum(n for v, n in same.items() if (v > r.v if descending else v < r.v))


def test_quantiles_equal_numpy(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.5 else None if rng.random() < 0.2 else "x", v) for v in values(rng, 1500)] + [("one", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.975, "e": 1.0}
    out = {r.k: r for r in exact_quantiles(df, ["k"], "v", qs).collect()}
    for k in {k for k, _ in rows}:
        mine = [v for kk, v in rows if kk == k]
        for name, q in qs.items():
            assert math.isclose(out[k][name], np.quantile(mine, q), rel_tol=1e-9, abs_tol=1e-12)


def test_stacked_sums_keep_null_values(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", 1, 2), (None, 1, 4)], "x string, y int, n int")
    got = {(r.variable, r.value): r.s for r in stacked_sums(rows, ["x", "y"], {"s": F.col("n")}).collect()}
    assert got == {("x", "a"): 3, ("x", None): 4, ("y", None): 1, ("y", "1"): 6}


@pytest.mark.parametrize("total", [1, 2, 3, 5, 10, 97, 1000, 4096])
def test_shuffled_places_are_bijections(spark, total):
    rows = spark.range(total).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "id", "s", shuffled_place(F.col("id"), F.lit(total).cast("bigint"), F.col("s").cast("bigint")).alias("at")
    )
    found = {}
    for r in rows.collect():
        found.setdefault(r.s, {})[r.id] = r.at
    assert all(sorted(f.values()) == list(range(total)) for f in found.values())
    if total >= 1000:
        assert len({tuple(f[i] for i in range(total)) for f in found.values()}) == 5
        assert all(sum(f[i] == i for i in f) < 20 and abs(np.corrcoef(list(f), list(f.values()))[0, 1]) < 0.4 for f in found.values())
