"""Quantiles of whole columns by brackets, and how little fitting does with them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sojourn.operators import skew
from sojourn.plans import training as tr

WANTED = {"low": 0.01, "mid": 0.5, "high": 0.99, "least": 0.0, "most": 1.0}


@pytest.mark.parametrize("near", [skew.NEAR, 1e-9])
def test_brackets_are_exact(spark, monkeypatch, near):
    """Also where no bracket holds its ranks."""
    monkeypatch.setattr(skew, "SKETCH", 300)
    monkeypatch.setattr(skew, "NEAR", max(near, 4 / 300) if near == skew.NEAR else near)
    rng = random.Random(4)
    rows = [(rng.gauss(0, 1), float(rng.randrange(3)), rng.choice([None, float("nan"), rng.random()]), None) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    got = skew.column_quantiles(frame, ["a", "b", "c", "d"], WANTED)
    assert set(got["d"].values()) == {None}
    for i, name in enumerate("abc"):
        values = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        for q, share in WANTED.items():
            assert got[name][q] == pytest.approx(float(np.quantile(values, share)), rel=1e-12)


def test_a_winsored_fit_computes_its_bounds_once(spark):
    rows = spark.range(3000).select(
        "id", (F.col("id") % 50).cast("double").alias("x"), F.col("id").cast("double").alias("days"), (F.col("id") % 3).cast("string").alias("k")
    )
    features = tr.Features(("x",), ("k",), ("id",), "days")
    context = spark.sparkContext
    context.setJobGroup("fit", "one winsored fit")
    model = tr.fit(tr.ridge(maxIter=3), rows, features, winsor=(0.01, 0.99))
    context.setJobGroup("rest", "")
    assert len(context.statusTracker().getJobIdsForGroup("fit")) <= 45
    assert model.preparation.medians["x__n"] == 24.5


def test_a_constant_reads_its_label_only(spark):
    rows = spark.createDataFrame([(i, float(i), "x" * 50) for i in range(10)], "id int, days double, other string")
    assert tr._read(rows, tr.dummy_regressor(), tr.Features((), ("other",), ("id",), "days"), None) == ["days"]
    assert tr.fit(tr.dummy_regressor(), rows, tr.Features((), ("other",), ("id",), "days")).constant == 4.5
