"""One-hot columns whose level names stay in a table."""

import pytest
from pyspark.sql import functions as F

from sojourn.plans import explain, windows
from sojourn.plans import training as tr

FEATURES = tr.Features(("x",), ("a", "b"), ("id",), "label")


@pytest.fixture(scope="module")
def table(spark):
    level = F.when(F.col("id") % 29 == 0, None).otherwise(F.format_string("l%02d", F.pmod(F.xxhash64("id"), F.lit(40)) % (1 + F.col("id") % 40)))
    rows = spark.range(3000).select("id", (F.col("id") % 17).cast("double").alias("x"), level.alias("a"), F.concat(F.lit("b"), F.col("id") % 3).alias("b"))
    noise = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100
    return rows.withColumn("label", (noise < F.when(F.col("a") < "l10", 0.8).otherwise(0.3)).cast("int")).checkpoint()


def fitted(table, monkeypatch, few):
    monkeypatch.setattr(tr, "FEW_LEVELS", few)
    return tr.fit(tr.logistic(maxIter=15, regParam=0.01), table, FEATURES)


def test_both_ways_give_one_model(spark, table, monkeypatch, tmp_path):
    plain, coded = fitted(table, monkeypatch, 200), fitted(table, monkeypatch, 10)
    assert plain.preparation.coded == {} and set(coded.preparation.coded) == {"a__x"}
    odd = spark.createDataFrame([(-1, 1.0, "never seen", "b0", 0), (-2, None, None, None, 1)], "id bigint, x double, a string, b string, label int")
    scored = [{r.id: r.score for r in f.score(table.unionByName(odd)).collect()} for f in (plain, coded)]
    assert len(scored[0]) == 3002 and scored[0].keys() == scored[1].keys()
    assert max(abs(s - scored[1][i]) for i, s in scored[0].items()) < 1e-9
    coded.save(f"{tmp_path}/coded")
    again = tr.load_fitted(spark, f"{tmp_path}/coded")
    assert {r.id: r.score for r in again.score(table.unionByName(odd)).collect()} == pytest.approx(scored[1])
    names = [{r.feature: r.coefficient for r in explain.coefficient_table(f, table.limit(5)).collect()} for f in (plain, coded)]
    assert "a=_rare" in names[0] and names[0] == pytest.approx(names[1])


def test_windows_take_coded_columns(table, monkeypatch):
    monkeypatch.setattr(tr, "FEW_LEVELS", 10)
    blocks = table.withColumn("block", F.col("id") % 3)
    window = windows.encode_window(windows.count_parts(blocks, FEATURES, ["block"]), blocks, F.col("block") < 2, F.col("block") == 2, ["label"])
    assert (window.train.count(), window.held.count()) == (2000, 1000)
    assert set(window.preparation.coded) == {"a__x"}


def test_a_column_of_very_many_levels_trains(spark, monkeypatch):
    monkeypatch.setattr(tr, "MIN_LEVEL_ROWS", 2)
    many = spark.range(200_000).select("id", F.lit(0.0).alias("x"), F.format_string("level %06d", F.col("id") % 100_000).alias("a"), F.lit("b").alias("b"), (F.col("id") % 100_000 % 2).cast("int").alias("label"))
    model = tr.fit(tr.logistic(maxIter=5), many, FEATURES)
    assert model.preparation.coded == {"a__x": 100_000} and "a__x" not in model.preparation.literals
    assert model.score(many).filter((F.col("score") > 0.5) != (F.col("label") == 1)).count() == 0
