"""Steps of a fit: vectors in one step, sums of target encoding in one pass, places of a shuffle as plain columns."""

import math

from pyspark.sql import functions as F

from sojourn.operators import encoders as en
from sojourn.operators.skew import shuffled_place, with_shuffled_place
from sojourn.plans import calibration as cal
from sojourn.plans import training as tr

FEATURES = tr.Features(("n",), ("c",), ("id",), "label")


def _rows(spark, size=600):
    data = [(i, None if i % 17 == 0 else float("nan") if i % 19 == 0 else i % 7 + 0.5, None if i % 13 == 0 else "abcd"[i % 4] if i % 50 else "rare", int(i % 4 < 1 or i % 7 > 4)) for i in range(size)]
    return spark.createDataFrame(data, "id bigint, n double, c string, label int")


def test_one_step_makes_the_vectors_of_the_stages(spark):
    rows = _rows(spark)
    more = rows.unionByName(spark.createDataFrame([(-1, 3.0, "unseen", 1), (-2, None, None, 0)], rows.schema))
    prepared = tr.prepare(rows, FEATURES, "onehot")
    assert prepared.entries()
    staged = prepared.pipeline.transform(prepared.fill(prepared.encode(more))).select("id", "features")
    compact = prepared.apply(more, compact=True)
    want = {r.id: list(r.features.toArray()) for r in staged.collect()}
    assert {r.id: list(r.features.toArray()) for r in compact.collect()} == want
    assert compact.schema["features"].metadata == staged.schema["features"].metadata


def test_models_of_one_call_share_preparation(spark):
    found = tr.fit_all([tr.logistic(maxIter=3), tr.forest_classifier(numTrees=3, maxDepth=2)], _rows(spark), FEATURES)
    assert found[0].preparation is found[1].preparation
    both = cal.with_base_scores({m.spec.name: m for m in found}, _rows(spark))
    for m in found:
        want = {r.id: r.score for r in m.score(_rows(spark)).collect()}
        assert {r.id: r[f"score_{m.spec.name}"] for r in both.collect()} == want


def test_target_tables_are_the_two_tables(spark):
    rows = _rows(spark).withColumn("_fold", F.pmod("id", F.lit(3)).cast("int"))
    means, outside = en.target_tables(rows, "c", "label", "_fold")
    for got, want, keys in ((means, en.target_means(rows, "c", "label"), ("c",)), (outside, en.out_of_fold_table(rows, "c", "label", "_fold"), ("c", "_fold"))):
        got, want = ({tuple(r[k] for k in keys): r["encoded"] for r in t.collect()} for t in (got, want))
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


def test_places_as_columns_are_the_places_of_the_bijection(spark):
    for total in (1, 2, 5, 97, 1000):
        rows = spark.range(total).withColumnRenamed("id", "p").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")))
        out = with_shuffled_place(rows, "p", total, "k", "q").withColumn("want", shuffled_place(F.col("p"), F.lit(total).cast("bigint"), F.col("k")))
        assert out.filter("q <> want").count() == 0
        assert out.select("k", "q").distinct().count() == 5 * total
