"""Property checks of the model plans on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from sojourn.catalog import models as m
from sojourn.operators import metrics as mx
from sojourn.plans import calibration as cal
from sojourn.plans import experiments as ex
from sojourn.plans import explain
from sojourn.plans import training as tr


@pytest.fixture(scope="module")
def rows(spark, data):
    out = m.split_rows(spark, data).persist()
    yield out
    out.unpersist()


@pytest.fixture(scope="module")
def forest(rows):
    return m._fitted_forest(rows)


def auc(scored):
    return mx.ranking_metrics(mx.score_counts(scored, [], label="label", score="score"), []).first().roc_auc


def test_planted_signal_is_found(rows, forest):
    assert auc(forest.score(rows.filter("split = 'test'"))) > 0.7


def test_calibration_lowers_brier_and_uses_its_own_period_only(rows, forest):
    held, test = forest.score(rows.filter("split = 'calibration'")), forest.score(rows.filter("split = 'test'"))
    skewed = lambda d: d.withColumn("score", F.pow("score", F.lit(3.0)))
    brier = lambda d, s: mx.calibration_errors(d, [], label="label", score=s).first().brier_score
    for method in ("isotonic", "platt"):
        out = cal.calibrate(skewed(held), label="label", method=method).apply(skewed(test))
        assert brier(out, "calibrated") < brier(out, "score")
        assert out.filter((F.col("calibrated") < 0) | (F.col("calibrated") > 1)).count() == 0


def test_unknown_levels_and_nulls_can_be_scored(rows, forest):
    odd = rows.limit(5).withColumns({"p_brand": F.lit("never seen"), "l_quantity": F.lit(None).cast("double"), "o_orderstatus": F.lit(None).cast("string")})
    assert forest.score(odd).filter("score is null").count() == 0


def test_stacking_needs_both_classes(rows):
    with pytest.raises(ValueError, match="stacking"):
        cal.stack(rows.filter("label = 1"), m.FEATURES, [tr.logistic(maxIter=2)], k=2)


def test_permutation_ranks_the_planted_features_first(rows, forest):
    table = explain.permutation_importance(forest, rows.filter("split = 'selection'"), repeats=1)
    assert table.first().feature in ("l_quantity", "l_discount", "o_orderpriority")
    with pytest.raises(ValueError, match="validation"):
        explain.permutation_importance(forest, rows.filter("false"))


def test_leakage_is_refused(rows):
    bad = tr.Features(("days_to_outcome",), (), m.KEY, "label")
    with pytest.raises(ValueError, match="days_to_outcome"):
        tr.prepare(rows.withColumn("days_to_outcome", F.lit(1.0)), bad, "onehot")


def test_draws_are_seeded():
    space = {"a": (1, 5), "b": (0.1, 1.0, "log")}
    assert ex.draw_params(space, 3) == ex.draw_params(space, 3)


def test_bounds(spark):
    rows = spark.createDataFrame([(0.5, 1.0), (1.5, 1.0), (0.5, -1.0), (0.5, 5000.0), (None, 1.0)], "p double, d double")
    out = cal.bounded_predictions(rows, probability="p", raw_days="d").collect()
    assert [r.error_code for r in out] == [None, "INVALID_PROB", "INVALID_DAYS", "OUT_OF_BOUNDS", "INVALID_PROB"]


def test_saved_model_files(rows, forest, tmp_path):
    forest.save(str(tmp_path / "model"))
    from pyspark.ml import PipelineModel

    assert PipelineModel.load(str(tmp_path / "model" / "preparation")).stages
