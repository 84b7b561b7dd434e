"""Guards, odd numbers, and what happens when nothing can be fitted."""

import pytest
from pyspark.sql import functions as F

from sojourn.operators import bootstrap as bs
from sojourn.operators import metrics as mx
from sojourn.operators.skew import exact_quantiles, hash_positions, running_totals
from sojourn.plans import calibration as cal
from sojourn.plans import experiments as ex
from sojourn.plans import training as tr
from sojourn.plans.dataset import BASE_COLUMNS, CONTEXT_COLUMNS, FEATURE_COLUMNS, TARGET_COLUMNS, column_lists
from sojourn.sources.contracts import check_no_leakage, prohibited


def test_horizon_labels_are_no_features():
    labels = ["adopted_in_7d", "adopted_in_30d", "adopted_in_365d", "Adopted_In_60D", "observation_end_actual", "followup_days_available"]
    assert prohibited(labels) == labels
    with pytest.raises(ValueError, match="adopted_in_7d"):
        check_no_leakage(["age_days", "adopted_in_7d"])
    assert prohibited(FEATURE_COLUMNS) == [] and prohibited(TARGET_COLUMNS) == list(TARGET_COLUMNS)


def test_column_lists_name_what_a_table_has():
    lists = column_lists(["age_days", "is_named", "has_name", "intake_quarter", "daily_temp_max", "adopted", "length_of_stay"], (7,))
    assert lists == {
        "feature_columns": ["age_days", "is_named", "daily_temp_max"],
        "target_columns": ["adopted", "length_of_stay"],
        "context_columns": ["daily_temp_max"],
        "horizon_target_columns": ["adopted_in_7d"],
    }
    assert FEATURE_COLUMNS == BASE_COLUMNS + CONTEXT_COLUMNS


def test_quantiles_with_infinite_values_and_nan(spark):
    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([("a", v) for v in (1.0, inf, 2.0, nan, -inf, None)] + [(None, 3.0), (None, inf)], "k string, v double")
    got = {r.k: (r.low, r.mid, r.top) for r in exact_quantiles(rows, ["k"], "v", {"low": 0.0, "mid": 0.5, "top": 1.0}).collect()}
    assert got["a"] == (-inf, 1.5, inf) and got[None] == (3.0, inf, inf)


def test_running_totals_need_one_exchange_of_the_rows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
        plan = running_totals(rows, ["k"], "v", {"t": "n"})._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "coalesce(k" not in physical
    # the rows themselves, their slice sums, and the carries
    assert physical.count("Exchange hashpartitioning(_group") <= 4


def test_hash_positions_count_every_row(spark):
    rows = spark.range(500).withColumn("g", F.col("id") % 2)
    got = hash_positions(rows, ["g"], F.xxhash64("id"), "at").collect()
    assert sorted(r["at"] for r in got if r.g == 0) == list(range(250)) and "_hash" not in got[0].asDict()


def test_missing_and_odd_scores_are_in_no_bin(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, None), (1, -0.3), (0, 1.4), (1, 0.05), (None, 0.2), (0, float("nan"))], "label int, score double")
    table = {r.bin: r for r in mx.calibration_table(rows, [], label="label", score="score").collect()}
    assert table[1].records == 1 and table[1].mean_predicted_probability == pytest.approx(0.05)
    assert sum(r.records for r in table.values()) == 2
    errors = mx.calibration_errors(rows.filter("score is null or score between 0 and 1"), [], label="label", score="score").first()
    assert errors.brier_score == pytest.approx((0.25 + 0.95**2) / 2)


def test_poisson_cuts_reach_the_end():
    cuts = bs.poisson_cuts()
    assert list(cuts) == sorted(set(cuts)) and cuts[-1] < 2**32 and len(cuts) > 9


def test_isotonic_keeps_scores_apart(spark):
    rows = spark.createDataFrame([(0.50001, 0)] * 5 + [(0.50002, 1)] * 5, "score double, label int")
    out = cal.calibrate(rows, label="label").apply(rows).select("score", "calibrated").distinct().collect()
    assert {(r.score, r.calibrated) for r in out} == {(0.50001, 0.0), (0.50002, 1.0)}


FEATURES = tr.Features(("x",), (), ("id",), "label")


def _years(spark, n):
    return spark.range(n).select("id", F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("label"), (2000 + F.col("id") % 2).cast("int").alias("yr"), F.lit("s").alias("sub"))


def test_backtest_without_ready_windows_lists_the_reasons(spark):
    got = ex.backtest(_years(spark, 6), FEATURES, [tr.logistic(maxIter=2)], year="yr", subset="sub", cluster="id", first_year=2000).collect()
    assert {(r.test_year, r.status) for r in got} == {(2000, "SKIPPED"), (2001, "SKIPPED")}


def test_backtest_with_failing_models_lists_the_errors(spark):
    broken = tr.Model("broken", tr.CLASSIFICATION, lambda **p: 1 / 0)
    got = ex.backtest(_years(spark, 60), FEATURES, [broken], year="yr", subset="sub", cluster="id", first_year=2000).collect()
    assert {(r.test_year, r.status) for r in got} == {(2000, "SKIPPED"), (2001, "ERROR")}
    assert {r.error_type for r in got if r.status == "ERROR"} == {"ZeroDivisionError"}


def test_failed_trials_have_no_value(spark):
    rows = spark.range(80).select("id", F.rand(1).alias("x"), (F.col("id") % 2).cast("int").alias("label"), F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("ts"))
    made = []

    def build(**params):
        made.append(params)
        if len(made) == 2:
            raise RuntimeError("second fold fails " + "x" * 400)
        return tr.logistic(maxIter=2).build(**{k: v for k, v in params.items() if k != "odd"})

    windows = ex.search_windows(rows, FEATURES, ["label"], ts="ts", tie="id", k=2)
    got = ex.search(windows, "label", tr.Model("m", tr.CLASSIFICATION, build), [{"odd": 1}]).first()
    assert got.state == "FAILED" and got.value is None and len(got.error) > 400
