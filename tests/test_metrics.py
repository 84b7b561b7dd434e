import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sojourn.operators import bootstrap as bs
from sojourn.operators import metrics as mx
from sojourn.operators import selection as sel
from sojourn.operators.cohorts import summarize


def scored(spark, rows):
    return spark.createDataFrame(rows, "g string, label int, score double")


def sample(seed, n, distinct):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = rng.randrange(distinct + 1) / distinct
        out.append(("hot" if rng.random() < 0.7 else "cold", int(rng.random() < 0.2 + 0.6 * s), s))
    return out


def auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def average_precision(rows):
    total, out, before = sum(y for y, _ in rows), 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        picked = [y for y, s in rows if s >= t]
        recall = sum(picked) / total
        out += (recall - before) * sum(picked) / len(picked)
        before = recall
    return out


@pytest.mark.parametrize("distinct", [5, 1000])
def test_areas_by_definition(spark, distinct):
    rows = sample(distinct, 500, distinct)
    counts = mx.score_counts(scored(spark, rows), ["g"], label="label", score="score")
    for r in mx.ranking_metrics(counts, ["g"]).collect():
        mine = [(y, s) for g, y, s in rows if g == r.g]
        assert r.roc_auc == pytest.approx(auc(mine)) and r.pr_auc == pytest.approx(average_precision(mine))


def test_report_agrees_with_its_parts(spark):
    rows = scored(spark, sample(9, 400, 20)).withColumn("p", (F.col("score") >= 0.5).cast("int"))
    report = {r.g: r for r in mx.classification_report(rows, ["g"], label="label", score="score").collect()}
    parts = {r.g: r for r in mx.confusion(rows, ["g"], label="label", predicted="p").collect()}
    errors = {r.g: r for r in mx.calibration_errors(rows, ["g"], label="label", score="score").collect()}
    for g, r in report.items():
        assert (r.tn, r.fp, r.fn, r.tp) == (parts[g].tn, parts[g].fp, parts[g].fn, parts[g].tp)
        assert r.f1 == pytest.approx(parts[g].f1) and r.brier_score == pytest.approx(errors[g].brier_score)
        assert r.expected_calibration_error == pytest.approx(errors[g].expected_calibration_error)


def test_one_class_gives_no_score_metrics(spark):
    r = mx.classification_report(scored(spark, [("a", 1, 0.2), ("a", 1, 0.9)]), [], label="label", score="score").first()
    assert (r.roc_auc, r.pr_auc, r.brier_score) == (None, None, None) and (r.tp, r.fn) == (1, 1)


@pytest.mark.parametrize("grid", [mx.COARSE_THRESHOLDS, mx.FINE_THRESHOLDS, (0.1, 0.15, 0.7)])
def test_threshold_cells_at_the_edges(spark, grid):
    points = sorted({x for t in grid for x in (t, np.nextafter(t, 0), np.nextafter(t, 1))} | {0.0, 1.0, 0.5})
    rows = [(float(p),) for p in points]
    got = spark.createDataFrame(rows, "s double").select("s", mx.thresholds_reached(F.col("s"), grid).alias("n")).collect()
    assert all(r.n == sum(t <= r.s for t in grid) for r in got)


def test_calibration_bins_are_right_closed_and_listed(spark):
    rows = scored(spark, [("a", 1, 0.0), ("a", 0, 0.1), ("a", 1, 0.10001), ("a", 1, 1.0)])
    got = {r.bin: r.records for r in mx.calibration_table(rows, [], label="label", score="score").collect()}
    assert got == {1: 2, 2: 1, **{b: 0 for b in range(3, 10)}, 10: 1}


def test_operating_points_fall_back_without_high_recall(spark):
    rows = scored(spark, [("a", 1, 0.01), ("a", 0, 0.9), ("a", 1, 0.02), ("a", 0, 0.8)])
    got = {r.threshold_label: r.threshold for r in mx.operating_points(rows, label="label", score="score").collect()}
    assert got["high_recall_ge85"] == 0.3 and got["default_0.50"] == 0.5


def test_poisson_draws_have_mean_and_variance_one(spark):
    w = spark.range(20000).select(bs.draws(F.col("id"), F.lit(3)).alias("w")).agg(F.avg("w"), F.variance("w")).first()
    assert w[0] == pytest.approx(1, abs=0.03) and w[1] == pytest.approx(1, abs=0.05)


def test_interval_covers_the_estimate_and_small_cohorts_get_a_status(spark):
    rows = scored(spark, sample(5, 600, 50)).withColumns(
        {"c": F.floor(F.rand(1) * 60), "p": (F.col("score") >= 0.5).cast("int"), "e": F.abs(F.col("label") - F.col("score"))}
    )
    cols = dict(cluster="c", label="label", score="score", predicted="p", absolute_error="e")
    r = {x.metric: x for x in bs.bootstrap_intervals(rows, replicates=40, **cols).collect()}
    assert all(x.lower <= x.estimate <= x.upper and x.bootstrap_samples == 40 for x in r.values())
    got = {(x.value, x.status) for x in bs.subgroup_intervals(rows, ["g"], replicates=5, min_records=300, **cols).collect()}
    assert got == {("hot", "ok"), ("cold", "small_cohort")}


def test_context_delta(spark):
    rows = spark.createDataFrame(
        [("combined", "m", "intake_time_v2", 0.70, 0.6), ("combined", "m", "intake_time_context_v2", 0.75, 0.5), ("dogs", "m", "intake_time_v2", 0.5, 0.5)],
        "animal_subset string, model_name string, feature_set string, roc_auc double, f1 double",
    )
    out = sel.context_deltas(
        rows, task="classification", primary="roc_auc", secondary="f1", higher_is_better=True,
        has_context=F.contains(F.col("feature_set"), F.lit("context")),
    ).collect()
    assert len(out) == 1 and out[0].delta == pytest.approx(0.05) and out[0].secondary_delta == pytest.approx(-0.1)


def test_summary_keeps_null_groups(spark):
    rows = spark.createDataFrame([(None, 1, 2.0), ("a", 0, 4.0), ("a", 1, 8.0)], "k string, y int, d double")
    got = {r.value: (r.records, r.median_days_to_outcome) for r in summarize(rows, ["k"], label="y", days="d").collect()}
    assert got == {None: (1, 2.0), "a": (2, 6.0)}
