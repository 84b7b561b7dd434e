"""Model metrics as table operators over scored rows.

Everything that depends on the order of scores starts from counts per distinct score and
uses sliced running counts, so neither one group nor one score range lands in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions.labels import caution_codes, risk_level, risk_quadrant
from sojourn.operators.cohorts import grouped
from sojourn.operators.ranking import first_per_group
from sojourn.operators.skew import exact_quantiles, null_safe_join, running_totals, stack_dimensions, stacked_sums

# Tables of thresholds.
COARSE_THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))
_STEP = (0.95 - 0.05) / 199
FINE_THRESHOLDS = tuple([0.05 + i * _STEP for i in range(199)] + [0.95])


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, zero where the denominator is zero."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / F.nullif(bottom, F.lit(0)))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2.0 * tp, 2 * tp + fp + fn)


def known_score(label: str, score: str) -> Column:
    """Neither label nor score is missing; NaN counts as missing."""
    return F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))


def score_counts(
    scored: DataFrame, keys: Sequence[str], *, label: str, score: str, weight: Column | None = None
) -> DataFrame:
    """Positives and negatives per distinct score."""
    one = F.lit(1).cast("bigint") if weight is None else weight
    zero = F.lit(0).cast("bigint")
    return scored.filter(known_score(label, score)).groupBy(
        *keys, F.col(score).cast("double").alias("score")
    ).agg(
        F.sum(F.when(F.col(label) == 1, one).otherwise(zero)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, zero).otherwise(one)).alias("neg"),
    )


def ranked_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts at or above every distinct score (``tp``, ``fp``) with the group totals."""
    ranked = running_totals(counts, keys, "score", {"p": "pos", "n": "neg"})
    return ranked.select(
        *keys,
        "score",
        "pos",
        "neg",
        F.col("p_all").alias("positives"),
        F.col("n_all").alias("negatives"),
        (F.col("p_all") - F.col("p_before")).alias("tp"),
        (F.col("n_all") - F.col("n_before")).alias("fp"),
    )


def ranking_metrics(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ROC-AUC with half credit for ties, average precision, and the trapezoid PR area, per group.

    Null for a group with one class.
    """
    ranked = ranked_counts(counts, keys)
    pos, neg, tp, fp = (F.col(c) for c in ("pos", "neg", "tp", "fp"))
    above_tp, above_fp = tp - pos, fp - neg
    above = F.when(above_tp + above_fp == 0, F.lit(1.0)).otherwise(ratio(above_tp, above_tp + above_fp))
    precision = ratio(tp, tp + fp)
    sums = ranked.groupBy(*keys).agg(
        F.max("positives").alias("positives"),
        F.max("negatives").alias("negatives"),
        # a negative loses to the positives above it and ties with those at its score
        F.sum(neg * (above_tp + pos / 2.0)).alias("_wins"),
        F.sum(pos * precision).alias("_steps"),
        F.sum(pos * (precision + above) / 2.0).alias("_trapezoids"),
    )
    p, n = F.nullif(F.col("positives"), F.lit(0)), F.nullif(F.col("negatives"), F.lit(0))
    one_class = n.isNull() | p.isNull()
    return sums.select(
        *keys,
        "positives",
        "negatives",
        (F.col("_wins") / (p.cast("double") * n)).alias("roc_auc"),
        F.when(~one_class, F.col("_steps") / p).alias("pr_auc"),
        F.when(~one_class, F.col("_trapezoids") / p).alias("pr_auc_trapezoid"),
    )


def roc_curve(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """False and true positive rate at every distinct score."""
    return ranked_counts(counts, keys).select(
        *keys,
        F.col("score").alias("threshold"),
        ratio(F.col("fp"), F.col("negatives")).alias("fpr"),
        ratio(F.col("tp"), F.col("positives")).alias("tpr"),
    )


def pr_curve(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision and recall at every distinct score."""
    return ranked_counts(counts, keys).select(
        *keys,
        F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("positives")).alias("recall"),
    )


def confusion(scored: DataFrame, keys: Sequence[str], *, label: str, predicted: str) -> DataFrame:
    """Confusion counts and the metrics that follow from them; 0 for an empty denominator."""
    y, z = F.col(label), F.col(predicted)
    counts = scored.groupBy(*keys).agg(
        F.count_if((y == 0) & (z == 0)).alias("tn"),
        F.count_if((y == 0) & (z == 1)).alias("fp"),
        F.count_if((y == 1) & (z == 0)).alias("fn"),
        F.count_if((y == 1) & (z == 1)).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": f1_of(tp, fp, fn),
        }
    )


def probability_bin(score: Column, bins: int = 10) -> Column:
    """Left-closed bin number; the last bin includes 1."""
    return F.least(F.floor(F.round(score * bins, 9)), F.lit(bins - 1)).cast("int")


def calibration_errors(scored: DataFrame, keys: Sequence[str], *, label: str, score: str, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error per group, over the rows that have label and score."""
    y, p = F.col(label).cast("double"), F.col(score)
    per_bin = (
        scored.filter(known_score(label, score))
        .withColumn("_bin", probability_bin(p, bins))
        .groupBy(*keys, "_bin")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(y).alias("_y"),
            F.sum(p).alias("_p"),
            F.sum((p - y) * (p - y)).alias("_sq"),
        )
    )
    return per_bin.groupBy(*keys).agg(
        (F.sum("_sq") / F.sum("_n")).alias("brier_score"),
        (F.sum(F.abs(F.col("_y") - F.col("_p"))) / F.sum("_n")).alias("expected_calibration_error"),
    )


def classification_report(
    scored: DataFrame, keys: Sequence[str], *, label: str, score: str, threshold: float = 0.5, bins: int = 10
) -> DataFrame:
    """All classification metrics per group at one threshold; score metrics are null for one class.

    Rows are read once, into counts per distinct score; everything else follows from those counts
    in one aggregate.
    """
    ranked = ranked_counts(score_counts(scored, keys, label=label, score=score), keys)
    pos, neg, s = F.col("pos"), F.col("neg"), F.col("score")
    tp, fp = F.col("tp"), F.col("fp")
    above_tp = tp - pos
    hit, zero = s >= threshold, F.lit(0).cast("bigint")
    number = probability_bin(s, bins)
    in_bin = [
        (F.sum(F.when(number == b, pos).otherwise(zero)), F.sum(F.when(number == b, (pos + neg) * s).otherwise(0.0)))
        for b in range(bins)
    ]
    sums = ranked.groupBy(*keys).agg(
        F.max("positives").alias("_P"),
        F.max("negatives").alias("_N"),
        F.sum(F.when(hit, pos).otherwise(zero)).alias("tp"),
        F.sum(F.when(hit, neg).otherwise(zero)).alias("fp"),
        F.sum(F.when(hit, zero).otherwise(pos)).alias("fn"),
        F.sum(F.when(hit, zero).otherwise(neg)).alias("tn"),
        F.sum(neg * (above_tp + pos / 2.0)).alias("_wins"),
        F.sum(pos * ratio(tp, tp + fp)).alias("_steps"),
        F.sum(pos * (1 - s) * (1 - s) + neg * s * s).alias("_sq"),
        *[y.alias(f"_y{b}") for b, (y, _) in enumerate(in_bin)],
        *[p.alias(f"_p{b}") for b, (_, p) in enumerate(in_bin)],
    )
    p, n, total = F.col("_P"), F.col("_N"), F.col("_P") + F.col("_N")
    both = (p > 0) & (n > 0)
    gaps = sum((F.abs(F.col(f"_y{b}") - F.col(f"_p{b}")) for b in range(bins)), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return sums.select(
        *keys,
        "tn",
        "fp",
        "fn",
        "tp",
        ratio(tp + tn, total).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        f1_of(tp, fp, fn).alias("f1"),
        F.when(both, F.col("_wins") / F.nullif(p.cast("double") * n, F.lit(0.0))).alias("roc_auc"),
        F.when(both, F.col("_steps") / F.nullif(p, zero)).alias("pr_auc"),
        F.when(both, F.col("_sq") / total).alias("brier_score"),
        F.when(both, gaps / total).alias("expected_calibration_error"),
    )


def regression_report(
    scored: DataFrame, keys: Sequence[str], *, actual: str, predicted: str, whole_units: bool = False
) -> DataFrame:
    """MAE, RMSE, median absolute error and R squared per group."""
    y, z = F.col(actual).cast("double"), F.col(predicted).cast("double")
    rows = scored.filter(y.isNotNull() & z.isNotNull()).select(*keys, y.alias("_y"), F.abs(y - z).alias("_e"))
    measures = [
        F.count(F.lit(1)).alias("records"),
        F.avg("_e").alias("mae"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.sum(F.col("_e") * F.col("_e")).alias("_sse"),
        F.var_pop("_y").alias("_var"),
    ]
    out = grouped(rows, keys, measures, "_e", {"median_absolute_error": 0.5}, whole_units)
    r2 = 1.0 - F.col("_sse") / F.nullif(F.col("_var") * F.col("records"), F.lit(0.0))
    return out.withColumn("r2", r2).drop("_sse", "_var")


def thresholds_reached(score: Column, grid: Sequence[float]) -> Column:
    """Number of grid values at or below the score.

    On an evenly spaced grid the number is computed and then corrected against the two
    neighbouring grid values, so rounding in the division cannot move a score.
    """
    column = F.array(*[F.lit(float(t)) for t in grid])
    step = (grid[-1] - grid[0]) / (len(grid) - 1) if len(grid) > 1 else 0.0
    if not step or any(abs(grid[0] + i * step - t) > step / 10 for i, t in enumerate(grid)):
        return F.size(F.filter(column, lambda t: t <= score))
    guess = F.least(F.greatest(F.floor((score - grid[0]) / step), F.lit(0)), F.lit(len(grid) - 1)).cast("int")
    above = F.coalesce(F.get(column, guess + 1) <= score, F.lit(False)).cast("int")
    below = (F.get(column, guess) > score).cast("int")
    return guess + 1 + above - below


def threshold_table(
    scored: DataFrame,
    keys: Sequence[str],
    *,
    label: str,
    score: str,
    thresholds: Sequence[float] = COARSE_THRESHOLDS,
) -> DataFrame:
    """Confusion counts and metrics at each threshold of a grid."""
    return threshold_counts(score_counts(scored, keys, label=label, score=score), keys, thresholds)


def threshold_counts(counts: DataFrame, keys: Sequence[str], thresholds: Sequence[float] = COARSE_THRESHOLDS) -> DataFrame:
    """The threshold table from counts per distinct score.

    Scores fall into the cell of the highest threshold they reach; cells are counted first and
    only cell counts are spread over thresholds.
    """
    grid = sorted(thresholds)
    grid_column = F.array(*[F.lit(float(t)) for t in grid])
    cells = counts.groupBy(*keys, thresholds_reached(F.col("score"), grid).alias("_cell")).agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n")
    )
    # one row per group with its cells (at most one per threshold), spread over the grid
    listed = (
        cells.groupBy(*keys)
        .agg(F.collect_list(F.struct("_cell", "_p", "_n")).alias("_cells"))
        .select(*keys, "_cells", F.posexplode(grid_column).alias("_i", "threshold"))
    )

    def total(name: str, flagged: bool) -> Column:
        start = F.lit(0).cast("bigint")
        return F.aggregate(
            "_cells",
            start,
            lambda sum_, cell: sum_
            + F.when((cell["_cell"] > F.col("_i")) if flagged else (cell["_cell"] <= F.col("_i")), cell[name]).otherwise(start),
        )

    out = listed.select(
        *keys,
        "threshold",
        total("_p", True).alias("tp"),
        total("_n", True).alias("fp"),
        total("_p", False).alias("fn"),
        total("_n", False).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select(
        *keys,
        "threshold",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        f1_of(tp, fp, fn).alias("f1"),
        ratio(tp + fp, tp + fp + fn + tn).alias("flagged_for_adoption_share"),
        "tn",
        "fp",
        "fn",
        "tp",
    )


def operating_points(
    scored: DataFrame, *, label: str, score: str, min_recall: float = 0.85, fallback: float = 0.30
) -> DataFrame:
    """Six named thresholds of one scored table, with the metrics they give on it.

    Ties go to the lower grid threshold, for Youden's J to the higher score.
    """
    counts = score_counts(scored, [], label=label, score=score)
    grid = threshold_counts(counts, [], FINE_THRESHOLDS)
    t, low = F.col("threshold"), -F.col("threshold")
    enough = F.col("recall") >= min_recall
    from_grid = grid.agg(
        F.max_by(t, F.struct("f1", low.alias("l"))).alias("max_f1"),
        F.coalesce(
            F.max_by(F.when(enough, t), F.when(enough, F.struct("precision", low.alias("l")))), F.lit(fallback)
        ).alias("high_recall_ge85"),
        F.min_by(t, F.struct(F.abs(F.col("precision") - F.col("recall")).alias("d"), t.alias("l"))).alias(
            "balanced_precision_recall"
        ),
    )
    curve = roc_curve(counts, [])
    youden = curve.agg(
        F.max_by("threshold", F.struct((F.col("tpr") - F.col("fpr")).alias("j"), "threshold")).alias("youden_j")
    )
    weighted = counts.select("score", (F.col("pos") + F.col("neg")).alias("_w"))
    top = exact_quantiles(weighted, [], "score", {"top_10_percent_capacity": 0.9}, weight="_w")
    # three one-row tables
    chosen = (
        from_grid.withColumn("_k", F.lit(0))
        .join(F.broadcast(youden.withColumn("_k", F.lit(0))), "_k")
        .join(F.broadcast(top.withColumn("_k", F.lit(0))), "_k")
        .withColumn("default_0.50", F.lit(0.5))
    )
    names = [
        "default_0.50", "max_f1", "youden_j", "high_recall_ge85", "balanced_precision_recall", "top_10_percent_capacity",
    ]
    rows = chosen.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("threshold_label"), F.col(f"`{n}`").alias("threshold")) for n in names])
        ).alias("_t")
    ).select("_t.*")
    return apply_thresholds(rows, counts).withColumns(
        {"threshold": F.round("threshold", 4), "selection_source": F.lit("selection")}
    )


def apply_thresholds(thresholds: DataFrame, counts: DataFrame, prefix: str = "") -> DataFrame:
    """Metrics of given threshold rows on counts per distinct score, next to their other columns.

    ``thresholds`` is a handful of rows and is sent to the counts.
    """
    carried = thresholds.columns
    listed = thresholds.agg(F.collect_list(F.struct(*carried)).alias("_list"))
    spread = (
        counts.withColumn("_k", F.lit(0))
        .join(F.broadcast(listed.withColumn("_k", F.lit(0))), "_k")
        .select("score", "pos", "neg", F.explode("_list").alias("_t"))
    )
    hit = F.col("score") >= F.col("_t.threshold")
    zero = F.lit(0).cast("bigint")
    table = spread.groupBy("_t").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(zero)).alias("_tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(zero)).alias("_fp"),
        F.sum(F.when(~hit, F.col("neg")).otherwise(zero)).alias("_tn"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(zero)).alias("_fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("_tp", "_fp", "_tn", "_fn"))
    metrics = {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": f1_of(tp, fp, fn),
        "false_positive_rate": ratio(fp, fp + tn),
        "false_negative_rate": ratio(fn, fn + tp),
    }
    return table.select(
        *[F.col(f"_t.{c}").alias(c) for c in carried],
        *[F.round(c, 4).alias(f"{prefix}{n}") for n, c in metrics.items()],
        *[F.col(f"_{c}").alias(f"{prefix}{c}") for c in ("tp", "fp", "tn", "fn")],
    )


def frozen_thresholds(selection: DataFrame, test: DataFrame, *, label: str, score: str) -> DataFrame:
    """Thresholds chosen on one period, applied unchanged to another."""
    chosen = operating_points(selection, label=label, score=score)
    metrics = ("precision", "recall", "f1", "false_positive_rate", "false_negative_rate", "tp", "fp", "tn", "fn")
    renamed = chosen.select("threshold_label", "threshold", *[F.col(m).alias(f"selection_{m}") for m in metrics])
    on_test = apply_thresholds(renamed, score_counts(test, [], label=label, score=score), "test_")
    return on_test.drop("test_false_positive_rate", "test_false_negative_rate")


def calibration_table(scored: DataFrame, keys: Sequence[str], *, label: str, score: str, bins: int = 10) -> DataFrame:
    """Fixed right-closed probability bins, the lowest edge included, empty bins listed.

    Scores that are missing or outside 0 to 1 are in no bin.
    """
    scored = scored.filter(F.col(score).between(0, 1))
    number = F.greatest(F.ceil(F.round(F.col(score) * bins, 9)), F.lit(1)).cast("int")
    found = scored.groupBy(*keys, number.alias("bin")).agg(
        F.count(label).alias("records"),
        F.avg(score).alias("mean_predicted_probability"),
        F.avg(F.col(label).cast("double")).alias("observed_adoption_rate"),
    )
    every = F.sequence(F.lit(1), F.lit(bins))
    if keys:
        listed = found.select(*keys).distinct().select(*keys, F.explode(every).alias("bin"))
    else:
        listed = scored.sparkSession.range(1).select(F.explode(every).alias("bin"))
    low = F.when(F.col("bin") == 1, F.lit("-0.001")).otherwise(
        F.format_string("%.1f" if bins == 10 else "%.3f", (F.col("bin") - 1) / F.lit(float(bins)))
    )
    high = F.format_string("%.1f" if bins == 10 else "%.3f", F.col("bin") / F.lit(float(bins)))
    return (
        null_safe_join(listed, found, [*keys, "bin"], "left")
        .fillna(0, subset=["records"])
        .withColumn("probability_bin", F.concat(F.lit("("), low, F.lit(", "), high, F.lit("]")))
    )


def cohort_reliability(
    scored: DataFrame,
    dims: Sequence[str],
    *,
    label: str,
    score: str,
    predicted: str,
    absolute_error: str,
    min_records: int = 100,
) -> DataFrame:
    """Calibration and error per cohort value. Error shares are of all rows of the cohort."""
    y, z, p = F.col(label), F.col(predicted), F.col(score)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    sums = stacked_sums(
        scored,
        dims,
        {
            "records": one,
            "_y": y.cast("bigint"),
            "_p": p,
            "_sq": (p - y) * (p - y),
            "_ae": F.col(absolute_error),
            "_nae": F.when(F.col(absolute_error).isNotNull(), one).otherwise(zero),
            "_fp": F.when((z == 1) & (y == 0), one).otherwise(zero),
            "_fn": F.when((z == 0) & (y == 1), one).otherwise(zero),
        },
    )
    n = F.col("records")
    table = sums.select(
        F.col("variable").alias("cohort"),
        "value",
        "records",
        (n < min_records).alias("small_cohort_flag"),
        (F.col("_y") / n).alias("observed_adoption_rate"),
        (F.col("_p") / n).alias("mean_predicted_adoption_probability"),
        F.abs(F.col("_y") / n - F.col("_p") / n).alias("calibration_gap"),
        (F.col("_sq") / n).alias("brier_score"),
        (F.col("_ae") / F.nullif(F.col("_nae"), F.lit(0))).alias("mae"),
        (F.col("_fp") / n).alias("false_positive_rate"),
        (F.col("_fn") / n).alias("false_negative_rate"),
    )
    return table.withColumn(
        "is_reliable",
        ~F.col("small_cohort_flag") & (F.col("calibration_gap") <= 0.10) & (F.col("brier_score") <= 0.25),
    )


def red_flags(reliability: DataFrame) -> DataFrame:
    """Reliability rows with a risk level and codes for what calls for caution, under their reader-facing names."""
    c = {name: F.col(name) for name in reliability.columns}
    return reliability.select(
        "cohort",
        "value",
        "records",
        c["cohort"].alias("subgroup_field"),
        c["value"].alias("subgroup_value"),
        "observed_adoption_rate",
        "mean_predicted_adoption_probability",
        c["mean_predicted_adoption_probability"].alias("mean_predicted_probability"),
        "calibration_gap",
        "false_positive_rate",
        "false_negative_rate",
        c["mae"].alias("regression_mae"),
        "small_cohort_flag",
        risk_level(c["small_cohort_flag"], c["calibration_gap"]).alias("risk_level"),
        caution_codes(
            small=c["small_cohort_flag"],
            gap=c["calibration_gap"],
            over=c["mean_predicted_adoption_probability"] > c["observed_adoption_rate"],
            false_positive=c["false_positive_rate"],
            false_negative=c["false_negative_rate"],
        ).alias("cautions"),
    ).orderBy(F.desc("calibration_gap"), "cohort", "value")


def calibration_summary(
    reliability: DataFrame, *, subset: str = "animal_subset", min_records: int = 100, limit: float = 0.10
) -> DataFrame:
    """One row per subset: mean and worst gap, share of small and of reliable cohorts."""
    rows = reliability if subset in reliability.columns else reliability.withColumn(subset, F.lit("combined"))
    reliable = (
        (F.col("records") >= min_records) & (F.col("calibration_gap") <= limit) & (F.col("brier_score") <= 0.25)
    )
    observed, predicted = F.avg("observed_adoption_rate"), F.avg("mean_predicted_adoption_probability")
    return rows.groupBy(subset).agg(
        F.sum("records").alias("records"),
        F.round(F.avg("calibration_gap"), 4).alias("mean_calibration_gap"),
        F.max_by("cohort", F.struct("calibration_gap", "cohort")).alias("worst_cohort"),
        F.round(F.max("calibration_gap"), 4).alias("worst_calibration_gap"),
        F.round(F.avg(F.col("small_cohort_flag").cast("double")) * 100, 1).alias("pct_small_cohort_flagged"),
        F.round(F.avg(reliable.cast("double")) * 100, 1).alias("pct_reliable_cohort"),
        F.lit(limit).alias("cohort_threshold"),
        F.lit(min_records).alias("min_records_for_cohort"),
        (predicted > observed).alias("overconfident"),
        F.round(observed, 4).alias("mean_observed_adoption_rate"),
        F.round(predicted, 4).alias("mean_predicted_probability"),
    )


# Failure modes and their metric.
FAILURE_MODES = (
    ("calibration_gap", "calibration_gap"),
    ("high_mae", "mae"),
    ("false_negative_rate", "false_negative_rate"),
    ("false_positive_rate", "false_positive_rate"),
)


def failure_modes(reliability: DataFrame, top: int = 8) -> DataFrame:
    """The worst cohorts per failure mode, small cohorts left out."""
    modes = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(mode).alias("failure_mode"),
                    F.lit(metric).alias("metric"),
                    F.col(metric).alias("value_score"),
                )
                for mode, metric in FAILURE_MODES
            ]
        )
    )
    long = reliability.filter(~F.col("small_cohort_flag")).select("cohort", "value", "records", modes.alias("_m")).select(
        "_m.*", "cohort", "value", "records"
    )
    order = [F.desc_nulls_last("value_score"), F.col("cohort"), F.col("value")]
    return first_per_group(long, ["failure_mode"], order, top)


def error_slices(
    scored: DataFrame,
    dims: Sequence[str],
    *,
    label: str,
    score: str,
    predicted: str,
    absolute_error: str,
    min_records: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """Classification and regression error per slice value.

    Errors are counted per joint cell (all dimensions, error) first; means and exact medians of single
    values come from sums of cells.
    """
    table = cohort_reliability(
        scored, dims, label=label, score=score, predicted=predicted, absolute_error=absolute_error, min_records=min_records
    )
    classification = (
        table.filter(~F.col("small_cohort_flag"))
        .select(
            F.col("cohort").alias("slice"),
            "value",
            "records",
            F.col("observed_adoption_rate").alias("adoption_rate"),
            F.col("mean_predicted_adoption_probability").alias("predicted_adoption_probability"),
            "false_positive_rate",
            "false_negative_rate",
        )
        .orderBy(F.desc("false_negative_rate"), F.desc("records"), "slice", "value")
    )
    cells = scored.groupBy(*dims, F.col(absolute_error).alias("_e")).agg(F.count(F.lit(1)).alias("_n"))
    keys = ["variable", "value"]
    histogram = stack_dimensions(cells, dims, ["_e", "_n"]).groupBy(*keys, "_e").agg(F.sum("_n").alias("_n"))
    known = F.when(F.col("_e").isNotNull(), F.col("_n")).otherwise(F.lit(0))
    sums = histogram.groupBy(*keys).agg(
        F.sum(known).alias("records"), (F.sum(F.col("_e") * F.col("_n")) / F.nullif(F.sum(known), F.lit(0))).alias("mae")
    )
    medians = exact_quantiles(histogram, keys, "_e", {"median_absolute_error": 0.5}, weight="_n")
    regression = (
        null_safe_join(sums, medians, keys, "left")
        .filter(F.col("records") >= min_records)
        .withColumnRenamed("variable", "slice")
        .orderBy(F.desc("mae"), F.desc("records"), "slice", "value")
    )
    return classification, regression


def risk_quadrants(
    scored: DataFrame, *, label: str, score: str, predicted_days: str, long_days: float = 14, whole_days: bool = False
) -> DataFrame:
    """Size, rate, mean probability and median predicted days per quadrant."""
    rows = scored.withColumn("risk_quadrant", risk_quadrant(F.col(score), F.col(predicted_days), long_days))
    measures = [
        F.count(label).alias("records"),
        F.avg(F.col(label).cast("double")).alias("observed_adoption_rate"),
        F.avg(score).alias("mean_predicted_adoption_probability"),
    ]
    return grouped(rows, ["risk_quadrant"], measures, predicted_days, {"median_predicted_days_to_outcome": 0.5}, whole_days)


def subgroup_report(
    scored: DataFrame, subgroup: str, *, label: str, score: str, min_rows: int = 2
) -> DataFrame:
    """Score metrics per subgroup with both classes and enough rows."""
    ranked = ranking_metrics(score_counts(scored, [subgroup], label=label, score=score), [subgroup])
    errors = calibration_errors(scored, [subgroup], label=label, score=score)
    joined = null_safe_join(ranked, errors, [subgroup]).withColumn("n_samples", F.col("positives") + F.col("negatives"))
    return joined.filter(
        (F.col("n_samples") >= min_rows) & (F.col("positives") > 0) & (F.col("negatives") > 0)
    ).select(
        F.col(subgroup).alias("subgroup"), "n_samples", "pr_auc", "roc_auc", "brier_score", "expected_calibration_error"
    )


def drift_by_period(scored: DataFrame, period: str, *, label: str, score: str) -> DataFrame:
    """ROC-AUC of one score on successive periods."""
    return ranking_metrics(score_counts(scored, [period], label=label, score=score), [period]).select(
        period, "roc_auc", (F.col("positives") + F.col("negatives")).alias("records")
    )
