"""Product-limit curves, hazards and survival diagnostics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.operators.skew import exact_quantiles, null_safe_join, running_totals, stacked_sums


def product_limit(rows: DataFrame, keys: Sequence[str], *, time: str, event: str) -> DataFrame:
    """At-risk count, events, survival and hazard at every distinct time, per group.

    The product of (1 - d / r) is a running sum of logarithms; a time at which everyone left
    has the event is carried as a flag, because its logarithm does not exist.
    """
    counts = (
        rows.filter(F.col(time).isNotNull())
        .groupBy(*keys, F.col(time).cast("double").alias("time"))
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(event).cast("int") == 1).alias("events"))
    )
    # events ride along as a total so that both branches of the running sum read the same shuffle
    risk = running_totals(counts, keys, "time", {"n": "_n", "d": "events"}).withColumn(
        "at_risk", F.col("n_all") - F.col("n_before")
    )
    all_gone = F.col("events") == F.col("at_risk")
    step = F.when(all_gone, F.lit(0.0)).otherwise(F.ln(1 - F.when(all_gone, 0).otherwise(F.col("events")) / F.col("at_risk")))
    steps = risk.withColumns({"_step": step, "_gone": all_gone.cast("bigint")})
    summed = running_totals(steps, keys, "time", {"s": "_step", "g": "_gone"})
    gone = F.col("g_before") + F.col("_gone") > 0
    return summed.select(
        *keys,
        "time",
        "at_risk",
        "events",
        F.col("n_all").alias("records"),
        F.when(gone, F.lit(0.0)).otherwise(F.exp(F.col("s_before") + F.col("_step"))).alias("survival_probability"),
        F.when(gone, F.lit(float("inf"))).otherwise(-(F.col("s_before") + F.col("_step"))).alias("cumulative_hazard"),
    )


def curve_at(curve: DataFrame, keys: Sequence[str], times: Sequence[float]) -> DataFrame:
    """Step values of a product-limit curve at requested times.

    Curve points are reduced to the last one in each gap between requested times, so the final
    window has at most one row per requested time and group.
    """
    grid = F.array(*[F.lit(float(t)) for t in sorted(times)])
    below = F.size(F.filter(grid, lambda t: t < F.col("time")))
    last = curve.groupBy(*keys, below.alias("_i")).agg(
        F.max_by(F.struct("survival_probability", "cumulative_hazard", "at_risk"), "time").alias("_last"),
        F.max("records").alias("records"),
    )
    groups = curve.groupBy(*keys).agg(F.max("records").alias("records"))
    listed = groups.select(*keys, "records", F.posexplode(grid).alias("_i", "days"))
    found = null_safe_join(listed, last.drop("records"), [*keys, "_i"], "left")
    group = list(keys) if keys else [F.lit(0)]
    upto = Window.partitionBy(*group).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    filled = found.withColumn("_last", F.last("_last", ignorenulls=True).over(upto))
    survival = F.coalesce("_last.survival_probability", F.lit(1.0))
    return filled.select(
        *keys,
        "days",
        survival.alias("survival_probability"),
        (1.0 - survival).alias("censoring_rate"),
        F.coalesce("_last.cumulative_hazard", F.lit(0.0)).alias("cumulative_hazard"),
        F.coalesce("_last.at_risk", "records").alias("n_at_risk"),
    )


def survival_table(
    rows: DataFrame, keys: Sequence[str], *, time: str, event: str, times: Sequence[float]
) -> DataFrame:
    """Survival at requested times."""
    return curve_at(product_limit(rows, keys, time=time, event=event), keys, times).drop("cumulative_hazard")


def cumulative_hazard(
    rows: DataFrame, keys: Sequence[str], *, time: str, event: str, max_time: int
) -> DataFrame:
    """-ln S(t) for whole t from 1 to ``max_time`` while the group still has observations."""
    curve = product_limit(rows, keys, time=time, event=event)
    at = curve_at(curve, keys, range(1, max_time + 1))
    ends = curve.groupBy(*keys).agg(F.floor(F.max("time")).alias("_end"))
    if keys:
        bounded = null_safe_join(at, ends, keys)
    else:
        bounded = at.withColumn("_k", F.lit(0)).join(F.broadcast(ends.withColumn("_k", F.lit(0))), "_k").drop("_k")
    return bounded.filter(F.col("days") <= F.col("_end")).select(
        *keys, F.col("days").cast("int").alias("time"), "cumulative_hazard", "n_at_risk"
    )


def adopted_curves(
    rows: DataFrame,
    dims: Sequence[str],
    *,
    label: str,
    days: str,
    max_days: int = 180,
    every: int = 10,
    min_records: int = 20,
) -> DataFrame:
    """Share of positive episodes not yet done by each day, per dimension value.

    Nothing is censored here, so the curve is one minus the share of shorter times; one
    aggregate over a grid of days is enough.
    """
    grid = list(range(0, max_days + 1, every))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    adopted = rows.filter((F.col(label) == 1) & F.col(days).isNotNull())
    sums = stacked_sums(
        adopted,
        dims,
        {"records": one, **{f"_d{d}": F.when(F.col(days) > d, one).otherwise(zero) for d in grid}},
    ).filter(F.col("records") >= min_records)
    points = F.explode(F.array(*[F.struct(F.lit(d).alias("day"), F.col(f"_d{d}").alias("left")) for d in grid]))
    survival = F.col("_p.left") / F.col("records")
    return sums.select("variable", "value", "records", points.alias("_p")).select(
        F.col("variable").alias("group_variable"),
        F.col("value").alias("group_value"),
        F.col("_p.day").alias("day"),
        survival.alias("survival_probability"),
        (1.0 - survival).alias("adoption_probability"),
        "records",
    )


def survival_brier(rows: DataFrame, *, time: str, event: str, risk: str, horizon: float = 30.0) -> DataFrame:
    """Brier score of a risk among rows observed within the horizon; 0 for fewer than two."""
    gap = F.col(risk) - F.col(event).cast("double")
    inside = rows.filter(F.col(time) <= horizon)
    return inside.agg(
        F.count(F.lit(1)).alias("records"),
        F.when(F.count(F.lit(1)) < 2, F.lit(0.0)).otherwise(F.avg(gap * gap)).alias("brier_score"),
    )


def survival_calibration(
    rows: DataFrame, *, time: str, event: str, risk: str, horizon: float = 30.0, bins: int = 10
) -> DataFrame:
    """Straight-line fit of the observed rate on the bin centre over left-closed risk bins."""
    number = F.floor(F.round(F.col(risk) * bins, 9))
    per_bin = (
        rows.filter((F.col(time) <= horizon) & (F.col(risk) >= 0) & (number < bins))
        .groupBy(number.alias("_b"))
        .agg(F.avg(F.col(event).cast("double")).alias("_o"))
        .withColumn("_c", (F.col("_b") + 0.5) / bins)
    )
    flat = F.stddev_pop("_o") > 0
    return per_bin.agg(
        F.regr_slope("_o", "_c").alias("calibration_slope"),
        F.regr_intercept("_o", "_c").alias("calibration_intercept"),
        F.when(flat, F.regr_r2("_o", "_c")).otherwise(0.0).alias("calibration_r2"),
    )


def _quantile_bin(score: Column, edges: Sequence[str]) -> Column:
    inside = edges[:-1]
    reached = F.lit(0)
    for e in inside:
        reached = reached + (score >= F.col(e)).cast("int")
    return reached


def risk_calibration(rows: DataFrame, *, risk: str, event: str, bins: int = 10) -> DataFrame:
    """Observed and expected rate per quantile bin of a risk score, with its chi-square part."""
    names = {f"_e{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(rows, [], risk, names)
    # one row of bin edges
    binned = (
        rows.filter(F.col(risk).isNotNull())
        .withColumn("_k", F.lit(0))
        .join(F.broadcast(edges.withColumn("_k", F.lit(0))), "_k")
        .withColumn("bin", _quantile_bin(F.col(risk), list(names)))
    )
    per_bin = binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("records"),
        F.avg(F.col(event).cast("double")).alias("observed_rate"),
        F.avg(risk).alias("expected_rate"),
    )
    gap = F.col("observed_rate") - F.col("expected_rate")
    return per_bin.withColumn("chi_square", gap * gap / (F.col("expected_rate") + 1e-10) * F.col("records"))


def chi_square_tail(x: float, dof: int) -> float:
    """Probability of a chi-square value above ``x`` by the finite sums for whole degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if dof % 2 == 0:
        term, total = 1.0, 1.0
        for k in range(1, dof // 2):
            term *= half / k
            total += term
        return math.exp(-half) * total
    total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for k in range(1, (dof - 1) // 2 + 1):
        total += term
        term *= half / (k + 0.5)
    return total


def risk_calibration_test(per_bin: DataFrame, bins: int = 10) -> dict[str, float | int | bool]:
    """Chi-square statistic and tail probability from the bin table."""
    statistic = float(per_bin.agg(F.sum("chi_square")).first()[0] or 0.0)
    tail = chi_square_tail(statistic, bins - 2)
    return {
        "chi_square_statistic": statistic,
        "degrees_of_freedom": bins - 2,
        "p_value": tail,
        "calibration_passes": tail > 0.05,
    }


def covariate_trends(rows: DataFrame, covariates: Sequence[str], *, time: str) -> DataFrame:
    """Slope of each numeric covariate on time / max(time), from one aggregate."""
    fits = F.array(
        *[
            F.struct(
                F.lit(c).alias("variable"),
                (F.regr_slope(F.col(c).cast("double"), F.col(time).cast("double")) * F.max(F.col(time))).alias("slope"),
            )
            for c in covariates
        ]
    )
    return (
        rows.agg(fits.alias("_f"))
        .select(F.explode("_f").alias("_f"))
        .select("_f.variable", "_f.slope", F.lit(0.0).alias("t_statistic"), F.lit(False).alias("time_dependent"))
    )


def survival_validation(rows: DataFrame, *, time: str, event: str) -> DataFrame:
    """Counts, range, event rate and a quality grade by the number of columns with gaps."""
    if time not in rows.columns or event not in rows.columns:
        missing = [c for c in (time, event) if c not in rows.columns]
        raise ValueError(f"missing survival columns: {missing}")
    e = F.col(event).cast("bigint")
    out = rows.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col(time).isNull()).alias("missing_time"),
        F.count_if(F.col(event).isNull()).alias("missing_event"),
        F.min(time).cast("double").alias("min_time"),
        F.max(time).cast("double").alias("max_time"),
        F.avg(time).alias("mean_time"),
        F.avg(e).alias("event_rate"),
        F.sum(e).alias("n_events"),
        (F.count(F.lit(1)) - F.sum(e)).alias("n_censored"),
    )
    issues = (F.col("missing_time") > 0).cast("int") + (F.col("missing_event") > 0).cast("int")
    empty = F.col("total_records") == 0
    return out.withColumns(
        {
            "data_quality": F.when(empty, "empty").when(issues == 0, "good").otherwise("acceptable"),
            "is_valid": ~empty,
        }
    )
