"""Cohort, timing and profile tables.

Counts, sums and rates are combined per joint cell first and then stacked by dimension.
Medians and quantiles of unbounded values use running counts (``exact_quantiles``); with
``whole_days=True`` a duration has few distinct values and Spark's own exact percentile,
which keeps one counter per distinct value, is used instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions.labels import profile_label, visibility_from_history
from sojourn.operators.skew import exact_quantiles, null_safe_join, stack_dimensions, stacked_sums


def group_quantiles(
    rows: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float], whole_days: bool
) -> DataFrame:
    if not whole_days:
        return exact_quantiles(rows, keys, value, quantiles)
    return (
        rows.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(*[F.percentile(value, q).alias(name) for name, q in quantiles.items()])
    )


def grouped(
    rows: DataFrame,
    keys: Sequence[str],
    measures: Sequence[Column],
    value: str,
    quantiles: Mapping[str, float],
    whole_days: bool,
) -> DataFrame:
    """Measures and quantiles of one value per group; one aggregate where the value allows it."""
    if whole_days:
        spread = [F.percentile(value, q).alias(name) for name, q in quantiles.items()]
        return rows.groupBy(*keys).agg(*measures, *spread)
    sums = rows.groupBy(*keys).agg(*measures)
    spread = exact_quantiles(rows, keys, value, quantiles)
    if not keys:
        # two one-row tables
        tagged = sums.withColumn("_k", F.lit(0))
        return tagged.join(F.broadcast(spread.withColumn("_k", F.lit(0))), "_k").drop("_k")
    return null_safe_join(sums, spread, keys, "left")


def summarize(
    rows: DataFrame,
    dims: Sequence[str],
    *,
    label: str,
    days: str,
    whole_days: bool = False,
    value_labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """Records, positives, rate and median days per value of every dimension, in long form."""
    y = F.col(label)
    cells = rows.groupBy(*dims, days).agg(F.count(y).alias("_n"), F.sum(y.cast("bigint")).alias("_y"), F.count(F.lit(1)).alias("_w"))
    long = stack_dimensions(cells, dims, [days, "_n", "_y", "_w"])
    keys = ["variable", "value"]
    measures = [F.sum("_n").alias("records"), F.sum("_y").alias("adoptions")]
    if whole_days:
        median = F.percentile(days, 0.5, F.col("_w")).alias("median_days_to_outcome")
        table = long.groupBy(*keys).agg(*measures, median)
    else:
        medians = exact_quantiles(long, keys, days, {"median_days_to_outcome": 0.5}, weight="_w")
        table = null_safe_join(long.groupBy(*keys).agg(*measures), medians, keys, "left")
    out = table.withColumn("adoption_rate_pct", F.col("adoptions") / F.nullif(F.col("records"), F.lit(0)) * 100)
    if value_labels:
        shown = F.col("value")
        for key, text in value_labels.items():
            shown = F.when(F.col("value") == key, text).otherwise(shown)
        out = out.withColumn("value", shown)
    return out.select(
        "variable", "value", "records", "adoptions", "adoption_rate_pct", "median_days_to_outcome"
    ).withColumns(
        {
            "target_column": F.lit("classification_target/regression_target_days"),
            "population_scope": F.lit("all matched episodes"),
            "estimand_label": F.lit("adoption_rate_and_median_los"),
        }
    )


def extremes(summary: DataFrame) -> DataFrame:
    """Values with the highest and lowest rate and the longest and shortest median, and the spans."""
    rate, median = F.col("adoption_rate_pct"), F.col("median_days_to_outcome")
    return summary.groupBy("variable").agg(
        F.max_by("value", F.struct(rate, "value")).alias("highest_rate_value"),
        F.min_by("value", F.struct(rate, "value")).alias("lowest_rate_value"),
        F.max_by("value", F.struct(median, "value")).alias("longest_median_value"),
        F.min_by("value", F.struct(median, "value")).alias("shortest_median_value"),
        (F.max(rate) - F.min(rate)).alias("rate_gap"),
        (F.max(median) - F.min(median)).alias("median_gap"),
    )


def yearly_counts(rows: DataFrame, *, year: str, label: str) -> DataFrame:
    return rows.groupBy(year).agg(
        F.count(F.lit(1)).alias("starts"),
        F.count(label).alias("outcomes"),
        F.sum(F.col(label).cast("bigint")).alias("adoptions"),
        (F.avg(F.col(label).cast("double")) * 100).alias("adoption_rate_pct"),
    )


def adopted_timing(
    rows: DataFrame,
    *,
    dims: Sequence[str],
    entity_type: str,
    label: str,
    days: str,
    marks: Sequence[int] = (7, 30, 60, 90),
) -> DataFrame:
    """Timing of positive episodes per dimension value, for each entity type and combined.

    Totals count all rows of the group, timing only the positive ones. Rows are counted per joint cell
    (all dimensions, type, days) first; the histograms of single values, from which the exact
    quantiles are read, are sums of cells.
    """
    both = F.explode(
        F.array(F.col(entity_type).cast("string"), F.lit("Combined"))
    )
    hit = F.col(label) == 1
    value = F.when(hit, F.col(days))
    joint = [*[d for d in dims if d != entity_type], entity_type]
    cells = rows.groupBy(*joint, hit.alias("_hit"), value.alias("_days")).agg(F.count(F.lit(1)).alias("_n"))
    split = stack_dimensions(cells, dims, [entity_type, "_hit", "_days", "_n"]).select(
        "variable", "value", both.alias("animal_type"), "_hit", "_days", "_n"
    )
    keys = ["variable", "value", "animal_type"]
    histogram = split.groupBy(*keys, "_days").agg(
        F.sum("_n").alias("_n"), F.sum(F.when(F.col("_hit"), F.col("_n")).otherwise(F.lit(0))).alias("_hits")
    )
    timed = F.when(F.col("_days").isNotNull() & ~F.isnan(F.col("_days").cast("double")), F.col("_n"))
    sums = histogram.groupBy(*keys).agg(
        F.sum("_n").alias("all_records"),
        F.sum("_hits").alias("adopted_records"),
        (F.sum(F.col("_days") * timed) / F.sum(timed)).alias("mean_days_to_adoption"),
        *[F.sum(F.when(F.col("_days") <= m, F.col("_n")).otherwise(F.lit(0))).alias(f"adopted_within_{m}_days") for m in marks],
    )
    names = {"p25_days_to_adoption": 0.25, "median_days_to_adoption": 0.5, "p75_days_to_adoption": 0.75}
    spread = exact_quantiles(histogram, keys, "_days", names, weight="_n")
    return (
        null_safe_join(sums.filter(F.col("mean_days_to_adoption").isNotNull()), spread, keys, "left")
        .withColumnRenamed("variable", "group_variable")
        .withColumnRenamed("value", "group_value")
    )


def milestones(
    rows: DataFrame,
    dims: Sequence[str],
    *,
    label: str,
    days: str,
    marks: Sequence[int] = (7, 30, 60, 90),
    min_records: int = 50,
) -> DataFrame:
    """Share of positive episodes done by each day mark, per value; 0 where there is none."""
    hit = (F.col(label) == 1).cast("bigint")
    measures: dict[str, Column] = {"records": F.lit(1).cast("bigint"), "adoptions": hit}
    measures |= {f"_d{m}": F.when(F.col(days) <= m, hit).otherwise(F.lit(0).cast("bigint")) for m in marks}
    out = stacked_sums(rows, dims, measures).filter(F.col("records") >= min_records)
    share = lambda c: F.when(F.col("adoptions") > 0, F.col(c) * 100.0 / F.col("adoptions")).otherwise(0.0)
    return out.select(
        F.col("variable").alias("cohort"),
        "value",
        "records",
        "adoptions",
        (F.col("adoptions") * 100.0 / F.col("records")).alias("adoption_rate_pct"),
        *[share(f"_d{m}").alias(f"adopted_by_day_{m}_pct") for m in marks],
    )


def archetypes(
    rows: DataFrame,
    profile: Sequence[str],
    *,
    label: str,
    days: str,
    end_type: str,
    end_types: Mapping[str, str],
    label_groups: Sequence[Sequence[str]],
    min_records: int = 50,
    long_days: float = 14,
    whole_days: bool = False,
) -> DataFrame:
    """One row per profile: size, rate, duration, share of every end type, and two labels."""
    measures = [
        F.count(label).alias("records"),
        F.sum(F.col(label).cast("bigint")).alias("adoptions"),
        (F.avg(F.col(label).cast("double")) * 100).alias("adoption_rate_pct"),
        F.avg(days).alias("mean_days_to_outcome"),
        *[
            (F.count_if(F.col(end_type) == value) * 100.0 / F.count(F.lit(1))).alias(f"{name}_rate_pct")
            for name, value in end_types.items()
        ],
    ]
    table = grouped(rows, profile, measures, days, {"median_days_to_outcome": 0.5}, whole_days)
    return table.filter(F.col("records") >= min_records).withColumns(
        {
            "profile_label": profile_label([[F.col(c) for c in group] for group in label_groups]),
            "visibility_need": visibility_from_history(
                F.col("adoption_rate_pct"), F.col("median_days_to_outcome"), long_days
            ),
        }
    )


def vulnerable_profiles(table: DataFrame, top: int = 30) -> DataFrame:
    """Profiles ranked by low rate, long stay and size."""
    score = (
        (100 - F.col("adoption_rate_pct"))
        + F.log1p(F.greatest(F.col("median_days_to_outcome"), F.lit(0.0))) * 10
        + F.log1p(F.col("records"))
    )
    return (
        table.withColumn("vulnerability_score", score)
        .orderBy(F.desc("vulnerability_score"), F.desc("records"), "profile_label")
        .limit(top)
    )


def contrasts(
    rows: DataFrame,
    named: Mapping[str, Column],
    *,
    label: str,
    days: str,
    end_type: str,
    end_types: Mapping[str, str],
    whole_days: bool = False,
) -> DataFrame:
    """Measures per value of named contrasts. A contrast is a column that is null for rows outside it."""
    tags = F.explode(
        F.filter(
            F.array(*[F.struct(F.lit(n).alias("contrast"), c.alias("contrast_value")) for n, c in named.items()]),
            lambda s: s["contrast_value"].isNotNull(),
        )
    )
    tagged = rows.select(
        tags.alias("_t"), F.col(label).alias("_y"), F.col(days).alias("_d"), F.col(end_type).alias("_e")
    ).select("_t.contrast", "_t.contrast_value", "_y", "_d", "_e")
    keys = ["contrast", "contrast_value"]
    measures = [
        F.count("_y").alias("records"),
        (F.avg(F.col("_y").cast("double")) * 100).alias("adoption_rate_pct"),
        *[
            (F.count_if(F.col("_e") == value) * 100.0 / F.count(F.lit(1))).alias(f"{name}_rate_pct")
            for name, value in end_types.items()
        ],
    ]
    return grouped(tagged, keys, measures, "_d", {"median_days_to_outcome": 0.5}, whole_days)


def profile_error(
    scored: DataFrame,
    profile: Sequence[str],
    table: DataFrame,
    *,
    label: str,
    score: str,
    predicted_days: str,
    absolute_error: str,
    label_groups: Sequence[Sequence[str]],
    whole_days: bool = False,
) -> DataFrame:
    """Model error per profile with the profile's label from the archetype table."""
    measures = [
        F.count(label).alias("records"),
        (F.avg(F.col(label).cast("double")) * 100).alias("adoption_rate_pct"),
        (F.avg(score) * 100).alias("mean_predicted_adoption_probability"),
        F.avg(absolute_error).alias("mae"),
    ]
    named = grouped(scored, profile, measures, predicted_days, {"median_predicted_days": 0.5}, whole_days).withColumns(
        {
            "prediction_gap_pct": F.col("mean_predicted_adoption_probability") - F.col("adoption_rate_pct"),
            "profile_label": profile_label([[F.col(c) for c in group] for group in label_groups]),
        }
    )
    return named.join(table.select("profile_label", "visibility_need"), "profile_label", "left")


def period_matrix(
    rows: DataFrame, *, period: str, periods: Sequence[str], label: str, days: str, whole_days: bool = False
) -> DataFrame:
    """Rate, medians and volume per period; periods without rows are listed too."""
    positive = F.when(F.col(label) == 1, F.col(days))
    base = rows.select(period, label, days, positive.alias("_positive_days"))
    listed = rows.sparkSession.createDataFrame([(p,) for p in periods], f"{period} string")
    measures = [F.count(F.lit(1)).alias("n_records"), F.avg(F.col(label).cast("double")).alias("adoption_rate")]
    every = grouped(base, [period], measures, days, {"median_los_days": 0.5}, whole_days)
    adopted = group_quantiles(base, [period], "_positive_days", {"median_days_to_adoption": 0.5}, whole_days)
    out = listed.join(every, period, "left").join(adopted, period, "left")
    return out.fillna(0, subset=["n_records"]).withColumn("intake_volume", F.col("n_records"))


def period_mix(
    rows: DataFrame, *, period: str, periods: Sequence[str], shares: Mapping[str, tuple[str, Sequence[str]]]
) -> DataFrame:
    """Percent of each listed category per period, wide; ``shares`` maps a prefix to (column, values)."""
    listed = rows.sparkSession.createDataFrame([(p,) for p in periods], f"{period} string")
    names = {
        f"pct_{prefix}{str(v).lower().replace(' ', '_').replace('-', '_')}": (c, v)
        for prefix, (c, values) in shares.items()
        for v in values
    }
    counts = rows.groupBy(period).agg(
        F.count(F.lit(1)).alias("n_records"),
        *[F.count_if(F.col(c) == v).alias(name) for name, (c, v) in names.items()],
    )
    out = listed.join(counts, period, "left").fillna(0)
    return out.select(
        period,
        "n_records",
        *[F.round(100.0 * F.col(n) / F.greatest(F.col("n_records"), F.lit(1)), 2).alias(n) for n in names],
    )


def with_subsets(rows: DataFrame, entity_type: str, subsets: Mapping[str, str], combined: str = "combined") -> DataFrame:
    """Rows once for ``combined`` and once for the subset of their entity type."""
    own = None
    kind = F.lower(F.trim(F.col(entity_type).cast("string")))
    for name, value in subsets.items():
        own = F.when(kind == value, name) if own is None else own.when(kind == value, name)
    tags = F.explode(F.array_compact(F.array(F.lit(combined), own)))
    return rows.select("*", tags.alias("animal_subset"))


def group_evidence(
    rows: DataFrame,
    *,
    group: str,
    entity_type: str,
    subsets: Mapping[str, str],
    label: str,
    days: str,
    whole_days: bool = False,
) -> DataFrame:
    """Rate over all rows outer-joined with the median over positive rows, per subset and group."""
    tagged = with_subsets(rows.select(group, entity_type, label, days), entity_type, subsets)
    keys = [group, "animal_subset"]
    rates = tagged.groupBy(*keys).agg(
        F.count(label).alias("records"),
        F.sum(F.col(label).cast("bigint")).alias("adoptions"),
        F.avg(F.col(label).cast("double")).alias("adoption_rate"),
    )
    adopted = tagged.filter(F.col(label) == 1)
    counted = [F.count(days).alias("adopted_records")]
    timing = grouped(adopted, keys, counted, days, {"median_days_to_adoption": 0.5}, whole_days)
    renamed = timing.select(F.col(group).alias("_g"), F.col("animal_subset").alias("_s"), "adopted_records", "median_days_to_adoption")
    return rates.join(
        renamed, rates[group].eqNullSafe(renamed["_g"]) & (rates["animal_subset"] == renamed["_s"]), "outer"
    ).select(
        F.coalesce(group, "_g").alias(group),
        F.coalesce("animal_subset", "_s").alias("animal_subset"),
        "records",
        "adoptions",
        "adoption_rate",
        "adopted_records",
        "median_days_to_adoption",
    )


def duration_quantiles(
    rows: DataFrame,
    *,
    group: str,
    days: str,
    quantiles: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99),
    whole_days: bool = False,
) -> DataFrame:
    """Linear quantiles of a duration per group, one row per quantile."""
    names = {f"q{i}": q for i, q in enumerate(quantiles)}
    wide = group_quantiles(rows, [group], days, names, whole_days)
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.explode(
        F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.col(name).alias("days")) for name, q in names.items()])
    )
    return (
        null_safe_join(counts, wide, [group], "left")
        .select(group, "n", pairs.alias("_p"))
        .select(group, "_p.quantile", F.col("_p.days").alias("duration_days"), "n")
    )


def cohort_finder(
    scored: DataFrame, dims: Sequence[str], *, label: str, score: str, days: str, whole_days: bool = False
) -> DataFrame:
    """Size, observed and predicted percent and median days for every combination of filters.

    A null dimension means "not filtered"; ``filtered_on`` names the filters that are set.
    """
    measures = scored.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_y"), F.sum(score).alias("_p")
    )
    sets = F.array(
        *[
            F.struct(
                F.lit(" ".join(d for i, d in enumerate(dims) if mask >> i & 1) or "nothing").alias("filtered_on"),
                *[(F.col(d) if mask >> i & 1 else F.lit(None)).cast("string").alias(d) for i, d in enumerate(dims)],
            )
            for mask in range(1 << len(dims))
        ]
    )
    keys = ["filtered_on", *dims]
    sums = (
        measures.select(F.explode(sets).alias("_s"), "_n", "_y", "_p")
        .select("_s.*", "_n", "_y", "_p")
        .groupBy(*keys)
        .agg(
            F.sum("_n").alias("cohort_size"),
            (F.sum("_y") * 100.0 / F.sum("_n")).alias("observed_pct"),
            (F.sum("_p") * 100.0 / F.sum("_n")).alias("mean_predicted_pct"),
        )
    )
    by_days = scored.filter(F.col(days).isNotNull()).groupBy(*dims, days).agg(F.count(F.lit(1)).alias("_n"))
    spread = by_days.select(F.explode(sets).alias("_s"), days, "_n").select("_s.*", days, "_n")
    if whole_days:
        medians = spread.groupBy(*keys).agg(F.percentile(days, 0.5, F.col("_n")).alias("median_days"))
    else:
        medians = exact_quantiles(spread, keys, days, {"median_days": 0.5}, weight="_n")
    return null_safe_join(sums, medians, keys, "left")


def cohort_rows(scored: DataFrame, filters: Mapping[str, str], columns: Sequence[str], first: int = 100) -> DataFrame:
    """The first rows of one cohort."""
    out = scored
    for c, value in filters.items():
        out = out.filter(F.col(c) == value)
    return out.select(*columns).orderBy(*columns).limit(first)


def slice_view(table: DataFrame, metric: str) -> DataFrame:
    """One label column from either of two slice layouts."""
    if metric not in table.columns or "records" not in table.columns:
        raise ValueError(f"table has no {metric} and records")
    if "cohort" in table.columns:
        label: Column = F.col("cohort").cast("string")
    elif {"slice", "value"} <= set(table.columns):
        label = F.concat(F.col("slice").cast("string"), F.lit(": "), F.coalesce(F.col("value").cast("string"), F.lit("nan")))
    else:
        label = F.col("value").cast("string")
    return table.select(label.alias("cohort"), metric, "records")


def long_form(table: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return table.unpivot(list(ids), list(values), "metric", "metric_value")


def nearest_row(table: DataFrame, column: str, target: float) -> DataFrame:
    """The row whose value is closest to the target, the smaller one on a tie."""
    return table.orderBy(F.abs(F.col(column) - F.lit(target)), column).limit(1)


def risk_evidence(profiles: DataFrame, top: int = 5) -> DataFrame:
    """Evidence rows for the profiles ranked first."""
    best = profiles.orderBy(F.desc("vulnerability_score"), F.desc("records"), "profile_label").limit(top)
    return best.select(
        F.lit("animal_profiles").alias("section"),
        F.col("profile_label").alias("item"),
        F.lit("vulnerability_score").alias("metric"),
        F.col("vulnerability_score").alias("value"),
        "records",
        "adoption_rate_pct",
        "visibility_need",
    )
