"""Feature families and importance tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Features per family.
FAMILIES: Mapping[str, Sequence[str]] = {
    "age": (
        "age_upon_intake", "age_days", "age_months", "age_years", "age_in_days", "age_in_months", "age_in_years", "age_group",
    ),
    "sex_reproductive_status": ("sex_upon_intake",),
    "intake_circumstances": ("intake_type",),
    "intake_condition_health": ("intake_condition",),
    "breed_appearance": ("breed", "primary_breed", "is_mixed_breed", "simplified_breed_group"),
    "color": ("color", "primary_color", "simplified_color_group", "is_black_or_dark"),
    "name_identity": ("has_name", "is_named"),
    "location": (
        "found_location_kind", "found_location_area", "is_austin_found_location", "is_outside_jurisdiction",
        "is_intersection_location", "is_address_like_location", "is_airport_location",
    ),
    "timing_seasonality": ("intake_year", "intake_month", "intake_quarter", "intake_season"),
    "covid_period": ("covid_period",),
    "animal_type": ("animal_type",),
    "weather_context": ("daily_temp_max", "daily_temp_min", "daily_precipitation", "is_extreme_heat", "is_rainy_day"),
    "shelter_demand_context": (
        "animal_311_requests_7d", "animal_311_requests_30d", "intake_volume_7d", "intake_volume_30d",
    ),
}

# Parts of (possibly expanded) feature names per family, first match wins.
FAMILY_PARTS: Mapping[str, Sequence[str]] = {
    "age": ("age_",),
    "intake_circumstances": ("intake_type",),
    "intake_condition_health": ("intake_condition",),
    "sex_reproductive_status": ("sex_upon_intake",),
    "breed_appearance": ("breed",),
    "color": ("color", "is_black_or_dark"),
    "name_identity": ("has_name", "is_named"),
    "timing_seasonality": ("intake_year", "intake_month", "intake_quarter", "intake_season"),
    "covid_period": ("covid_period",),
    "weather_context": ("daily_temp", "daily_precipitation", "is_extreme_heat", "is_rainy_day"),
    "shelter_demand_context": ("animal_311_requests", "intake_volume"),
    "animal_type": ("animal_type",),
}
FAMILY_LABELS: Mapping[str, str] = {
    "age": "Age",
    "sex_reproductive_status": "Sex / Reproductive Status",
    "intake_circumstances": "Intake Circumstances",
    "intake_condition_health": "Intake Condition / Health",
    "breed_appearance": "Breed / Appearance",
    "color": "Coat Color",
    "name_identity": "Name / Identity",
    "location": "Found Location",
    "timing_seasonality": "Timing & Seasonality",
    "covid_period": "COVID Period",
    "animal_type": "Animal Type",
    "weather_context": "Weather Context",
    "shelter_demand_context": "Shelter Demand Context",
}


def _first(feature: Column, families: Mapping[str, Sequence[str]], test) -> Column:
    result = None
    for family, words in families.items():
        hit = None
        for word in words:
            one = test(feature, word)
            hit = one if hit is None else hit | one
        result = F.when(hit, family) if result is None else result.when(hit, family)
    return result


def family_exact(feature: Column, families: Mapping[str, Sequence[str]] = FAMILIES) -> Column:
    """Family of a feature by its exact name, else ``other``."""
    return _first(feature, families, lambda c, w: c == w).otherwise("other")


def family_by_part(feature: Column, families: Mapping[str, Sequence[str]] = FAMILY_PARTS) -> Column:
    """Family by a part of the name, else ``other``."""
    return _first(F.lower(feature), families, lambda c, w: F.contains(c, F.lit(w))).otherwise("other")


def family_by_prefix(feature: Column, families: Mapping[str, Sequence[str]]) -> Column:
    """Family by the start of the name, else null."""
    return _first(feature, families, lambda c, w: F.startswith(c, F.lit(w)))


def family_totals(table: DataFrame, score: str, feature: str = "feature") -> DataFrame:
    """Sum, mean, count and feature list per family, largest sum first."""
    label = F.coalesce(
        F.create_map(*[F.lit(x) for pair in FAMILY_LABELS.items() for x in pair])[F.col("family")],
        F.initcap(F.replace(F.col("family"), F.lit("_"), F.lit(" "))),
    )
    # the set holds feature names, of which a table has few
    return (
        table.withColumn("family", family_exact(F.col(feature)))
        .groupBy("family")
        .agg(
            F.sum(score).alias("sum_importance"),
            F.avg(score).alias("mean_importance"),
            F.count(F.lit(1)).alias("n_features"),
            F.array_join(F.array_sort(F.collect_set(feature)), ", ").alias("feature_list"),
        )
        .withColumn("display_label", label)
        .orderBy(F.desc("sum_importance"), "family")
    )


def family_means(
    table: DataFrame, score: str, *, subset: str = "animal_subset", source: str = "source",
    families: Mapping[str, Sequence[str]] = FAMILIES,
) -> DataFrame:
    """Mean score per family, subset and source, with the family's overall mean; unknown features dropped."""
    rows = table.withColumn("family", family_by_prefix(F.col("feature"), families)).filter(F.col("family").isNotNull())
    parts = rows.groupBy("family", subset, source).agg(F.sum(score).alias("_s"), F.count(score).alias("_n"))
    overall = parts.groupBy("family").agg((F.sum("_s") / F.sum("_n")).alias("overall_mean_importance"))
    return parts.select("family", subset, source, (F.col("_s") / F.col("_n")).alias("mean_importance")).join(overall, "family")


def matching_features(table: DataFrame, terms: Sequence[str], score: str) -> DataFrame:
    """Mean score of the features whose name contains any term."""
    pattern = "(?i)" + "|".join(terms)
    return (
        table.filter(F.regexp_like(F.col("feature"), F.lit(pattern)))
        .groupBy("feature")
        .agg(F.avg(score).alias("importance_score"))
        .orderBy(F.desc("importance_score"), "feature")
    )


def family_evidence(families: DataFrame, task: str, score: str, top: int = 5) -> DataFrame:
    return families.orderBy(F.desc(score), "family").limit(top).select(
        F.lit("interpretability").alias("section"),
        F.concat(F.lit(f"{task}: "), F.col("family")).alias("item"),
        F.lit(score).alias("metric"),
        F.col(score).alias("value"),
    )


def attribution_totals(long: DataFrame, value: str) -> DataFrame:
    """Mean absolute and mean contribution per feature from (row, feature, value) rows."""
    return (
        long.groupBy("feature")
        .agg(
            F.avg(F.abs(value)).alias("mean_abs_contribution"),
            F.avg(value).alias("mean_contribution"),
            F.count(F.lit(1)).alias("sample_rows"),
        )
        .orderBy(F.desc("mean_abs_contribution"), "feature")
    )
