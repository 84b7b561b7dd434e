"""From raw start and end records to the episode table, its horizon labels and its files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.functions.clean import age_aliases, clean_events, parse_wall_clock, volume_filter, volume_filter_audit
from sojourn.functions.text import start_features
from sojourn.operators.context import add_context, require_history, requests_daily, weather_daily
from sojourn.operators.episodes import (
    conservation_counts,
    episode_targets,
    episode_violations,
    horizon_labels,
    horizon_violations,
    pair_episodes,
    raise_on_violations,
)
from sojourn.sources import contracts
from sojourn.sources.tables import write_registry, write_table

SUPPORTED_TYPES = ("dog", "cat")

# Column order and types of the episode table.
DATASET_SCHEMA = {
    "animal_id": "string", "animal_type": "string", "intake_datetime": "timestamp_ntz", "outcome_datetime": "timestamp_ntz",
    "intake_type": "string", "intake_condition": "string", "outcome_type": "string", "outcome_subtype": "string",
    "sex_upon_intake": "string", "sex_upon_outcome": "string", "age_upon_intake": "string", "age_upon_outcome": "string",
    "breed": "string", "color": "string", "found_location_kind": "string", "found_location_area": "string",
    "is_austin_found_location": "boolean", "is_outside_jurisdiction": "boolean", "is_intersection_location": "boolean",
    "is_address_like_location": "boolean", "is_airport_location": "boolean", "has_name": "boolean", "is_named": "boolean",
    "age_in_days": "double", "age_in_months": "double", "age_in_years": "double", "age_days": "double", "age_months": "double",
    "age_years": "double", "age_group": "string", "intake_year": "int", "intake_month": "int", "intake_quarter": "int",
    "intake_season": "string", "covid_period": "string", "color_group": "string", "primary_color": "string",
    "simplified_color_group": "string", "is_black_or_dark": "boolean", "primary_breed": "string", "is_mixed_breed": "boolean",
    "simplified_breed_group": "string", "days_to_outcome": "double", "length_of_stay": "double", "adopted": "boolean",
    "is_adopted": "boolean", "target_adopted": "int", "classification_target": "int", "regression_target_days": "double",
    "days_to_adoption": "double",
}
INTAKE_COLUMNS = (
    "animal_id", "name", "animal_type", "intake_datetime", "intake_type", "intake_condition", "sex_upon_intake",
    "age_upon_intake", "breed", "color", "found_location",
)
OUTCOME_COLUMNS = (
    "animal_id", "outcome_datetime", "outcome_type", "outcome_subtype", "sex_upon_outcome", "age_upon_outcome",
)
# Features known at the start, context features, and targets.
BASE_COLUMNS = (
    "animal_type", "intake_type", "intake_condition", "sex_upon_intake", "age_days", "age_group", "primary_breed",
    "is_mixed_breed", "simplified_breed_group", "found_location_kind", "found_location_area", "is_austin_found_location",
    "is_outside_jurisdiction", "is_intersection_location", "is_address_like_location", "is_airport_location",
    "primary_color", "simplified_color_group", "is_black_or_dark", "is_named", "intake_year", "intake_month", "covid_period",
)
CONTEXT_COLUMNS = (
    "daily_temp_max", "daily_temp_min", "daily_precipitation", "is_extreme_heat", "is_rainy_day",
    "animal_311_requests_7d", "animal_311_requests_30d", "intake_volume_7d", "intake_volume_30d",
)
FEATURE_COLUMNS = BASE_COLUMNS + CONTEXT_COLUMNS
TARGET_COLUMNS = (
    "adopted", "is_adopted", "target_adopted", "classification_target", "regression_target_days", "days_to_outcome",
    "days_to_adoption", "length_of_stay",
)
FALSE_DEFAULTS = {c: False for c, kind in DATASET_SCHEMA.items() if kind == "boolean"}
DEFAULTS = {**FALSE_DEFAULTS, "target_adopted": 0, "classification_target": 0}


@dataclass(frozen=True)
class BuiltDataset:
    dataset: DataFrame
    unresolved: DataFrame
    horizon: DataFrame
    conservation: DataFrame
    violations: DataFrame


def snapshot_date(intakes: DataFrame, outcomes: DataFrame) -> datetime | None:
    """Latest time in either table, read with the same parser as the cleaning."""
    times = intakes.select(parse_wall_clock(F.col("intake_datetime")).alias("t")).unionByName(
        outcomes.select(parse_wall_clock(F.col("outcome_datetime")).alias("t"))
    )
    return times.agg(F.max("t")).first()[0]


def _derived(rows: DataFrame) -> DataFrame:
    featured = start_features(rows, ts="intake_datetime")
    return featured.withColumns({**age_aliases(F.col("age_days")), "has_name": F.col("is_named")})


def build_dataset(
    intakes: DataFrame,
    outcomes: DataFrame,
    *,
    extract_end: datetime,
    weather: DataFrame | None = None,
    requests: DataFrame | None = None,
    horizons: Sequence[int] = (7, 30, 60, 90),
    types: Sequence[str] = SUPPORTED_TYPES,
) -> BuiltDataset:
    """One lazy plan from two record tables to episodes, unresolved starts and horizon labels."""
    starts = contracts.existing_columns(
        clean_events(intakes, entity="animal_id", entity_type="animal_type", ts="intake_datetime", allowed=types, name="intakes"),
        INTAKE_COLUMNS,
    )
    ends = contracts.existing_columns(
        clean_events(
            outcomes, entity="animal_id", entity_type="animal_type", ts="outcome_datetime", allowed=types,
            required=("outcome_type",), other_times=("date_of_birth",), name="outcomes",
        ),
        OUTCOME_COLUMNS,
    )
    pairs = pair_episodes(
        starts, ends, entity="animal_id", start_ts="intake_datetime", end_ts="outcome_datetime",
        end_type="outcome_type", extract_end=extract_end,
    )
    every = _derived(
        episode_targets(
            pairs.all_starts, start_ts="intake_datetime", end_ts="outcome_datetime", end_type="outcome_type"
        )
    )
    schema = dict(DATASET_SCHEMA)
    if weather is not None and requests is not None:
        every = add_context(
            every, starts=intakes.withColumn("intake_datetime", parse_wall_clock(F.col("intake_datetime"))),
            weather=weather_daily(weather), requests=requests_daily(requests), entity="animal_id", ts="intake_datetime",
        )
        kinds = dict(every.dtypes)
        schema |= {c: kinds[c] for c in (*CONTEXT_COLUMNS, "weather_available")}
    matched = every.filter("is_matched")
    dataset = contracts.select_with_defaults(matched, schema, DEFAULTS)
    unresolved = every.filter(~F.col("is_matched")).withColumn("unresolved_reason", F.lit("no_unused_future_outcome"))
    horizon = horizon_labels(
        every.withColumn("adopted", F.when(F.col("is_matched"), F.col("adopted"))),
        start_ts="intake_datetime", end_ts="outcome_datetime", extract_end=extract_end, horizons=horizons,
    )
    return BuiltDataset(
        dataset=dataset,
        unresolved=unresolved,
        horizon=horizon,
        conservation=conservation_counts(starts, pairs, entity="animal_id", start_ts="intake_datetime"),
        violations=episode_violations(dataset.withColumn("_t", F.trim("animal_type")), entity_type="_t", allowed=types),
    )


def write_dataset(
    intakes: DataFrame,
    outcomes: DataFrame,
    folder: str,
    *,
    extract_end: datetime | None = None,
    weather: DataFrame | None = None,
    requests: DataFrame | None = None,
    max_volume: float | None = None,
    horizons: Sequence[int] = (7, 30, 60, 90),
) -> None:
    """Build, check and write all tables, episodes partitioned by start year.

    The episode table feeds the checks and three sinks, so the horizon table (all starts) is
    written first and everything else is read back from it instead of being computed again.
    """
    spark = intakes.sparkSession
    limit = extract_end or snapshot_date(intakes, outcomes)
    if limit is None:
        raise ValueError("no valid time in either table")
    built = build_dataset(
        intakes, outcomes, extract_end=limit, weather=weather, requests=requests, horizons=horizons
    )
    write_table(built.horizon, f"{folder}/horizon", partition_by=["intake_year"])
    stored = spark.read.parquet(f"{folder}/horizon")
    raise_on_violations(horizon_violations(stored, start_ts="intake_datetime", extract_end=limit), ignore=())
    counts = built.conservation.first()
    if not counts["conserved"] or not counts["matched"]:
        raise ValueError(f"start counts do not add up: {counts.asDict()}")

    columns = built.dataset.columns
    episodes = contracts.select_with_defaults(stored.filter("is_matched"), dict(built.dataset.dtypes), DEFAULTS)
    raise_on_violations(
        episode_violations(episodes.withColumn("_t", F.trim("animal_type")), entity_type="_t", allowed=SUPPORTED_TYPES)
    )
    if weather is not None:
        require_history(stored, ["intake_volume_7d", "intake_volume_30d"])
    if max_volume is not None and "intake_volume_7d" in columns:
        write_table(volume_filter_audit(episodes, "intake_volume_7d", max_volume), f"{folder}/volume_audit")
        episodes = volume_filter(episodes, "intake_volume_7d", max_volume)
    write_table(episodes, f"{folder}/episodes", partition_by=["intake_year"])
    write_table(stored.filter(~F.col("is_matched")), f"{folder}/unresolved")

    write_registry(spark, f"{folder}/columns", column_lists(columns, horizons))


def column_lists(columns: Sequence[str], horizons: Sequence[int] = (7, 30, 60, 90)) -> dict[str, list[str]]:
    """The features, targets and context columns that a table has, and its horizon labels."""
    return {
        "feature_columns": contracts.start_features(columns, FEATURE_COLUMNS),
        "target_columns": [c for c in TARGET_COLUMNS if c in columns],
        "context_columns": [c for c in CONTEXT_COLUMNS if c in columns],
        "horizon_target_columns": [f"adopted_in_{h}d" for h in horizons],
    }


def example_records(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw-looking start and end records derived from an event table (times as text)."""
    pick = lambda n, *words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("event_id") % n + 1).cast("int"))
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    intakes = events.filter(F.col("event_type") == "signup").select(
        F.col("user_id").cast("string").alias("animal_id"),
        text.alias("intake_datetime"),
        pick(5, "Dog", "Cat", " dog ", "Bird", "Cat").alias("animal_type"),
        F.concat((F.col("event_id") % 15 + 1).cast("string"), pick(2, " years", " months")).alias("age_upon_intake"),
        pick(4, "Black/White", "Brown Tabby", "Calico", "Blue Merle").alias("color"),
        pick(3, "Pit Bull Mix", "Domestic Shorthair", "Beagle Hound/Boxer").alias("breed"),
        pick(4, "12 Main St in Austin (TX)", "Travis (TX)", "Outside Jurisdiction", "Elm and Oak").alias("found_location"),
        pick(4, "Stray", "Owner Surrender", "Public Assist", "Stray").alias("intake_type"),
        pick(5, "Normal", "Injured", "Nursing", "Feral", "Sick").alias("intake_condition"),
        pick(2, "Intact Male", "Spayed Female").alias("sex_upon_intake"),
        pick(3, "Rex", "", "Mia").alias("name"),
    )
    outcomes = events.filter(F.col("event_type").isin("purchase", "error")).select(
        F.col("user_id").cast("string").alias("animal_id"),
        F.concat(text, F.lit("-05:00")).alias("outcome_datetime"),
        F.lit("Dog").alias("animal_type"),
        F.when(F.col("event_type") == "purchase", "Adoption").otherwise("Transfer").alias("outcome_type"),
    )
    return intakes, outcomes
