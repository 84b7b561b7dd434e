"""Pairing of start and end events into episodes, with censoring and horizon labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.operators.ranking import first_per_group
from sojourn.operators.skew import HOT_ROWS, MICROS_PER_DAY, hot_keys, micros, with_slices

# End types (trimmed, lower case) and the reason they map to.
CENSORING_REASONS: dict[str, tuple[str, ...]] = {
    "adopted": ("adoption",),
    "censored_transfer": ("transfer", "moved", "reintake"),
    "censored_euthanasia": ("euthanize", "euthanasia"),
    "censored_return": ("return_to_owner", "returned"),
    "censored_lost": ("din", "disappear", "missing"),
}
OTHER_REASON = "censored_unknown"
UNRESOLVED_REASON = "no_unused_future_outcome"

_LAST = (1 << 63) - 1
_FIRST = -(1 << 63)


@dataclass(frozen=True)
class Episodes:
    """Lazy outputs of the pairing."""

    all_starts: DataFrame
    matched: DataFrame
    unresolved: DataFrame



def censoring_reason(
    end_type: Column,
    reasons: Mapping[str, Sequence[str]] = CENSORING_REASONS,
    other: str = OTHER_REASON,
) -> Column:
    text = F.lower(F.trim(end_type.cast("string")))
    result = None
    for reason, types in reasons.items():
        test = text.isin(*types)
        result = F.when(test, reason) if result is None else result.when(test, reason)
    return result.otherwise(other)


def _points(starts: DataFrame, ends: DataFrame, entity: str, start_ts: str, end_ts: str) -> DataFrame:
    start_cols = [c for c in starts.columns if c != entity]
    end_cols = [c for c in ends.columns if c != entity]
    s = starts.select(
        entity,
        micros(F.col(start_ts)).alias("_us"),
        F.lit(1).alias("_is_start"),
        F.struct(*start_cols).alias("_start"),
    )
    e = ends.select(
        entity,
        micros(F.col(end_ts)).alias("_us"),
        F.lit(0).alias("_is_start"),
        F.struct(micros(F.col(end_ts)).alias("_us"), F.struct(*end_cols).alias("row")).alias("_end"),
    )
    both = s.unionByName(e, allowMissingColumns=True)
    start_us = F.when(F.col("_is_start") == 1, F.col("_us"))
    return both.select(
        entity,
        "_us",
        "_is_start",
        "_start",
        "_end",
        start_us.alias("_start_us"),
        F.col("_end._us").alias("_end_us"),
        F.col("_is_start").cast("bigint").alias("_n"),
    )


def _instants(points: DataFrame, entity: str) -> DataFrame:
    """One row per (entity, time) and kind: the first start, the first end."""
    return points.groupBy(entity, "_us", "_is_start").agg(
        F.min("_start").alias("_start"),
        F.min("_end").alias("_end"),
        F.min("_start_us").alias("_start_us"),
        F.min("_end_us").alias("_end_us"),
        F.min("_n").alias("_n"),
    )


def _edges(points: DataFrame, entity: str) -> DataFrame:
    """Two marker rows per slice of a cut entity: what lies before it and after it."""
    per_slice = points.groupBy(entity, "_slice").agg(
        F.min("_start_us").alias("first_start"),
        F.min("_end").alias("first_end"),
        F.max("_end_us").alias("last_end"),
        F.count_distinct("_start_us").alias("n"),
    )
    before = Window.partitionBy(entity).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(entity).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(
        entity,
        "_slice",
        F.min("first_start").over(after).alias("_start_us"),
        F.min("first_end").over(after).alias("_end"),
        F.max("last_end").over(before).alias("_end_us"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"),
    )
    upper = carried.select(
        entity, "_slice", F.lit(_LAST).alias("_us"), "_start_us", "_end", F.lit(0).cast("bigint").alias("_n")
    )
    lower = carried.select(entity, "_slice", F.lit(_FIRST).alias("_us"), "_end_us", "_n")
    return upper.unionByName(lower, allowMissingColumns=True).withColumn("_is_start", F.lit(0))


def pair_episodes(
    starts: DataFrame,
    ends: DataFrame,
    *,
    entity: str,
    start_ts: str,
    end_ts: str,
    extract_end: datetime | Column,
    tie_break: Sequence[str] = (),
    end_type: str | None = None,
    reasons: Mapping[str, Sequence[str]] = CENSORING_REASONS,
    slice_rows: int | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> Episodes:
    """Give every start the first end in ``[start, next start)`` not after ``extract_end``.

    Also adds the running episode number, whether the entity was seen before, and the
    whole days since its last earlier end. Starts are unique per (entity, start). All of it
    is one pass over one partitioning of the two inputs by entity. Rows per entity are counted
    first; entities with more than ``hot_rows`` rows are cut into time slices of about ``slice_rows`` rows, with borders
    from the rows, whose neighbours are passed on as marker rows. Of their events at one instant only the first
    start and the first end can count, so these are picked before the cut.
    """
    starts = starts.dropna(subset=[entity, start_ts])
    ends = ends.dropna(subset=[entity, end_ts])
    start_cols = [*tie_break, *[c for c in starts.columns if c != entity and c not in tie_break]]
    end_cols = [c for c in ends.columns if c != entity]
    points = _points(starts.select(entity, *start_cols), ends, entity, start_ts, end_ts)

    hot = None if hot_rows is None else hot_keys([starts, ends], [entity], hot_rows)
    if hot is None or hot.isEmpty():
        rows = points.withColumn("_slice", F.lit(0).cast("bigint"))
    else:
        # every hot key has more than hot_rows rows, so there are at most (rows / hot_rows) of them
        hot = F.broadcast(hot)
        in_hot = with_slices(_instants(points.join(hot, entity, "leftsemi"), entity), "_us", slice_rows)
        rows = points.join(hot, entity, "leftanti").withColumn("_slice", F.lit(0).cast("bigint"))
        rows = rows.unionByName(in_hot).unionByName(_edges(in_hot, entity), allowMissingColumns=True)

    # One shuffle by (entity, slice), then two orders. Forwards, repeated starts are found (the first by
    # tie-break stays) and the last earlier end and the start count follow; backwards, the next start and end.
    forward = (
        Window.partitionBy(entity, "_slice")
        .orderBy(F.col("_us").asc(), F.col("_is_start").desc(), F.col("_start").asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    backward = (
        Window.partitionBy(entity, "_slice")
        .orderBy(F.col("_us").desc(), F.col("_is_start").asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    marked = rows.select(
        "*", F.max("_end_us").over(forward).alias("_prior_us"), F.max("_start_us").over(forward).alias("_last_start")
    )
    repeated = (F.col("_is_start") == 1) & F.coalesce(F.col("_last_start") == F.col("_us"), F.lit(False))
    counted = marked.withColumn("_n", F.when(repeated, F.lit(0).cast("bigint")).otherwise(F.col("_n")))
    numbered = counted.select(
        "*", (F.coalesce(F.sum("_n").over(forward), F.lit(0)) + 1).alias("episode_number"), repeated.alias("_repeated")
    ).filter(~F.col("_repeated"))
    seen = numbered.select(
        entity,
        "_start",
        "_us",
        "_is_start",
        "_prior_us",
        "episode_number",
        F.min("_start_us").over(backward).alias("_next_us"),
        F.min("_end").over(backward).alias("_next_end"),
    ).filter((F.col("_is_start") == 1) & F.col("_start").isNotNull())

    limit = extract_end if isinstance(extract_end, Column) else F.lit(extract_end).cast("timestamp_ntz")
    limit_us = micros(limit)
    end_us = F.col("_next_end._us")
    paired = end_us.isNotNull() & (F.col("_next_us").isNull() | (end_us < F.col("_next_us"))) & (end_us <= limit_us)
    observed_us = F.least(limit_us, F.coalesce(F.col("_next_us"), limit_us))
    wall = lambda us: F.timestamp_micros(us).cast("timestamp_ntz")

    out = seen.select(
        entity,
        *[F.col(f"_start.{c}").alias(c) for c in start_cols],
        *[F.when(paired, F.col(f"_next_end.row.{c}")).alias(c) for c in end_cols],
        F.coalesce(paired, F.lit(False)).alias("is_matched"),
        wall(F.col("_next_us")).alias("next_start"),
        wall(observed_us).alias("observation_end"),
        F.floor((observed_us - F.col("_us")) / MICROS_PER_DAY).cast("bigint").alias("followup_days_available"),
        "episode_number",
        (F.col("episode_number") > 1).alias("is_reintake"),
        F.floor((F.col("_us") - F.col("_prior_us")) / MICROS_PER_DAY).cast("bigint").alias("days_since_last_stay"),
    )
    matched = out.filter("is_matched").drop("is_matched", "observation_end", "followup_days_available")
    if end_type is not None:
        reason = censoring_reason(F.col(end_type), reasons)
        matched = matched.withColumn("censoring_reason", reason).withColumn(
            "event_type", F.when(F.col("censoring_reason") == "adopted", "adoption").otherwise("censored")
        ).withColumn("censoring_date", F.col(end_ts))
    unresolved = (
        out.filter(~F.col("is_matched"))
        .drop("is_matched", *end_cols)
        .withColumn("unresolved_reason", F.lit(UNRESOLVED_REASON))
    )
    return Episodes(out, matched, unresolved)


def episode_targets(
    matched: DataFrame, *, start_ts: str, end_ts: str, end_type: str, positive: str = "adoption"
) -> DataFrame:
    """Duration and 0/1 targets of paired episodes."""
    days = (micros(F.col(end_ts)) - micros(F.col(start_ts))) / float(MICROS_PER_DAY)
    positive_end = F.lower(F.trim(F.coalesce(F.col(end_type), F.lit("")))) == positive
    return matched.withColumns({"days_to_outcome": days, "adopted": positive_end}).withColumns(
        {
            "is_adopted": F.col("adopted"),
            "target_adopted": F.col("adopted").cast("int"),
            "classification_target": F.col("adopted").cast("int"),
            "regression_target_days": F.col("days_to_outcome"),
            "length_of_stay": F.col("days_to_outcome"),
            "days_to_adoption": F.when(F.col("adopted"), F.col("days_to_outcome")),
        }
    )


def horizon_labels(
    episodes: DataFrame,
    *,
    start_ts: str,
    end_ts: str,
    adopted: str = "adopted",
    days: str = "days_to_outcome",
    next_start: str = "next_start",
    extract_end: datetime | Column,
    horizons: Sequence[int] = (7, 30, 60, 90),
) -> DataFrame:
    """1.0 / 0.0 / null label per horizon for matched and unresolved starts alike."""
    limit = extract_end if isinstance(extract_end, Column) else F.lit(extract_end).cast("timestamp_ntz")
    observed = F.least(limit, F.coalesce(F.col(next_start), limit))
    followup = (micros(observed) - micros(F.col(start_ts))) / float(MICROS_PER_DAY)
    has_end = F.col(end_ts).isNotNull()
    inside = F.col(next_start).isNull() | (F.col(end_ts) < F.col(next_start))
    positive = F.coalesce(F.col(adopted), F.lit(False))

    labels: dict[str, Column] = {}
    for h in horizons:
        ended = has_end & inside & (F.col(days) <= h)
        later = has_end & inside & (F.col(days) > h)
        labels[f"adopted_in_{h}d"] = (
            F.when(ended & positive, F.lit(1.0))
            .when(ended | later | (~has_end & (followup >= h)), F.lit(0.0))
        )
    return episodes.withColumns(
        {"observation_end_actual": observed, "followup_days_available": followup, **labels}
    )


def horizon_violations(horizon_rows: DataFrame, *, start_ts: str, extract_end: datetime | Column) -> DataFrame:
    """One row of counts that must all be zero."""
    limit = extract_end if isinstance(extract_end, Column) else F.lit(extract_end).cast("timestamp_ntz")
    return horizon_rows.agg(
        F.count_if(F.col(start_ts).isNull()).alias("null_starts"),
        F.count_if(F.col(start_ts) > limit).alias("starts_after_extract"),
        F.count_if(F.col("followup_days_available") < 0).alias("negative_followup"),
    )


def conservation_counts(starts: DataFrame, episodes: Episodes, *, entity: str, start_ts: str) -> DataFrame:
    """Matched + unresolved against distinct starts, as one row."""
    distinct = starts.dropna(subset=[entity, start_ts]).select(entity, start_ts).distinct()
    tags = episodes.all_starts.select(
        F.when(F.col("is_matched"), "matched").otherwise("unresolved").alias("tag")
    ).unionByName(distinct.select(F.lit("distinct").alias("tag")))
    return tags.agg(
        F.count_if(F.col("tag") == "matched").alias("matched"),
        F.count_if(F.col("tag") == "unresolved").alias("unresolved"),
        F.count_if(F.col("tag") == "distinct").alias("distinct_starts"),
    ).withColumn("conserved", F.col("matched") + F.col("unresolved") == F.col("distinct_starts"))


def episode_violations(table: DataFrame, *, entity_type: str, allowed: Sequence[str]) -> DataFrame:
    """Row-level data checks as one aggregate; all counts should be zero."""
    target = F.col("classification_target")
    return table.agg(
        F.count_if(~F.coalesce(F.lower(F.col(entity_type)).isin(*allowed), F.lit(False))).alias("unsupported_types"),
        F.count_if(F.col("days_to_outcome") < 0).alias("negative_days"),
        F.count_if(~F.coalesce(target.isin(0, 1), F.lit(False))).alias("bad_targets"),
        F.count_if(~target.eqNullSafe(F.col("adopted").cast("int"))).alias("target_mismatches"),
        F.count(F.lit(1)).alias("rows_checked"),
    )


def raise_on_violations(violations: DataFrame, ignore: Sequence[str] = ("rows_checked",)) -> None:
    """Raise with the non-zero counts of a one-row violation table."""
    row = violations.first()
    bad = {k: v for k, v in row.asDict().items() if k not in ignore and v}
    if bad:
        raise ValueError(f"data checks failed: {bad}")


def pairing_examples(
    episodes: Episodes, ends: DataFrame, *, entity: str, start_ts: str, end_ts: str, per_scenario: int = 3
) -> DataFrame:
    """A few starts for each pairing situation.

    ``skipped_past_end`` has an end before the start, ``repeat`` an earlier start,
    ``multiple_stays`` and ``single_stay`` count an entity's starts, ``unmatched`` has no end.
    """
    totals = episodes.all_starts.groupBy(entity).agg(F.count(F.lit(1)).alias("stays"))
    rows = episodes.all_starts.join(totals, entity)
    tests = {
        "single_stay": (F.col("stays") == 1) & F.col("is_matched"),
        "multiple_stays": (F.col("stays") > 1) & F.col("is_matched"),
        "repeat": F.col("is_reintake") & F.col("is_matched"),
        "skipped_past_end": F.col("days_since_last_stay").isNotNull() & F.col("is_matched"),
        "unmatched": ~F.col("is_matched"),
    }
    scenario = F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])))
    tagged = rows.select(entity, start_ts, end_ts, "episode_number", "days_since_last_stay", scenario.alias("scenario"))
    return first_per_group(tagged, ["scenario"], [F.col(entity), F.col(start_ts)], per_scenario)
