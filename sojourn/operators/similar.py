"""Similar historical cases for many profiles at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.operators.skew import group_quantile, null_safe_join


def _tiers(fields: Sequence[str], tiers: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """One struct per tier; fields a tier does not use are null."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("_tier"),
                *[(F.col(f) if f in used else F.lit(None)).cast("string").alias(f) for f in fields],
            )
            for i, (_, used) in enumerate(tiers)
        ]
    )


def similar_cases(
    history: DataFrame,
    profiles: DataFrame,
    *,
    profile_id: str,
    tiers: Sequence[tuple[str, Sequence[str]]],
    label: str,
    days: str,
    end_type: str,
    end_types: Mapping[str, str],
    whole_days: bool = False,
) -> DataFrame:
    """For every profile, the history rows that agree on the first tier of fields with any match.

    The history is summarised once per distinct case and tier, profiles are then looked up by an
    equi-join in which null agrees with null. No (profile, history row) pairs are made.
    """
    fields = list(dict.fromkeys(f for _, used in tiers for f in used))
    cells = history.groupBy(*fields).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col(label).cast("bigint")).alias("_y"),
        F.count(label).alias("_ny"),
        *[F.count_if(F.col(end_type) == v).alias(f"_{n}") for n, v in end_types.items()],
    )
    sums = ["_n", "_y", "_ny", *[f"_{n}" for n in end_types]]
    keys = ["_tier", *fields]
    cases = (
        cells.select(F.explode(_tiers(fields, tiers)).alias("_t"), *sums)
        .select("_t.*", *sums)
        .groupBy(*keys)
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    timed = history.filter(F.col(days).isNotNull())
    if whole_days:
        timed = timed.groupBy(*fields, F.col(days).alias("_d")).agg(F.count(F.lit(1)).alias("_w"))
        spread = timed.select(F.explode(_tiers(fields, tiers)).alias("_t"), "_d", "_w").select("_t.*", "_d", "_w")
        medians = spread.groupBy(*keys).agg(F.percentile("_d", 0.5, F.col("_w")).alias("_median"))
    else:
        # nearly as many values as rows: counting them first would shuffle the rows
        spread = timed.select(F.explode(_tiers(fields, tiers)).alias("_t"), F.col(days).alias("_d")).select("_t.*", "_d")
        medians = group_quantile(spread, keys, "_d", 0.5, "_median")
    table = null_safe_join(cases, medians, keys, "left")

    asked = profiles.select(profile_id, F.explode(_tiers(fields, tiers)).alias("_t")).select(profile_id, "_t.*")
    found = null_safe_join(asked, table, keys)
    best = found.groupBy(profile_id).agg(
        F.min(F.struct("_tier", F.struct(*sums, "_median").alias("m"))).alias("_best")
    )
    m = lambda c: F.col(f"_best.m.{c}")
    names = F.array(*[F.lit(name) for name, _ in tiers])
    used = F.array(*[F.lit(", ".join(u)) for _, u in tiers])
    return best.select(
        profile_id,
        m("_n").alias("similar_records"),
        names[F.col("_best._tier")].alias("matching_level"),
        used[F.col("_best._tier")].alias("matched_fields"),
        *[(m(f"_{n}") * 100.0 / m("_n")).alias(f"{n}_rate_pct") for n in end_types],
        F.coalesce(m("_y") * 100.0 / F.nullif(m("_ny"), F.lit(0)), F.lit(0.0)).alias("historical_adoption_rate_pct"),
        F.coalesce(m("_median"), F.lit(0.0)).alias("median_days_to_outcome"),
    )
