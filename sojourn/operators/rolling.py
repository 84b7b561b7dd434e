"""Counts over prior windows of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.operators.skew import MICROS_PER_DAY, micros, running_totals


def prior_counts(
    starts: DataFrame,
    *,
    entity: str,
    ts: str,
    windows: Sequence[int] = (7, 30),
    prefix: str = "intake_volume",
    slice_rows: int | None = None,
) -> DataFrame:
    """Starts of all entities in ``[t - w days, t)`` for every (entity, t), w in ``windows``.

    The count is C(t) - C(t - w) with C the number of distinct (entity, start) before a time.
    Every time asks for its own C and one per window; questions and starts are put in one
    stream of points, which is summed slice by slice, so there is no global sort.
    """
    known = starts.filter(F.col(ts).isNotNull())
    per_time = (
        known.select(entity, ts)
        .distinct()
        .groupBy(micros(F.col(ts)).alias("_t"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    questions = F.array(
        *[
            F.struct(
                (F.col("_t") - F.lit(w * MICROS_PER_DAY)).alias("us"),
                F.lit(w).alias("w"),
                (F.col("_n") if w == 0 else F.lit(0).cast("bigint")).alias("n"),
            )
            for w in (0, *windows)
        ]
    )
    points = per_time.select("_t", F.explode(questions).alias("_q")).select("_t", "_q.us", "_q.w", "_q.n")
    counted = running_totals(points, [], "us", {"c": "n"}, slice_rows=slice_rows, with_ties=True)
    per_question = counted.groupBy("_t").agg(
        *[F.max(F.when(F.col("w") == w, F.col("c_before"))).alias(f"_c{w}") for w in (0, *windows)]
    )
    volumes = per_question.select(
        "_t", *[(F.col("_c0") - F.col(f"_c{w}")).cast("bigint").alias(f"{prefix}_{w}d") for w in windows]
    )
    joined = starts.withColumn("_t", micros(F.col(ts))).join(volumes, "_t", "left").drop("_t")
    return joined.fillna(0, subset=[f"{prefix}_{w}d" for w in windows])


def rolling_daily(
    daily: DataFrame,
    *,
    date: str,
    value: str,
    windows: Sequence[int] = (7, 30),
    dates: DataFrame | None = None,
) -> DataFrame:
    """Sum of the previous ``w`` days, the day itself excluded, for every day of the series
    and of ``dates``; days without data count as zero.

    The window runs over one row per calendar day, whatever the size of the event table.
    """
    rows = daily.select(F.col(date).cast("date").alias("context_date"), F.col(value).cast("double").alias("_v"))
    if dates is not None:
        rows = rows.unionByName(
            dates.select(F.col(dates.columns[0]).cast("date").alias("context_date")).distinct().withColumn("_v", F.lit(0.0))
        )
    by_day = (
        rows.filter(F.col("context_date").isNotNull())
        .groupBy("context_date")
        .agg(F.sum("_v").alias("_v"))
        .withColumn("_day", F.datediff("context_date", F.lit("1970-01-01").cast("date")).cast("bigint"))
    )
    order = Window.partitionBy(F.lit(0)).orderBy("_day")
    return by_day.select(
        "context_date",
        *[
            F.coalesce(F.sum("_v").over(order.rangeBetween(-w, -1)), F.lit(0.0)).alias(f"{value}_{w}d")
            for w in windows
        ],
    )
