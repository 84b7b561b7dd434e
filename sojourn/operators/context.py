"""Daily context series and their joins to episodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.operators.rolling import prior_counts, rolling_daily
from sojourn.sources.contracts import first_existing

# Accepted column names and limits.
WEATHER_COLUMNS: Mapping[str, Sequence[str]] = {
    "daily_temp_max": ("tmax", "daily_temp_max"),
    "daily_temp_min": ("tmin", "daily_temp_min"),
    "daily_precipitation": ("prcp", "daily_precipitation"),
}
WEATHER_DATES = ("date", "context_date")
REQUEST_DATES = ("request_date", "created_date", "context_date")
REQUEST_COUNTS = ("animal_311_requests", "count")
REQUEST_TEXTS = ("sr_description", "service_request_type", "issue_description")
HEAT_LIMIT = 95.0


def daily_last(rows: DataFrame, *, date: str, values: Sequence[str], latest_by: Sequence[str]) -> DataFrame:
    """One row per day; of several rows the one with the greatest ``latest_by`` wins."""
    picked = (
        rows.withColumn("context_date", F.col(date).cast("date"))
        .filter(F.col("context_date").isNotNull())
        .groupBy("context_date")
        .agg(F.max_by(F.struct(*values), F.struct(*latest_by)).alias("_row"))
    )
    return picked.select("context_date", *[F.col(f"_row.{v}").alias(v) for v in values])


def weather_daily(rows: DataFrame, latest_by: Sequence[str] = ()) -> DataFrame:
    """Daily weather under its standard names, one row per day."""
    date = first_existing(rows, WEATHER_DATES)
    if date is None:
        raise ValueError("weather context missing date column")
    found = {name: first_existing(rows, options) for name, options in WEATHER_COLUMNS.items()}
    named = rows.withColumns(
        {name: (F.col(c).try_cast("double") if c else F.lit(None).cast("double")) for name, c in found.items()}
    )
    return daily_last(named, date=date, values=list(WEATHER_COLUMNS), latest_by=latest_by or list(WEATHER_COLUMNS))


def requests_daily(rows: DataFrame, keyword: str = "animal", output: str = "animal_311_requests") -> DataFrame:
    """Requests per day: the sum of a count column, or the number of rows about the keyword."""
    date = first_existing(rows, REQUEST_DATES)
    if date is None:
        raise ValueError("request context missing date column")
    count = first_existing(rows, REQUEST_COUNTS)
    if count is None:
        text = first_existing(rows, REQUEST_TEXTS)
        if text is not None:
            rows = rows.filter(F.contains(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(keyword)))
        amount: Column = F.count(F.lit(1))
    else:
        amount = F.sum(F.coalesce(F.col(count).try_cast("double"), F.lit(0.0)))
    return (
        rows.withColumn("context_date", F.col(date).cast("date"))
        .filter(F.col("context_date").isNotNull())
        .groupBy("context_date")
        .agg(amount.alias(output))
    )


def daily_count(
    rows: DataFrame, *, ts: str, first: str, last: str, where: Column, output: str, limit: int | None = None
) -> DataFrame:
    """Rows per day within two dates; the filters reach the scan."""
    day = F.col(ts).cast("date")
    low = F.lit(first).cast("timestamp_ntz")
    high = F.lit(last).cast("timestamp_ntz") + F.expr("interval 1 day")
    counted = (
        rows.filter(where & (F.col(ts) >= low) & (F.col(ts) < high))
        .groupBy(day.alias("request_date"))
        .agg(F.count(F.lit(1)).alias(output))
        .orderBy("request_date")
    )
    return counted if limit is None else counted.limit(limit)


def join_previous_day(rows: DataFrame, daily: DataFrame, *, ts: str, lag_days: int = 1) -> DataFrame:
    """Left join of a daily table on the date before the row's own.

    ``daily`` has one row per calendar day by construction, so it is small enough to send around.
    """
    shifted = daily.withColumn("_on", F.date_add("context_date", lag_days)).drop("context_date")
    return (
        rows.withColumn("_on", F.col(ts).cast("date")).join(F.broadcast(shifted), "_on", "left").drop("_on")
    )


def weather_flags(rows: DataFrame) -> DataFrame:
    """Availability and threshold flags; a flag is null where its field is."""
    return rows.withColumns(
        {
            "weather_available": F.coalesce(*[F.col(c) for c in WEATHER_COLUMNS]).isNotNull(),
            "is_extreme_heat": F.col("daily_temp_max") >= HEAT_LIMIT,
            "is_rainy_day": F.col("daily_precipitation") > 0,
        }
    )


def add_context(
    episodes: DataFrame,
    *,
    starts: DataFrame,
    weather: DataFrame,
    requests: DataFrame,
    entity: str,
    ts: str,
    windows: Sequence[int] = (7, 30),
    request_name: str = "animal_311_requests",
    volume_name: str = "intake_volume",
) -> DataFrame:
    """Weather of the day before, request sums and start counts of the days before."""
    with_weather = weather_flags(join_previous_day(episodes, weather, ts=ts))
    day = F.col(ts).cast("date")
    sums = rolling_daily(
        requests, date="context_date", value=request_name, windows=windows, dates=episodes.select(day.alias("d"))
    )
    request_cols = [f"{request_name}_{w}d" for w in windows]
    # one row per calendar day
    with_requests = (
        with_weather.withColumn("context_date", day)
        .join(F.broadcast(sums), "context_date", "left")
        .drop("context_date")
        .fillna(0.0, subset=request_cols)
    )
    volume_cols = [f"{volume_name}_{w}d" for w in windows]
    volumes = (
        prior_counts(starts, entity=entity, ts=ts, windows=windows, prefix=volume_name)
        .groupBy(entity, ts)
        .agg(*[F.max(c).cast("double").alias(c) for c in volume_cols])
    )
    return with_requests.join(volumes, [entity, ts], "left")


def missing_history(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of rows without a joined history value."""
    gone = F.lit(False)
    for c in columns:
        gone = gone | F.col(c).isNull()
    return rows.agg(F.count_if(gone).alias("missing_rows"))


def require_history(rows: DataFrame, columns: Sequence[str]) -> None:
    missing = missing_history(rows, columns).first()["missing_rows"]
    if missing:
        raise ValueError(f"{missing} rows are missing from the start history")
