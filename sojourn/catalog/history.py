"""Prior-window counts, daily series and context joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.catalog import Registry
from sojourn.operators import context as cx
from sojourn.operators.rolling import prior_counts, rolling_daily
from sojourn.sources.tables import read_table

registry = Registry()


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events")


def _hourly(spark: SparkSession, folder: str) -> DataFrame:
    ts = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return _events(spark, folder).select("event_id", "user_id", ts.alias("start_ts"))


def _prior_sql(source: str, extra: str) -> str:
    return f"""
with r as ({source}), u as (select distinct user_id, start_ts from r),
t as (select start_ts, count(*) as n from u group by 1),
v as (select a.start_ts,
             coalesce(sum(b.n) filter (where b.start_ts >= a.start_ts - interval 1 day), 0)::BIGINT as intake_volume_1d,
             coalesce(sum(b.n), 0)::BIGINT as intake_volume_7d
      from t a left join t b on b.start_ts < a.start_ts and b.start_ts >= a.start_ts - interval 7 day group by 1)
select r.user_id, r.start_ts, {extra} v.intake_volume_1d, v.intake_volume_7d from r join v on v.start_ts = r.start_ts"""


@registry.query(_prior_sql("select event_id, user_id, date_trunc('hour', ts)::TIMESTAMP as start_ts from events", "r.event_id,"))
def prior_volume_tied_times(spark: SparkSession, folder: str) -> DataFrame:
    """Many simultaneous and repeated starts: ties are excluded, repeats count once."""
    return prior_counts(_hourly(spark, folder), entity="user_id", ts="start_ts", windows=(1, 7))


@registry.query(_prior_sql("select user_id, ts as start_ts from events where event_type in ('signup', 'purchase')", ""))
def prior_volume(spark: SparkSession, folder: str) -> DataFrame:
    starts = _events(spark, folder).filter(F.col("event_type").isin("signup", "purchase"))
    return prior_counts(starts.select("user_id", F.col("ts").alias("start_ts")), entity="user_id", ts="start_ts", windows=(1, 7))


_ERRORS_SQL = "select ts::DATE as d, count(*) as v from events where event_type = 'error' group by 1"


def _errors(spark: SparkSession, folder: str) -> DataFrame:
    return cx.requests_daily(
        _events(spark, folder).select(F.col("ts").alias("created_date"), F.col("event_type").alias("sr_description")),
        keyword="error",
        output="requests",
    )


@registry.query("select d as context_date, v::BIGINT as requests from (" + _ERRORS_SQL + ")")
def requests_per_day(spark: SparkSession, folder: str) -> DataFrame:
    return _errors(spark, folder)


@registry.query("select ts::DATE as context_date, round(sum(value), 4) as requests from events group by 1")
def requests_sum_per_day(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).select(F.col("ts").alias("request_date"), F.col("value").alias("count"))
    return cx.requests_daily(rows, output="requests").withColumn("requests", F.round("requests", 4))


@registry.query(
    f"""with d as ({_ERRORS_SQL}),
g as (select unnest(generate_series((select min(ts::DATE) from events), (select max(ts::DATE) from events), interval 1 day))::DATE as context_date)
select context_date,
       coalesce((select sum(v) from d where d.d < context_date and d.d >= context_date - 7), 0)::DOUBLE as requests_7d,
       coalesce((select sum(v) from d where d.d < context_date and d.d >= context_date - 30), 0)::DOUBLE as requests_30d
from g"""
)
def rolling_daily_requests(spark: SparkSession, folder: str) -> DataFrame:
    dates = _events(spark, folder).select(F.col("ts").cast("date").alias("d"))
    return rolling_daily(_errors(spark, folder), date="context_date", value="requests", windows=(7, 30), dates=dates)


@registry.query(
    """select ts::DATE as request_date, count(*)::BIGINT as requests from events
where event_type = 'click' and ts >= '2024-01-05' and ts < '2024-01-21' group by 1 order by 1 limit 12"""
)
def source_daily_count(spark: SparkSession, folder: str) -> DataFrame:
    return cx.daily_count(
        _events(spark, folder), ts="ts", first="2024-01-05", last="2024-01-20",
        where=F.col("event_type") == "click", output="requests", limit=12,
    )


_DAILY_SQL = """
select ts::DATE as context_date, value as daily_temp_max, value / 2 as daily_temp_min,
       case when event_id % 2 = 0 then value - 20 end as daily_precipitation
from events where event_type = 'view' qualify row_number() over (partition by ts::DATE order by event_id desc) = 1"""


def _weather(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).filter(F.col("event_type") == "view").select(
        F.col("ts").alias("DATE"),
        F.col("value").alias("TMAX"),
        (F.col("value") / 2).alias("TMIN"),
        F.when(F.col("event_id") % 2 == 0, F.col("value") - 20).alias("PRCP"),
        "event_id",
    )
    return cx.weather_daily(rows, latest_by=["event_id"])


@registry.query(_DAILY_SQL)
def weather_last_of_day(spark: SparkSession, folder: str) -> DataFrame:
    return _weather(spark, folder)


@registry.query(
    f"""with w as ({_DAILY_SQL})
select e.event_id, w.daily_temp_max, w.daily_temp_min, w.daily_precipitation,
       w.daily_temp_max is not null or w.daily_temp_min is not null or w.daily_precipitation is not null as weather_available,
       w.daily_temp_max >= 95 as is_extreme_heat, w.daily_precipitation > 0 as is_rainy_day
from events e left join w on w.context_date = e.ts::DATE - 1 where e.event_type = 'signup'"""
)
def lagged_context(spark: SparkSession, folder: str) -> DataFrame:
    starts = _events(spark, folder).filter(F.col("event_type") == "signup").select("event_id", "ts")
    return cx.weather_flags(cx.join_previous_day(starts, _weather(spark, folder), ts="ts")).drop("ts")


@registry.query(
    f"""with w as ({_DAILY_SQL}), d as ({_ERRORS_SQL}), s as (select event_id, user_id, ts from events where event_type = 'signup'),
v as (select a.event_id, count(b.event_id) as n from s a left join s b on b.ts < a.ts and b.ts >= a.ts - interval 7 day group by 1),
q as (select x.day, coalesce(sum(d.v), 0) as r from (select distinct ts::DATE as day from s) x
      left join d on d.d < x.day and d.d >= x.day - 7 group by 1)
select s.user_id, s.ts as start_ts, w.daily_temp_max, w.daily_temp_max >= 95 as is_extreme_heat,
       q.r::DOUBLE as animal_311_requests_7d, v.n::DOUBLE as intake_volume_7d
from s left join w on w.context_date = s.ts::DATE - 1 join q on q.day = s.ts::DATE join v using (event_id)"""
)
def context_features(spark: SparkSession, folder: str) -> DataFrame:
    starts = _events(spark, folder).filter(F.col("event_type") == "signup").select("user_id", F.col("ts").alias("start_ts"))
    requests = _errors(spark, folder).withColumnRenamed("requests", "animal_311_requests")
    out = cx.add_context(
        starts, starts=starts, weather=_weather(spark, folder), requests=requests, entity="user_id", ts="start_ts", windows=(7,)
    )
    return out.select("user_id", "start_ts", "daily_temp_max", "is_extreme_heat", "animal_311_requests_7d", "intake_volume_7d")


@registry.query(
    """select count(*)::BIGINT as missing_rows from events s where event_type = 'signup' and not exists (
  select 1 from events b where b.event_type = 'signup' and b.user_id % 5 <> 0 and b.user_id = s.user_id and b.ts = s.ts)"""
)
def context_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Starts whose entity the history lacks, here every fifth one."""
    starts = _events(spark, folder).filter(F.col("event_type") == "signup").select("user_id", F.col("ts").alias("start_ts"))
    requests = _errors(spark, folder).withColumnRenamed("requests", "animal_311_requests")
    out = cx.add_context(
        starts, starts=starts.filter(F.col("user_id") % 5 != 0), weather=_weather(spark, folder), requests=requests,
        entity="user_id", ts="start_ts", windows=(7,),
    )
    return cx.missing_history(out, ["intake_volume_7d"])
