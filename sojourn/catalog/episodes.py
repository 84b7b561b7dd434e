"""Pairing, censoring, re-entry and horizon queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.catalog import Registry
from sojourn.operators import episodes as ep
from sojourn.operators.cohorts import summarize
from sojourn.plans.dataset import build_dataset, example_records
from sojourn.sources.tables import read_table

registry = Registry()

# Ends are mapped to the words of the censoring map so that every branch is used.
END_WORDS = {"purchase": "Adoption", "error": "Transfer", "click": "Return to Owner"}
HORIZONS = (1, 3, 7, 14)


def event_starts(spark: SparkSession, folder: str, hourly: bool = False) -> DataFrame:
    events = read_table(spark, folder, "events").filter(F.col("event_type") == "signup")
    ts = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz") if hourly else F.col("ts")
    return events.select("user_id", ts.alias("start_ts"), F.col("event_id").alias("start_id"), F.col("value").alias("start_value"))


def event_ends(spark: SparkSession, folder: str, hourly: bool = False) -> DataFrame:
    words = F.create_map(*[F.lit(x) for pair in END_WORDS.items() for x in pair])
    events = read_table(spark, folder, "events").filter(F.col("event_type").isin(*END_WORDS))
    ts = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz") if hourly else F.col("ts")
    return events.select(
        "user_id",
        F.col("event_id").alias("end_id"),
        ts.alias("end_ts"),
        words[F.col("event_type")].alias("end_type"),
        F.col("value").alias("end_value"),
    )


def last_event(spark: SparkSession, folder: str) -> datetime:
    return read_table(spark, folder, "events").agg(F.max("ts")).first()[0]


def paired(spark: SparkSession, folder: str, hourly: bool = False, **options) -> ep.Episodes:
    return ep.pair_episodes(
        event_starts(spark, folder, hourly),
        event_ends(spark, folder, hourly),
        entity="user_id",
        start_ts="start_ts",
        end_ts="end_ts",
        end_type="end_type",
        extract_end=last_event(spark, folder),
        **options,
    )


def with_targets(episodes: ep.Episodes) -> DataFrame:
    return ep.episode_targets(
        episodes.all_starts, start_ts="start_ts", end_ts="end_ts", end_type="end_type"
    )


def episode_sql(hourly: bool = False) -> str:
    ts = "date_trunc('hour', ts)::TIMESTAMP" if hourly else "ts"
    return f"""
s as (
  select user_id, start_ts, min(start_id) as start_id, arg_min(start_value, start_id) as start_value
  from (select user_id, {ts} as start_ts, event_id as start_id, value as start_value
        from events where event_type = 'signup') group by 1, 2),
e as (
  select user_id, end_ts, min(end_id) as end_id, arg_min(end_type, end_id) as end_type, arg_min(end_value, end_id) as end_value
  from (select user_id, {ts} as end_ts, event_id as end_id, value as end_value,
          case event_type when 'purchase' then 'Adoption' when 'error' then 'Transfer' else 'Return to Owner' end as end_type
        from events where event_type in ('purchase', 'error', 'click')) group by 1, 2),
x as (select max(ts) as extract_end from events),
n as (
  select *, lead(start_ts) over (partition by user_id order by start_ts) as next_start,
         row_number() over (partition by user_id order by start_ts) as episode_number from s),
c as (
  select n.user_id, n.start_ts,
         min(case when e.end_ts >= n.start_ts and (n.next_start is null or e.end_ts < n.next_start)
                   and e.end_ts <= x.extract_end then e.end_ts end) as end_ts,
         max(case when e.end_ts < n.start_ts then e.end_ts end) as prior_end
  from n cross join x left join e on e.user_id = n.user_id group by 1, 2),
ep as (
  select n.*, c.end_ts, e.end_id, e.end_type, e.end_value, x.extract_end,
         least(x.extract_end, coalesce(n.next_start, x.extract_end)) as observation_end,
         floor(date_diff('microsecond', c.prior_end, n.start_ts) / 86400000000.0)::BIGINT as days_since_last_stay,
         date_diff('microsecond', n.start_ts, c.end_ts) / 86400000000.0::DOUBLE as days
  from n join c on c.user_id = n.user_id and c.start_ts = n.start_ts cross join x
  left join e on e.user_id = n.user_id and e.end_ts = c.end_ts)
"""


_MATCH_COLUMNS = """
select user_id, start_ts, start_id, start_value, end_ts, end_id, end_type, end_value, next_start,
       episode_number, episode_number > 1 as is_reintake, days_since_last_stay,
       case when end_type = 'Adoption' then 'adopted' when end_type = 'Transfer' then 'censored_transfer'
            else 'censored_unknown' end as censoring_reason,
       case when end_type = 'Adoption' then 'adoption' else 'censored' end as event_type,
       end_ts as censoring_date
from ep where end_ts is not null
"""


@registry.query(f"with {episode_sql()} {_MATCH_COLUMNS}")
def episode_match(spark: SparkSession, folder: str) -> DataFrame:
    return paired(spark, folder).matched


@registry.query(f"with {episode_sql(True)} {_MATCH_COLUMNS}")
def episode_match_tied_times(spark: SparkSession, folder: str) -> DataFrame:
    """Times cut to the hour give duplicate starts and ends at the instant of a start."""
    return paired(spark, folder, hourly=True).matched


@registry.query(f"with {episode_sql()} {_MATCH_COLUMNS}")
def episode_match_hot_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The path for entities too big for one task, forced by a low threshold."""
    return paired(spark, folder, slice_rows=500, hot_rows=40).matched


@registry.query(
    f"""with {episode_sql()}
select user_id, start_ts, start_id, start_value, next_start, observation_end,
       floor(date_diff('microsecond', start_ts, observation_end) / 86400000000.0)::BIGINT as followup_days_available,
       episode_number, episode_number > 1 as is_reintake, days_since_last_stay,
       'no_unused_future_outcome' as unresolved_reason
from ep where end_ts is null"""
)
def episode_unresolved(spark: SparkSession, folder: str) -> DataFrame:
    return paired(spark, folder).unresolved


@registry.query(
    f"""with {episode_sql()}
select user_id, start_ts, end_ts, round(days, 6) as days_to_outcome, round(days, 6) as length_of_stay,
       round(days, 6) as regression_target_days, end_type = 'Adoption' as adopted, end_type = 'Adoption' as is_adopted,
       (end_type = 'Adoption')::INTEGER as target_adopted, (end_type = 'Adoption')::INTEGER as classification_target,
       case when end_type = 'Adoption' then round(days, 6) end as days_to_adoption
from ep where end_ts is not null"""
)
def episode_target_columns(spark: SparkSession, folder: str) -> DataFrame:
    rows = ep.episode_targets(paired(spark, folder).matched, start_ts="start_ts", end_ts="end_ts", end_type="end_type")
    doubles = ("days_to_outcome", "length_of_stay", "regression_target_days", "days_to_adoption")
    return rows.select(
        "user_id", "start_ts", "end_ts", "adopted", "is_adopted", "target_adopted", "classification_target",
        *[F.round(c, 6).alias(c) for c in doubles],
    )


_HORIZON_SQL = ",\n".join(
    f"""case when end_ts is not null and end_type = 'Adoption' and days <= {h} then 1.0::DOUBLE
     when end_ts is not null then 0.0::DOUBLE
     when date_diff('microsecond', start_ts, observation_end) / 86400000000.0 >= {h} then 0.0::DOUBLE end as adopted_in_{h}d"""
    for h in HORIZONS
)


def horizon_rows(spark: SparkSession, folder: str) -> DataFrame:
    return ep.horizon_labels(
        with_targets(paired(spark, folder)),
        start_ts="start_ts",
        end_ts="end_ts",
        extract_end=last_event(spark, folder),
        horizons=HORIZONS,
    )


@registry.query(
    f"""with {episode_sql()}
select user_id, start_ts, observation_end as observation_end_actual,
       round(date_diff('microsecond', start_ts, observation_end) / 86400000000.0::DOUBLE, 6) as followup_days_available,
       {_HORIZON_SQL}
from ep"""
)
def episode_horizons(spark: SparkSession, folder: str) -> DataFrame:
    return horizon_rows(spark, folder).select(
        "user_id",
        "start_ts",
        "observation_end_actual",
        F.round("followup_days_available", 6).alias("followup_days_available"),
        *[f"adopted_in_{h}d" for h in HORIZONS],
    )


@registry.query(
    f"""with {episode_sql()}
select (select count(*) from ep where end_ts is not null)::BIGINT as matched,
       (select count(*) from ep where end_ts is null)::BIGINT as unresolved,
       (select count(*) from (select distinct user_id, ts from events where event_type = 'signup'))::BIGINT as distinct_starts,
       (select count(*) from ep) = (select count(*) from (select distinct user_id, ts from events where event_type = 'signup')) as conserved"""
)
def episode_conservation(spark: SparkSession, folder: str) -> DataFrame:
    return ep.conservation_counts(
        event_starts(spark, folder), paired(spark, folder), entity="user_id", start_ts="start_ts"
    )


@registry.query(
    f"""with {episode_sql()}
select count(*) filter (where lower(end_type) not in ('adoption', 'transfer', 'return to owner'))::BIGINT as unsupported_types,
       count(*) filter (where days < 0)::BIGINT as negative_days,
       0::BIGINT as bad_targets, 0::BIGINT as target_mismatches, count(*)::BIGINT as rows_checked
from ep where end_ts is not null"""
)
def episode_checks(spark: SparkSession, folder: str) -> DataFrame:
    rows = ep.episode_targets(paired(spark, folder).matched, start_ts="start_ts", end_ts="end_ts", end_type="end_type")
    return ep.episode_violations(rows, entity_type="end_type", allowed=("adoption", "transfer", "return to owner"))


@registry.query(
    f"""with {episode_sql()}
select count(*) filter (where start_ts is null)::BIGINT as null_starts,
       count(*) filter (where start_ts > extract_end)::BIGINT as starts_after_extract,
       count(*) filter (where observation_end < start_ts)::BIGINT as negative_followup from ep"""
)
def horizon_checks(spark: SparkSession, folder: str) -> DataFrame:
    return ep.horizon_violations(
        horizon_rows(spark, folder), start_ts="start_ts", extract_end=last_event(spark, folder)
    )


@registry.query(
    f"""with {episode_sql()},
t as (select *, count(*) over (partition by user_id) as stays from ep),
g as (
  select 'single_stay' as scenario, * from t where stays = 1 and end_ts is not null
  union all select 'multiple_stays', * from t where stays > 1 and end_ts is not null
  union all select 'repeat', * from t where episode_number > 1 and end_ts is not null
  union all select 'skipped_past_end', * from t where days_since_last_stay is not null and end_ts is not null
  union all select 'unmatched', * from t where end_ts is null)
select user_id, start_ts, end_ts, episode_number, days_since_last_stay, scenario
from g qualify row_number() over (partition by scenario order by user_id, start_ts) <= 3"""
)
def pairing_examples(spark: SparkSession, folder: str) -> DataFrame:
    return ep.pairing_examples(
        paired(spark, folder), event_ends(spark, folder), entity="user_id", start_ts="start_ts", end_ts="end_ts"
    )


@registry.query(
    """
with s as (select o_custkey as custkey, o_orderdate as start_ts, min(o_orderkey) as orderkey from orders group by 1, 2),
e as (select distinct o_custkey as custkey, l_shipdate as end_ts from lineitem join orders on l_orderkey = o_orderkey),
n as (select *, lead(start_ts) over (partition by custkey order by start_ts) as next_start,
             row_number() over (partition by custkey order by start_ts) as episode_number from s),
c as (select n.custkey, n.start_ts,
             min(case when e.end_ts >= n.start_ts and (n.next_start is null or e.end_ts < n.next_start) then e.end_ts end) as end_ts,
             max(case when e.end_ts < n.start_ts then e.end_ts end) as prior_end
      from n left join e on e.custkey = n.custkey group by 1, 2)
select n.custkey, n.start_ts, n.orderkey, n.next_start, n.episode_number, n.episode_number > 1 as is_reintake,
       c.end_ts is not null as is_matched, c.end_ts,
       date_diff('day', c.prior_end, n.start_ts)::BIGINT as days_since_last_stay
from n join c on c.custkey = n.custkey and c.start_ts = n.start_ts"""
)
def orders_reentry(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    starts = orders.select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("start_ts"), F.col("o_orderkey").alias("orderkey")
    )
    ends = read_table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("custkey"), F.col("l_shipdate").alias("end_ts")
    )
    result = ep.pair_episodes(
        starts, ends, entity="custkey", start_ts="start_ts", end_ts="end_ts",
        extract_end=datetime(2100, 1, 1), slice_rows=500,
    )
    return result.all_starts.drop("observation_end", "followup_days_available")


@registry.query(
    f"""with {episode_sql()},
d as (select end_type, (end_type = 'Adoption')::INTEGER as y, days, case when episode_number > 1 then 'true' else 'false' end as re,
             year(start_ts)::VARCHAR as yr from ep where end_ts is not null)
select 'is_reintake' as variable, re as value, count(*)::BIGINT as records, sum(y)::BIGINT as adoptions,
       round(sum(y) * 100.0::DOUBLE / count(*), 6) as adoption_rate_pct, round(quantile_cont(days, 0.5), 6) as median_days_to_outcome,
       'classification_target/regression_target_days' as target_column, 'all matched episodes' as population_scope,
       'adoption_rate_and_median_los' as estimand_label
from d group by re
union all
select 'start_year', yr, count(*)::BIGINT, sum(y)::BIGINT, round(sum(y) * 100.0::DOUBLE / count(*), 6), round(quantile_cont(days, 0.5), 6),
       'classification_target/regression_target_days', 'all matched episodes', 'adoption_rate_and_median_los'
from d group by yr"""
)
def episode_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    """The first full path: pair, derive targets, summarise by two dimensions."""
    rows = ep.episode_targets(
        paired(spark, folder).matched, start_ts="start_ts", end_ts="end_ts", end_type="end_type"
    ).withColumn("start_year", F.year("start_ts"))
    out = summarize(rows, ["is_reintake", "start_year"], label="classification_target", days="days_to_outcome")
    return out.withColumns(
        {c: F.round(c, 6) for c in ("adoption_rate_pct", "median_days_to_outcome")}
    )


@registry.query(
    """
with i as (
  select event_id, user_id::VARCHAR as animal_id, ts,
         case event_id % 5 when 0 then 'Dog' when 1 then 'Cat' when 2 then ' dog ' when 3 then 'Bird' else 'Cat' end as animal_type,
         (1 + event_id % 15)::VARCHAR || case event_id % 2 when 0 then ' years' else ' months' end as age,
         case event_id % 4 when 0 then 'Black/White' when 1 then 'Brown Tabby' when 2 then 'Calico' else 'Blue Merle' end as color,
         case event_id % 3 when 0 then 'Pit Bull Mix' when 1 then 'Domestic Shorthair' else 'Beagle Hound/Boxer' end as breed,
         case event_id % 4 when 0 then '12 Main St in Austin (TX)' when 1 then 'Travis (TX)' when 2 then 'Outside Jurisdiction' else 'Elm and Oak' end as loc
  from events where event_type = 'signup'),
s as (select * from i where lower(trim(animal_type)) in ('dog', 'cat')),
e as (select user_id::VARCHAR as animal_id, ts as end_ts, event_id as end_id,
             case event_type when 'purchase' then 'Adoption' else 'Transfer' end as end_type
      from events where event_type in ('purchase', 'error')),
x as (select max(ts) as extract_end from events),
n as (select *, lead(ts) over (partition by animal_id order by ts) as next_start from s),
c as (select n.event_id, min(case when e.end_ts >= n.ts and (n.next_start is null or e.end_ts < n.next_start) then e.end_ts end) as end_ts
      from n left join e on e.animal_id = n.animal_id group by 1),
m as (select n.*, c.end_ts, e.end_type, date_diff('microsecond', n.ts, c.end_ts) / 86400000000.0::DOUBLE as days,
             (1 + event_id % 15) * case event_id % 2 when 0 then 365.25::DOUBLE else 30.4375::DOUBLE end as age_days
      from n join c using (event_id) join e on e.animal_id = n.animal_id and e.end_ts = c.end_ts)
select animal_id, animal_type, ts as intake_datetime, end_ts as outcome_datetime, end_type as outcome_type,
       case event_id % 4 when 2 then 'outside_jurisdiction' when 0 then 'address_like' when 3 then 'intersection' else 'county_or_region' end as found_location_kind,
       case event_id % 4 when 0 then 'austin' when 1 then 'travis' else 'unknown' end as found_location_area,
       case when age_days < 365.25 then 'baby' when age_days < 3 * 365.25 then 'young' when age_days < 8 * 365.25 then 'adult' else 'senior' end as age_group,
       case event_id % 4 when 0 then 'black_or_dark' when 1 then 'brown_tan' when 2 then 'mixed_other' else 'gray_blue' end as color_group,
       case event_id % 3 when 0 then 'pit_bull_type' when 1 then 'domestic_cat' else 'hound_type' end as simplified_breed_group,
       year(ts)::INTEGER as intake_year, round(days, 6) as days_to_outcome,
       (end_type = 'Adoption')::INTEGER as classification_target, round(age_days / 30.0, 6) as age_months,
       case when end_type = 'Adoption' then round(days, 6) end as days_to_adoption
from m"""
)
def modeling_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Raw text records to the fixed episode table: clean, pair, derive, check the schema."""
    intakes, outcomes = example_records(read_table(spark, folder, "events"))
    built = build_dataset(intakes, outcomes, extract_end=last_event(spark, folder))
    return built.dataset.select(
        "animal_id", "animal_type", "intake_datetime", "outcome_datetime", "outcome_type", "found_location_kind",
        "found_location_area", "age_group", "color_group", "simplified_breed_group", "intake_year",
        F.round("days_to_outcome", 6).alias("days_to_outcome"), "classification_target",
        F.round("age_months", 6).alias("age_months"), F.round("days_to_adoption", 6).alias("days_to_adoption"),
    )
