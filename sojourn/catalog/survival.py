"""Survival queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.catalog import Registry
from sojourn.catalog.episodes import episode_sql, last_event, paired
from sojourn.catalog.tables import SCORED_SQL, rounded, scored, stays
from sojourn.operators import survival as sv
from sojourn.operators.skew import MICROS_PER_DAY, micros

registry = Registry()


def _followed(spark: SparkSession, folder: str) -> DataFrame:
    """Time to a purchase; other ends and the end of observation censor."""
    end = F.coalesce("end_ts", "observation_end")
    return paired(spark, folder).all_starts.select(
        "user_id",
        ((micros(end) - micros(F.col("start_ts"))) / float(MICROS_PER_DAY)).alias("time"),
        F.coalesce(F.col("end_type") == "Adoption", F.lit(False)).cast("int").alias("event"),
        F.when(F.col("episode_number") > 1, "repeat").otherwise("first").alias("kind"),
    )


def _km_sql(source: str, key: str) -> str:
    return f"""
kh as (select {key} as k, time, sum(event) as d, count(*) as n from {source} group by 1, 2),
kr as (select *, sum(n) over (partition by k order by time desc) as at_risk, sum(n) over (partition by k) as total from kh),
ks as (select *, product(1 - d::DOUBLE / at_risk) over (partition by k order by time) as surv from kr)"""


_FOLLOWED_SQL = f"""{episode_sql()},
fol as (select date_diff('microsecond', start_ts, coalesce(end_ts, observation_end)) / 86400000000.0::DOUBLE as time,
               coalesce((end_type = 'Adoption')::INTEGER, 0) as event, case when episode_number > 1 then 'repeat' else 'first' end as kind from ep)"""


@registry.query(
    f"""with {_FOLLOWED_SQL}, {_km_sql('fol', 'kind')}
select k as kind, round(time, 6) as time, at_risk::BIGINT as at_risk, d::BIGINT as events, total::BIGINT as records, round(surv, 6) as survival_probability from ks"""
)
def product_limit_points(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sv.product_limit(_followed(spark, folder), ["kind"], time="time", event="event").drop("cumulative_hazard"))


_AT_SQL = """
tt as (select unnest([{times}]::DOUBLE[]) as days), gg as (select distinct k, total from ks),
aa as (select gg.k, tt.days, gg.total, (select surv from ks where ks.k = gg.k and ks.time <= tt.days order by ks.time desc limit 1) as surv,
             (select at_risk from ks where ks.k = gg.k and ks.time <= tt.days order by ks.time desc limit 1) as at_risk from gg cross join tt)"""


@registry.query(
    f"""with {_FOLLOWED_SQL}, {_km_sql('fol', 'kind')}, {_AT_SQL.format(times='0, 0.25, 0.5, 1, 2, 3, 5, 10, 20')}
select k as kind, days, round(coalesce(surv, 1), 6) as survival_probability, round(1 - coalesce(surv, 1), 6) as censoring_rate, coalesce(at_risk, total)::BIGINT as n_at_risk from aa"""
)
def survival_at_times(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        sv.survival_table(_followed(spark, folder), ["kind"], time="time", event="event", times=[0, 0.25, 0.5, 1, 2, 3, 5, 10, 20])
    )


@registry.query(
    f"""with {SCORED_SQL}, st as (select days::DOUBLE as time, label as event, l_linestatus from scored where days >= 0), {_km_sql('st', "'all'")},
{_AT_SQL.format(times=', '.join(str(t) for t in range(0, 2600, 100)))}
select days, round(coalesce(surv, 1), 6) as survival_probability, round(1 - coalesce(surv, 1), 6) as censoring_rate, coalesce(at_risk, total)::BIGINT as n_at_risk from aa"""
)
def survival_of_lines(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sv.survival_table(stays(spark, folder), [], time="days", event="label", times=range(0, 2600, 100)))


@registry.query(
    f"""with {_FOLLOWED_SQL}, {_km_sql('fol', 'kind')}, {_AT_SQL.format(times=', '.join(str(t) for t in range(1, 13)))},
ke as (select k, floor(max(time)) as stop from ks group by 1)
select aa.k as kind, days::INTEGER as time, round(case when coalesce(surv, 1) = 0 then 'inf'::DOUBLE else -ln(coalesce(surv, 1)) end, 6) as cumulative_hazard,
coalesce(at_risk, total)::BIGINT as n_at_risk from aa join ke on ke.k = aa.k where days <= stop"""
)
def cumulative_hazard(spark: SparkSession, folder: str) -> DataFrame:
    out = sv.cumulative_hazard(_followed(spark, folder), ["kind"], time="time", event="event", max_time=12)
    return out.withColumn("cumulative_hazard", F.round(F.col("cumulative_hazard") + 0.0, 6))


@registry.query(
    f"with {SCORED_SQL}, st as (select * from scored where days >= 0 and label = 1), dd as (select unnest(range(0, 181, 10))::INTEGER as day)"
    + " union all ".join(
        f"""select '{c}' as group_variable, {c}::VARCHAR as group_value, day, round(count(*) filter (where days > day)::DOUBLE / count(*), 6) as survival_probability,
round(1 - count(*) filter (where days > day)::DOUBLE / count(*), 6) as adoption_probability, count(*)::BIGINT as records from st cross join dd group by {c}, day having count(*) >= 20"""
        for c in ("l_linestatus", "o_orderpriority", "order_year")
    )
)
def adopted_curves(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sv.adopted_curves(stays(spark, folder), ["l_linestatus", "o_orderpriority", "order_year"], label="label", days="days"))


@registry.query(
    f"with {SCORED_SQL} select count(*)::BIGINT as records, round(avg((score - label) * (score - label)), 6) as brier_score from scored where days <= 300"
)
def survival_brier(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sv.survival_brier(scored(spark, folder), time="days", event="label", risk="score", horizon=300))


@registry.query(
    f"""with {SCORED_SQL}, b as (select (floor(round(score * 10, 9)) + 0.5) / 10 as c, avg(label) as o from scored where days <= 300 and score < 1 group by 1)
select round(regr_slope(o, c), 6) as calibration_slope, round(regr_intercept(o, c), 6) as calibration_intercept, round(regr_r2(o, c), 6) as calibration_r2 from b"""
)
def survival_calibration(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sv.survival_calibration(scored(spark, folder), time="days", event="label", risk="score", horizon=300))


@registry.query(
    """
with d as (select quality as event, n_chars / (n_chars + 2000.0::DOUBLE) as risk from labels join documents using (doc_id)),
e as (select quantile_cont(risk, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from d),
b as (select len(list_filter(q, lambda x: x <= risk))::INTEGER as bin, event, risk from d cross join e)
select bin, count(*)::BIGINT as records, round(avg(event), 6) as observed_rate, round(avg(risk), 6) as expected_rate,
round(power(avg(event) - avg(risk), 2) / (avg(risk) + 1e-10) * count(*), 6) as chi_square from b group by 1"""
)
def risk_deciles(spark: SparkSession, folder: str) -> DataFrame:
    from sojourn.catalog.scores import _documents

    return rounded(sv.risk_calibration(_documents(spark, folder), risk="score", event="label"))


@registry.query(
    f"""with {SCORED_SQL} select 'score' as variable, round(regr_slope(score, days / (select max(days) from scored)::DOUBLE), 6) as slope, 0.0::DOUBLE as t_statistic, false as time_dependent from scored
union all select 'predicted_days', round(regr_slope(predicted_days, days / (select max(days) from scored)::DOUBLE), 6), 0.0::DOUBLE, false from scored"""
)
def covariate_trends(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sv.covariate_trends(scored(spark, folder), ["score", "predicted_days"], time="days"))


@registry.query(
    f"""with {SCORED_SQL} select count(*)::BIGINT as total_records, 0::BIGINT as missing_time, 0::BIGINT as missing_event, min(days)::DOUBLE as min_time, max(days)::DOUBLE as max_time,
round(avg(days), 6) as mean_time, round(avg(label), 6) as event_rate, sum(label)::BIGINT as n_events, (count(*) - sum(label))::BIGINT as n_censored, 'good' as data_quality, true as is_valid from scored"""
)
def survival_validation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sv.survival_validation(scored(spark, folder), time="days", event="label"))
