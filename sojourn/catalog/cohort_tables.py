"""Cohort, timing, profile and evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.catalog import Registry
from sojourn.catalog.tables import LINES_SQL, SCORED_SQL, lines, rounded, scored, stays
from sojourn.operators import cohorts as co
from sojourn.sources.tables import read_table

registry = Registry()

DIMS = ("l_linestatus", "o_orderstatus", "o_orderpriority", "order_year")
END_TYPES = {"transfer": "Transfer", "euthanasia": "Euthanasia"}
PERIODS = ("early", "middle", "late", "future")
PERIOD_SQL = "case when o_orderdate < '1997-01-01' then 'early' when o_orderdate < '1999-01-01' then 'middle' else 'late' end"


def _period():
    when = F.col("o_orderdate")
    return (
        F.when(when < F.lit("1997-01-01").cast("timestamp_ntz"), "early")
        .when(when < F.lit("1999-01-01").cast("timestamp_ntz"), "middle")
        .otherwise("late")
    )


def _summary_sql(dims, source="stays", extra=""):
    parts = [
        f"""select '{d}' as variable, {d}::VARCHAR as value, count(label)::BIGINT as records, sum(label)::BIGINT as adoptions,
       round(sum(label) * 100.0::DOUBLE / count(label), 6) as adoption_rate_pct,
       round(quantile_cont(days::DOUBLE, 0.5), 6) as median_days_to_outcome,
       'classification_target/regression_target_days' as target_column, 'all matched episodes' as population_scope,
       'adoption_rate_and_median_los' as estimand_label
from {source} group by {d}"""
        for d in dims
    ]
    return f"with {LINES_SQL}, stays as (select * from lines where days >= 0) {extra}" + "\nunion all\n".join(parts)


@registry.query(_summary_sql(DIMS))
def cohort_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(co.summarize(stays(spark, folder), DIMS, label="label", days="days", whole_days=True))


@registry.query(_summary_sql(DIMS[:3]))
def cohort_summary_any_values(spark: SparkSession, folder: str) -> DataFrame:
    """The same table on the path for durations without a bound on their distinct values."""
    return rounded(co.summarize(stays(spark, folder), DIMS[:3], label="label", days="days"))


@registry.query(
    _summary_sql(["season"], "seasons",
    """, seasons as (select *, case when month(o_orderdate) in (12, 1, 2) then 'Winter' when month(o_orderdate) in (3, 4, 5) then 'Spring'
 when month(o_orderdate) in (6, 7, 8) then 'Summer' else 'Autumn' end as season from stays)
""")
)
def season_summary(spark: SparkSession, folder: str) -> DataFrame:
    from sojourn.functions.text import season

    rows = stays(spark, folder).withColumn("season", season(F.month("o_orderdate")))
    names = {"winter": "Winter", "spring": "Spring", "summer": "Summer", "autumn": "Autumn"}
    return rounded(co.summarize(rows, ["season"], label="label", days="days", whole_days=True, value_labels=names))


@registry.query(
    f"""with {LINES_SQL}, stays as (select * from lines where days >= 0),
g as (select o_orderpriority as value, sum(label) * 100.0::DOUBLE / count(*) as r, quantile_cont(days::DOUBLE, 0.5) as m from stays group by 1)
select 'o_orderpriority' as variable,
       (select value from g order by r desc, value desc limit 1) as highest_rate_value,
       (select value from g order by r, value limit 1) as lowest_rate_value,
       (select value from g order by m desc, value desc limit 1) as longest_median_value,
       (select value from g order by m, value limit 1) as shortest_median_value,
       round((select max(r) - min(r) from g), 6) as rate_gap, round((select max(m) - min(m) from g), 6) as median_gap"""
)
def summary_extremes(spark: SparkSession, folder: str) -> DataFrame:
    table = co.summarize(stays(spark, folder), ["o_orderpriority"], label="label", days="days", whole_days=True)
    return rounded(co.extremes(table))


@registry.query(
    f"""with {LINES_SQL} select order_year, count(*)::BIGINT as starts, count(label)::BIGINT as outcomes, sum(label)::BIGINT as adoptions,
round(avg(label) * 100, 6) as adoption_rate_pct from lines group by 1"""
)
def counts_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(co.yearly_counts(lines(spark, folder), year="order_year", label="label"))


_TIMING_SQL = """
select '{dim}' as group_variable, {dim}::VARCHAR as group_value, {kind} as animal_type, count(*)::BIGINT as all_records,
       count(*) filter (where label = 1)::BIGINT as adopted_records,
       round(avg(days) filter (where label = 1), 6) as mean_days_to_adoption,
       round(quantile_cont(days::DOUBLE, 0.25) filter (where label = 1), 6) as p25_days_to_adoption,
       round(quantile_cont(days::DOUBLE, 0.5) filter (where label = 1), 6) as median_days_to_adoption,
       round(quantile_cont(days::DOUBLE, 0.75) filter (where label = 1), 6) as p75_days_to_adoption,
       count(*) filter (where label = 1 and days <= 7)::BIGINT as adopted_within_7_days,
       count(*) filter (where label = 1 and days <= 30)::BIGINT as adopted_within_30_days,
       count(*) filter (where label = 1 and days <= 60)::BIGINT as adopted_within_60_days,
       count(*) filter (where label = 1 and days <= 90)::BIGINT as adopted_within_90_days
from stays group by {by} having count(*) filter (where label = 1) > 0"""


@registry.query(
    f"with {LINES_SQL}, stays as (select * from lines where days >= 0)"
    + " union all ".join(
        [
            _TIMING_SQL.format(dim="o_orderpriority", kind="o_orderstatus", by="o_orderpriority, o_orderstatus"),
            _TIMING_SQL.format(dim="o_orderpriority", kind="'Combined'", by="o_orderpriority"),
            _TIMING_SQL.format(dim="o_orderstatus", kind="o_orderstatus", by="o_orderstatus"),
            _TIMING_SQL.format(dim="o_orderstatus", kind="'Combined'", by="o_orderstatus"),
        ]
    )
)
def adopted_timing(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        co.adopted_timing(
            stays(spark, folder), dims=["o_orderpriority", "o_orderstatus"], entity_type="o_orderstatus",
            label="label", days="days",
        )
    )


@registry.query(
    f"with {LINES_SQL}, stays as (select * from lines where days >= 0)"
    + " union all ".join(
        f"""select '{d}' as cohort, {d}::VARCHAR as value, count(*)::BIGINT as records, sum(label)::BIGINT as adoptions,
round(sum(label) * 100.0::DOUBLE / count(*), 6) as adoption_rate_pct,
"""
        + ",".join(
            f"round(case when sum(label) = 0 then 0 else count(*) filter (where label = 1 and days <= {m}) * 100.0::DOUBLE / sum(label) end, 6) as adopted_by_day_{m}_pct"
            for m in (7, 30, 60, 90)
        )
        + f" from stays group by {d} having count(*) >= 50"
        for d in DIMS
    )
)
def adoption_milestones(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(co.milestones(stays(spark, folder), DIMS, label="label", days="days"))


PROFILE = ("l_linestatus", "o_orderstatus", "o_orderpriority")
LABEL_GROUPS = (("o_orderpriority",), ("l_linestatus", "o_orderstatus"))
_PROFILE_LABEL_SQL = "o_orderpriority || ' | ' || l_linestatus || ' / ' || o_orderstatus"
_ARCHETYPES_SQL = f"""{LINES_SQL}, stays as (select * from lines where days >= 0),
g as (select l_linestatus, o_orderstatus, o_orderpriority, count(*)::BIGINT as records, sum(label)::BIGINT as adoptions,
             sum(label) * 100.0::DOUBLE / count(*) as adoption_rate_pct, avg(days) as mean_days_to_outcome,
             count(*) filter (where end_type = 'Transfer') * 100.0::DOUBLE / count(*) as transfer_rate_pct,
             count(*) filter (where end_type = 'Euthanasia') * 100.0::DOUBLE / count(*) as euthanasia_rate_pct,
             quantile_cont(days::DOUBLE, 0.5) as median_days_to_outcome
      from stays group by 1, 2, 3 having count(*) >= 50),
arch as (select *, {_PROFILE_LABEL_SQL} as profile_label,
         case when adoption_rate_pct >= 60 and median_days_to_outcome < 600 then 'quick placement likely'
              when adoption_rate_pct >= 50 and median_days_to_outcome >= 600 then 'needs visibility'
              when adoption_rate_pct < 40 and median_days_to_outcome >= 600 then 'long-stay risk'
              else 'outcome support priority' end as visibility_need from g)
"""


def _archetypes(spark: SparkSession, folder: str) -> DataFrame:
    return co.archetypes(
        stays(spark, folder), PROFILE, label="label", days="days", end_type="end_type", end_types=END_TYPES,
        label_groups=LABEL_GROUPS, long_days=600, whole_days=True,
    )


@registry.query(
    f"""with {_ARCHETYPES_SQL} select l_linestatus, o_orderstatus, o_orderpriority, records, adoptions,
round(adoption_rate_pct, 6) as adoption_rate_pct, round(mean_days_to_outcome, 6) as mean_days_to_outcome,
round(transfer_rate_pct, 6) as transfer_rate_pct, round(euthanasia_rate_pct, 6) as euthanasia_rate_pct,
round(median_days_to_outcome, 6) as median_days_to_outcome, profile_label, visibility_need from arch"""
)
def archetypes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_archetypes(spark, folder))


_VULNERABLE_SQL = f"""{_ARCHETYPES_SQL},
vul as (select *, (100 - adoption_rate_pct) + ln(1 + greatest(median_days_to_outcome, 0)) * 10 + ln(1 + records) as vulnerability_score
        from arch order by vulnerability_score desc, records desc, profile_label limit 12)
"""


@registry.query(
    f"with {_VULNERABLE_SQL} select profile_label, records, round(vulnerability_score, 6) as vulnerability_score, visibility_need from vul"
)
def vulnerable_profiles(spark: SparkSession, folder: str) -> DataFrame:
    table = co.vulnerable_profiles(_archetypes(spark, folder), top=12)
    return rounded(table.select("profile_label", "records", "vulnerability_score", "visibility_need"))


@registry.query(
    f"""with {_VULNERABLE_SQL} select 'animal_profiles' as section, profile_label as item, 'vulnerability_score' as metric,
round(vulnerability_score, 6) as value,
records, round(adoption_rate_pct, 6) as adoption_rate_pct, visibility_need
from vul order by vulnerability_score desc, records desc, profile_label limit 5"""
)
def risk_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(co.risk_evidence(co.vulnerable_profiles(_archetypes(spark, folder), top=12)))


_CONTRASTS = {
    "open_vs_other_lines": "case when l_linestatus = 'O' then 'open' else 'other' end",
    "urgent_vs_low_by_status": "case when o_orderpriority in ('1-URGENT', '5-LOW') then o_orderstatus || '_' || o_orderpriority end",
    "finished_orders_by_year": "case when o_orderstatus = 'F' then 'year_' || order_year end",
}


@registry.query(
    f"with {LINES_SQL}, stays as (select * from lines where days >= 0)"
    + " union all ".join(
        f"""select '{n}' as contrast, {e} as contrast_value, count(label)::BIGINT as records,
round(avg(label) * 100, 6) as adoption_rate_pct,
round(count(*) filter (where end_type = 'Transfer') * 100.0::DOUBLE / count(*), 6) as transfer_rate_pct,
round(count(*) filter (where end_type = 'Euthanasia') * 100.0::DOUBLE / count(*), 6) as euthanasia_rate_pct,
round(quantile_cont(days::DOUBLE, 0.5), 6) as median_days_to_outcome
from stays where {e} is not null group by 2"""
        for n, e in _CONTRASTS.items()
    )
)
def profile_contrasts(spark: SparkSession, folder: str) -> DataFrame:
    named = {
        "open_vs_other_lines": F.when(F.col("l_linestatus") == "O", "open").otherwise("other"),
        "urgent_vs_low_by_status": F.when(
            F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), F.concat_ws("_", "o_orderstatus", "o_orderpriority")
        ),
        "finished_orders_by_year": F.when(
            F.col("o_orderstatus") == "F", F.concat(F.lit("year_"), F.col("order_year").cast("string"))
        ),
    }
    return rounded(
        co.contrasts(stays(spark, folder), named, label="label", days="days", end_type="end_type", end_types=END_TYPES, whole_days=True)
    )


@registry.query(
    f"""with {_ARCHETYPES_SQL}, s as (select *, (score >= 0.5)::INTEGER as predicted, abs(days - predicted_days) as absolute_error from stays),
e as (select l_linestatus, o_orderstatus, o_orderpriority, count(*)::BIGINT as records, avg(label) * 100 as adoption_rate_pct,
             avg(score) * 100 as mean_predicted_adoption_probability, avg(absolute_error) as mae,
             quantile_cont(predicted_days, 0.5) as median_predicted_days, {_PROFILE_LABEL_SQL} as profile_label
      from s group by 1, 2, 3)
select e.l_linestatus, e.o_orderstatus, e.o_orderpriority, e.records, round(e.adoption_rate_pct, 6) as adoption_rate_pct,
       round(e.mean_predicted_adoption_probability, 6) as mean_predicted_adoption_probability, round(e.mae, 6) as mae,
       round(e.median_predicted_days, 6) as median_predicted_days,
       round(e.mean_predicted_adoption_probability - e.adoption_rate_pct, 6) as prediction_gap_pct, e.profile_label, a.visibility_need
from e left join arch a on a.profile_label = e.profile_label"""
)
def profile_model_error(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        co.profile_error(
            scored(spark, folder).filter(F.col("days") >= 0), PROFILE, _archetypes(spark, folder), label="label", score="score",
            predicted_days="predicted_days", absolute_error="absolute_error", label_groups=LABEL_GROUPS, whole_days=True,
        )
    )


@registry.query(
    f"""with {LINES_SQL}, p as (select *, {PERIOD_SQL} as period from lines where days >= 0),
n as (select unnest(['early', 'middle', 'late', 'future']) as period)
select n.period, count(p.label)::BIGINT as n_records, round(avg(p.label), 6) as adoption_rate,
       round(quantile_cont(p.days::DOUBLE, 0.5), 6) as median_los_days,
       round(quantile_cont(p.days::DOUBLE, 0.5) filter (where label = 1), 6) as median_days_to_adoption, count(p.label)::BIGINT as intake_volume
from n left join p on p.period = n.period group by 1"""
)
def period_matrix(spark: SparkSession, folder: str) -> DataFrame:
    rows = stays(spark, folder).withColumn("period", _period())
    return rounded(co.period_matrix(rows, period="period", periods=PERIODS, label="label", days="days", whole_days=True))


@registry.query(
    f"""with {LINES_SQL}, p as (select *, {PERIOD_SQL} as period from lines),
n as (select unnest(['early', 'middle', 'late', 'future']) as period)
select n.period, count(p.label)::BIGINT as n_records,
       round(100.0::DOUBLE * count(*) filter (where l_linestatus = 'O') / greatest(count(p.label), 1), 2) as pct_o,
       round(100.0::DOUBLE * count(*) filter (where l_linestatus = 'F') / greatest(count(p.label), 1), 2) as pct_f,
       round(100.0::DOUBLE * count(*) filter (where o_orderpriority = '1-URGENT') / greatest(count(p.label), 1), 2) as pct_intake_1_urgent,
       round(100.0::DOUBLE * count(*) filter (where o_orderpriority = '2-HIGH') / greatest(count(p.label), 1), 2) as pct_intake_2_high
from n left join p on p.period = n.period group by 1"""
)
def population_mix(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder).withColumn("period", _period())
    shares = {"": ("l_linestatus", ["O", "F"]), "intake_": ("o_orderpriority", ["1-URGENT", "2-HIGH"])}
    return co.period_mix(rows, period="period", periods=PERIODS, shares=shares)


@registry.query(
    f"""with {LINES_SQL}, stays as (select * from lines where days >= 0),
t as (select *, 'combined' as animal_subset from stays
      union all select *, 'open' from stays where l_linestatus = 'O' union all select *, 'finished' from stays where l_linestatus = 'F')
select o_orderpriority, animal_subset, count(*)::BIGINT as records, sum(label)::BIGINT as adoptions, round(avg(label), 6) as adoption_rate,
       count(*) filter (where label = 1)::BIGINT as adopted_records,
       round(quantile_cont(days::DOUBLE, 0.5) filter (where label = 1), 6) as median_days_to_adoption
from t group by 1, 2"""
)
def age_group_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        co.group_evidence(
            stays(spark, folder), group="o_orderpriority", entity_type="l_linestatus", subsets={"open": "o", "finished": "f"},
            label="label", days="days", whole_days=True,
        )
    )


@registry.query(
    f"""with {LINES_SQL}, stays as (select * from lines where days >= 0),
q as (select unnest([0.25, 0.5, 0.75, 0.9, 0.95, 0.99]::DOUBLE[]) as quantile),
g as (select l_linestatus, count(*)::BIGINT as n,
             quantile_cont(days::DOUBLE, [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) as v from stays group by 1)
select l_linestatus, unnest([0.25, 0.5, 0.75, 0.9, 0.95, 0.99]::DOUBLE[]) as quantile, round(unnest(v), 6) as duration_days, n from g"""
)
def duration_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(co.duration_quantiles(stays(spark, folder), group="l_linestatus", days="days"))


@registry.query(
    """with g as (select o_orderstatus, count(*)::BIGINT as n, quantile_cont(o_totalprice, [0.1, 0.5, 0.99]) as v from orders group by 1)
select o_orderstatus, unnest([0.1, 0.5, 0.99]::DOUBLE[]) as quantile, round(unnest(v), 4) as duration_days, n from g"""
)
def price_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact quantiles of values that hardly repeat."""
    out = co.duration_quantiles(read_table(spark, folder, "orders"), group="o_orderstatus", days="o_totalprice", quantiles=(0.1, 0.5, 0.99))
    return rounded(out, 4)


_FINDER = ("l_linestatus", "o_orderstatus", "o_orderpriority", "order_year")


@registry.query(
    f"""with {SCORED_SQL},
g as (select l_linestatus, o_orderstatus, o_orderpriority, order_year::VARCHAR as order_year, count(*)::BIGINT as cohort_size,
             round(sum(label) * 100.0::DOUBLE / count(*), 6) as observed_pct, round(sum(score) * 100.0::DOUBLE / count(*), 6) as mean_predicted_pct,
             round(quantile_cont(predicted_days, 0.5), 6) as median_days,
             grouping(l_linestatus) as g1, grouping(o_orderstatus) as g2, grouping(o_orderpriority) as g3, grouping(order_year) as g4
      from scored group by cube (l_linestatus, o_orderstatus, o_orderpriority, order_year))
select coalesce(nullif(concat_ws(' ', case when g1 = 0 then 'l_linestatus' end, case when g2 = 0 then 'o_orderstatus' end,
       case when g3 = 0 then 'o_orderpriority' end, case when g4 = 0 then 'order_year' end), ''), 'nothing') as filtered_on,
       l_linestatus, o_orderstatus, o_orderpriority, order_year, cohort_size, observed_pct, mean_predicted_pct, median_days
from g"""
)
def cohort_finder(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        co.cohort_finder(scored(spark, folder), _FINDER, label="label", score="score", days="predicted_days", whole_days=True)
    )


@registry.query(
    f"""with {SCORED_SQL} select l_orderkey, l_linenumber, score, label from scored
where l_linestatus = 'O' and o_orderpriority = '1-URGENT' order by l_orderkey, l_linenumber, score, label limit 100"""
)
def cohort_first_rows(spark: SparkSession, folder: str) -> DataFrame:
    filters = {"l_linestatus": "O", "o_orderpriority": "1-URGENT"}
    return co.cohort_rows(scored(spark, folder), filters, ["l_orderkey", "l_linenumber", "score", "label"])


@registry.query(
    f"with {LINES_SQL}, stays as (select * from lines where days >= 0), m as ("
    + """select o_orderpriority as value, round(count(*) filter (where label = 1 and days <= 7) * 100.0::DOUBLE / sum(label), 6) as a,
round(count(*) filter (where label = 1 and days <= 90) * 100.0::DOUBLE / sum(label), 6) as b from stays group by 1)
select value, 'adopted_by_day_7_pct' as metric, a as metric_value from m union all select value, 'adopted_by_day_90_pct', b from m"""
)
def milestone_curves(spark: SparkSession, folder: str) -> DataFrame:
    table = rounded(co.milestones(stays(spark, folder), ["o_orderpriority"], label="label", days="days"))
    return co.long_form(table, ["value"], ["adopted_by_day_7_pct", "adopted_by_day_90_pct"])


TIERS = (
    ("exact visible profile", ("o_orderstatus", "o_orderpriority", "segment", "order_year")),
    ("profile without year", ("o_orderstatus", "o_orderpriority", "segment")),
    ("coarse context", ("o_orderstatus", "segment")),
)


@registry.query(
    f"""with {LINES_SQL},
h as (select l.*, c_mktsegment as segment from lines l join customer on c_custkey = o_custkey where days >= 0 and order_year <= 1999),
p as (select o_orderkey as profile, o_orderstatus, o_orderpriority, c_mktsegment as segment, year(o_orderdate) as order_year from orders join customer on c_custkey = o_custkey),
pt as (select distinct o_orderstatus, o_orderpriority, segment, order_year from p),
m as (
""" + " union all ".join(
        f"""select pt.*, {i} as tier, '{name}' as matching_level, '{", ".join(used)}' as matched_fields, count(*)::BIGINT as similar_records,
count(*) filter (where end_type = 'Transfer') * 100.0::DOUBLE / count(*) as t, count(*) filter (where end_type = 'Euthanasia') * 100.0::DOUBLE / count(*) as e,
avg(label) * 100 as a, quantile_cont(days::DOUBLE, 0.5) as d
from pt join h on {" and ".join(f"h.{u} is not distinct from pt.{u}" for u in used)} group by pt.o_orderstatus, pt.o_orderpriority, pt.segment, pt.order_year"""
        for i, (name, used) in enumerate(TIERS)
    ) + """), b as (select * from m qualify row_number() over (partition by o_orderstatus, o_orderpriority, segment, order_year order by tier) = 1)
select p.profile, b.similar_records, b.matching_level, b.matched_fields, round(t, 6) as transfer_rate_pct, round(e, 6) as euthanasia_rate_pct,
round(a, 6) as historical_adoption_rate_pct, round(d, 6) as median_days_to_outcome
from p join b on p.o_orderstatus = b.o_orderstatus and p.o_orderpriority = b.o_orderpriority and p.segment = b.segment and p.order_year = b.order_year"""
)
def similar_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Every order asks for the lines most like it among earlier ones."""
    from sojourn.operators.similar import similar_cases as find

    customers = read_table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    history = stays(spark, folder).filter(F.col("order_year") <= 1999).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    profiles = read_table(spark, folder, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("profile"), "o_orderstatus", "o_orderpriority", "segment", F.year("o_orderdate").alias("order_year")
    )
    return rounded(
        find(
            history, profiles, profile_id="profile", tiers=TIERS, label="label", days="days", end_type="end_type",
            end_types=END_TYPES, whole_days=True,
        )
    )
