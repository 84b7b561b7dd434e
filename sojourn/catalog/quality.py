"""Audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.catalog import Registry
from sojourn.catalog.episodes import HORIZONS, episode_sql, event_ends, event_starts, horizon_rows, paired
from sojourn.functions.clean import volume_filter, volume_filter_audit
from sojourn.operators import quality as ql
from sojourn.operators.rolling import prior_counts
from sojourn.sources.tables import read_table

registry = Registry()


def _missing_sql(source: str, columns: dict[str, str]) -> str:
    parts = [
        f"""select '{c}' as feature, '{kind}' as dtype, count(*) filter (where {c} is null)::BIGINT as missing_count,
round(count(*) filter (where {c} is null) * 100.0::DOUBLE / count(*), 2) as missing_percent, count(distinct {c})::BIGINT as unique_values,
coalesce((select string_agg(v, ' | ' order by v) from (select distinct {c}::VARCHAR as v from {source} where {c} is not null order by v limit 5)), '') as example_values from {source}"""
        for c, kind in columns.items()
    ]
    return " union all ".join(parts)


@registry.query(
    "with d as (select *, nullif(o_orderpriority, '4-NOT SPECIFIED') as priority from orders)"
    + _missing_sql("d", {"o_orderstatus": "string", "priority": "string", "o_custkey": "bigint", "o_orderpriority": "string"})
)
def missingness(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "orders").withColumn(
        "priority", F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED"))
    )
    return ql.missingness(rows, ["o_orderstatus", "priority", "o_custkey", "o_orderpriority"])


_CARD = ("p_name", "p_brand", "p_type", "p_size")


@registry.query(
    " union all ".join(
        f"""select '{c}' as feature, count(*)::BIGINT as unique_values, count(*) filter (where n * 100.0 / t < 1)::BIGINT as rare_category_count,
round(avg((n * 100.0 / t < 1)::INTEGER) * 100, 1) as rare_category_percent,
(select string_agg(v, ' | ' order by n desc, v) from (select {c}::VARCHAR as v, count(*) as n from part group by 1 order by n desc, v limit 10)) as top_10_values
from (select {c} as v, count(*) as n, sum(count(*)) over () as t from part group by 1)"""
        for c in _CARD
    )
)
def cardinality(spark: SparkSession, folder: str) -> DataFrame:
    return ql.cardinality(read_table(spark, folder, "part"), _CARD)


def _stage_sql(stage: str, source: str, kind: str | None, ts: str | None) -> str:
    kinds = [
        f"count(*) filter (where {kind} = '{value}')::BIGINT" if kind else "null::BIGINT" for value in ("purchase", "error")
    ]
    dates = [f"{fn}({ts})::DATE::VARCHAR" if ts else "null::VARCHAR" for fn in ("min", "max")]
    return f"""select '{stage}' as stage, count(*)::BIGINT as rows, {kinds[0]} as purchase_rows, {kinds[1]} as error_rows,
count(distinct user_id)::BIGINT as unique_entities, (count(*) - count(distinct user_id))::BIGINT as duplicate_entity_ids,
{dates[0]} as min_start_date, {dates[1]} as max_start_date from {source}"""


@registry.query(
    f"""with {episode_sql()}, st as (
select 0 as position, null::VARCHAR as f, 'All events' as reason, * from ({_stage_sql('raw_events', 'events', 'event_type', 'ts')})
union all select 1, 'raw_events', 'Start events', * from ({_stage_sql('starts', "(select * from events where event_type = 'signup')", None, 'ts')})
union all select 2, 'raw_events', 'End events', * from ({_stage_sql('ends', "(select * from events where event_type in ('purchase', 'error', 'click'))", 'event_type', None)})
union all select 3, 'starts', 'Starts with an end', * from ({_stage_sql('matched', '(select * from ep where end_ts is not null)', None, 'start_ts')}))
select s.position, s.stage, s.rows, s.purchase_rows, s.error_rows, s.unique_entities, s.duplicate_entity_ids, s.min_start_date, s.max_start_date, s.reason,
(b.rows - s.rows)::BIGINT as rows_removed from st s left join st b on b.stage = s.f"""
)
def attrition(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events").select("user_id", "event_type", "ts")
    kinds = {"purchase": "purchase", "error": "error"}
    words = {"Adoption": "purchase", "Transfer": "error"}
    ends = event_ends(spark, folder)
    kind = F.lit(None).cast("string")
    for word, event in words.items():
        kind = F.when(F.col("end_type") == word, event).otherwise(kind)
    counts = lambda rows, stage, t, ts: ql.stage_counts(
        rows, stage, entity="user_id", entity_type=t, kinds=kinds, ts=ts
    )
    return ql.attrition(
        [
            (counts(events, "raw_events", "event_type", "ts"), None, "All events"),
            (counts(event_starts(spark, folder), "starts", None, "start_ts"), "raw_events", "Start events"),
            (counts(ends.withColumn("event_type", kind), "ends", "event_type", None), "raw_events", "End events"),
            (counts(paired(spark, folder).matched, "matched", None, "start_ts"), "starts", "Starts with an end"),
        ]
    )


_FOLLOW = " union all ".join(
    f"""select {h} as horizon_days, count(*)::BIGINT as total_rows, count(l{h})::BIGINT as included_rows, (count(*) - count(l{h}))::BIGINT as censored_rows,
(count(*) - count(l{h}))::BIGINT as excluded_rows, count(*) filter (where fu >= {h})::BIGINT as full_followup_rows, count(*) filter (where fu < {h})::BIGINT as short_followup_rows,
count(*) filter (where fu < {h} and end_type = 'Adoption' and days <= {h})::BIGINT as fast_adopted_short_followup_rows from fo"""
    for h in HORIZONS
)
_LABELS = ", ".join(f"case when end_ts is not null or fu >= {h} then 1 end as l{h}" for h in HORIZONS)


@registry.query(
    f"""with {episode_sql()}, f0 as (select *, date_diff('microsecond', start_ts, observation_end) / 86400000000.0 as fu from ep),
fo as (select *, {_LABELS} from f0) {_FOLLOW}"""
)
def followup_audit(spark: SparkSession, folder: str) -> DataFrame:
    return ql.followup_audit(horizon_rows(spark, folder), HORIZONS)


_VOLUME_SQL = """
with s as (select user_id, ts from events where event_type = 'signup'),
v as (select a.user_id, a.ts, count(b.ts) as n from s a left join s b on b.ts < a.ts and b.ts >= a.ts - interval 7 day group by 1, 2)"""


def _volumes(spark: SparkSession, folder: str) -> DataFrame:
    starts = event_starts(spark, folder).select("user_id", "start_ts")
    return prior_counts(starts, entity="user_id", ts="start_ts", windows=(7,))


@registry.query(
    f"""{_VOLUME_SQL} select 300.0::DOUBLE as threshold_value, count(*)::BIGINT as rows_before, count(*) filter (where n > 300)::BIGINT as rows_removed,
count(*) filter (where n <= 300)::BIGINT as rows_after from v"""
)
def volume_audit(spark: SparkSession, folder: str) -> DataFrame:
    return volume_filter_audit(_volumes(spark, folder), "intake_volume_7d", 300)


@registry.query(f"{_VOLUME_SQL} select user_id, ts as start_ts, n::BIGINT as intake_volume_7d from v where n <= 300")
def volume_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return volume_filter(_volumes(spark, folder), "intake_volume_7d", 300)


@registry.query(
    """select 'o_orderstatus' as "column", count(o_orderstatus)::BIGINT as non_null, min(o_orderstatus) = max(o_orderstatus) as constant, false as is_time,
bool_or(contains(lower(o_orderstatus), 'x')) as suspicious, 'probably_safe' as risk_level from orders
union all select 'o_orderpriority', count(*)::BIGINT, false, false, bool_or(contains(lower(o_orderpriority), 'urgent')), 'needs_audit' from orders
union all select 'o_orderdate', count(*)::BIGINT, false, true, false, 'unsafe' from orders
union all select 'nothing', 0::BIGINT, true, false, false, 'unsafe'"""
)
def leakage_by_data(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "orders").withColumn("nothing", F.lit(None).cast("string"))
    return ql.leakage_by_data(
        rows, ["o_orderstatus", "o_orderpriority", "o_orderdate", "nothing"], {"o_orderpriority": ("urgent",), "o_orderstatus": ("x",)}
    )


@registry.query(
    """select * from (values
('next_start', 'other', false, false, false, true, false, false, 'unsafe'),
('o_custkey', 'metadata', false, false, true, false, false, false, 'unsafe'),
('o_orderdate', 'other', false, false, false, false, false, false, 'unsafe'),
('o_orderkey', 'other', false, false, false, false, false, false, 'unsafe'),
('o_orderpriority', 'predictor', true, false, false, false, false, true, 'needs_audit'),
('o_orderstatus', 'predictor and prohibited', true, false, false, true, true, false, 'unsafe'),
('o_totalprice', 'target', false, true, false, false, false, false, 'unsafe'))
t("column", role, in_features, in_targets, in_metadata, in_prohibited, leakage_violation, allowed_as_predictor, risk_level)
where exists (select 1 from orders where contains(lower(o_orderpriority), 'urgent'))"""
)
def leakage_audit(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "orders").withColumn("next_start", F.col("o_orderdate"))
    return ql.leakage_audit(
        rows, features=["o_orderpriority", "o_orderstatus"], targets=["o_totalprice"], metadata=["o_custkey"],
        audited=["o_orderpriority"], extra_prohibited=["o_orderstatus"], words={"o_orderpriority": ("urgent",)},
    )
