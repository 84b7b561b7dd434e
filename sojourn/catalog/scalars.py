"""Cleaning, parsing, text rules and labels over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.catalog import Registry
from sojourn.catalog.tables import LINES_SQL, lines, rounded
from sojourn.functions import clean as cl
from sojourn.functions import labels as lb
from sojourn.functions import text as tx
from sojourn.operators import importance as im
from sojourn.plans.profiles import profile_records
from sojourn.sources import contracts
from sojourn.sources.tables import read_table, strict_boolean, union_ragged, with_schema

registry = Registry()

_STAMPS_SQL = """
select o_orderkey, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '-06:00' when 1 then strftime(o_orderdate, '%m/%d/%Y %I:%M:%S %p')
when 2 then ' ' || strftime(o_orderdate, '%Y-%m-%d') || ' ' when 3 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || 'Z' else 'not a date' end as text, o_orderdate from orders"""


def _stamps(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates written in several text forms."""
    k = F.col("o_orderkey") % 5
    iso = lambda p: F.date_format("o_orderdate", p)
    text = (
        F.when(k == 0, F.concat(iso("yyyy-MM-dd'T'HH:mm:ss"), F.lit("-06:00")))
        .when(k == 1, iso("MM/dd/yyyy hh:mm:ss a"))
        .when(k == 2, F.concat(F.lit(" "), iso("yyyy-MM-dd"), F.lit(" ")))
        .when(k == 3, F.concat(iso("yyyy-MM-dd HH:mm:ss"), F.lit("Z")))
        .otherwise("not a date")
    )
    return read_table(spark, folder, "orders").select("o_orderkey", text.alias("text"), "o_orderstatus")


@registry.query(f"select o_orderkey, text, case when text <> 'not a date' then o_orderdate end as parsed from ({_STAMPS_SQL})")
def parse_times(spark: SparkSession, folder: str) -> DataFrame:
    return _stamps(spark, folder).select("o_orderkey", "text", cl.parse_wall_clock(F.col("text")).alias("parsed"))


@registry.query(
    f"""select o_orderkey as animal_id, o_orderdate as intake_datetime, case o_orderstatus when 'F' then ' Dog' else 'CAT ' end as animal_type
from ({_STAMPS_SQL}) join orders using (o_orderkey, o_orderdate) where text <> 'not a date' and o_orderstatus in ('F', 'O')"""
)
def clean_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record appears twice and some have unusable times or types."""
    kind = F.when(F.col("o_orderstatus") == "F", " Dog").when(F.col("o_orderstatus") == "O", "CAT ").otherwise("Bird")
    raw = _stamps(spark, folder).select(
        F.col("o_orderkey").alias("animal_id"), F.col("text").alias("intake_datetime"), kind.alias("animal_type")
    )
    return cl.clean_events(
        raw.unionAll(raw), entity="animal_id", entity_type="animal_type", ts="intake_datetime", allowed=("dog", "cat")
    )


_AGE_SQL = """select p_partkey, case p_partkey % 6 when 0 then p_size || ' years' when 1 then p_size || ' Months' when 2 then '1 week' when 3 then '-' || p_size || ' days'
when 4 then p_size || ' fortnights' else ' ' || p_size || '.5 days old' end as age from part"""


@registry.query(
    f"""with a as ({_AGE_SQL}), d as (select p_partkey, age, case p_partkey % 6 when 0 then p_size * 365.25::DOUBLE when 1 then p_size * 30.4375::DOUBLE when 2 then 7::DOUBLE when 5 then p_size + 0.5::DOUBLE end as days
from a join part using (p_partkey))
select p_partkey, age, days as age_days, case when days is null then 'unknown' when days < 365.25 then 'baby' when days < 1095.75 then 'young' when days < 2922 then 'adult' else 'senior' end as age_group,
days as age_in_days, round(days / 30, 6) as age_months, round(days / 365, 6) as age_years from d"""
)
def age_parse(spark: SparkSession, folder: str) -> DataFrame:
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    text = (
        F.when(k == 0, F.concat(size, F.lit(" years")))
        .when(k == 1, F.concat(size, F.lit(" Months")))
        .when(k == 2, F.lit("1 week"))
        .when(k == 3, F.concat(F.lit("-"), size, F.lit(" days")))
        .when(k == 4, F.concat(size, F.lit(" fortnights")))
        .otherwise(F.concat(F.lit(" "), size, F.lit(".5 days old")))
    )
    rows = read_table(spark, folder, "part").select("p_partkey", text.alias("age")).withColumn("age_days", tx.age_days(F.col("age")))
    aliases = cl.age_aliases(F.col("age_days"))
    return rounded(
        rows.withColumns({"age_group": tx.age_group(F.col("age_days")), **{k: aliases[k] for k in ("age_in_days", "age_months", "age_years")}})
    )


@registry.query(
    """select o_orderkey, case when month(o_orderdate) in (12, 1, 2) then 'winter' when month(o_orderdate) in (3, 4, 5) then 'spring' when month(o_orderdate) in (6, 7, 8) then 'summer' else 'autumn' end as season,
case when o_orderdate < '1997-03-01' then 'before' when o_orderdate < '1999-01-01' then 'during' else 'after' end as regime from orders"""
)
def season_and_regime(spark: SparkSession, folder: str) -> DataFrame:
    when = F.col("o_orderdate")
    cuts = (("1997-03-01", "before"), ("1999-01-01", "during"))
    return read_table(spark, folder, "orders").select(
        "o_orderkey", tx.season(F.month(when)).alias("season"), tx.regime(when, cuts, "after").alias("regime")
    )


def _contains_sql(column: str, rules) -> str:
    return " ".join(
        f"when {' or '.join(f'contains({column}, {chr(39)}{w}{chr(39)})' for w in words)} then '{label}'" for label, words in rules
    )


_PART_TEXT = "case p_size % 3 when 0 then p_name || ' Mix' when 1 then upper(p_name) || '/' || p_type else '  ' end"


@registry.query(
    f"""with t as (select p_partkey, {_PART_TEXT} as text from part)
select p_partkey, case when trim(text) = '' then 'unknown' {_contains_sql('lower(text)', tx.COLOR_RULES)} else 'mixed_other' end as color_group,
case when trim(text) = '' then 'unknown' else split_part(replace(lower(trim(text)), ' ', '_'), '/', 1) end as primary_color,
case when trim(text) = '' then 'unknown' else replace(trim(split_part(replace(lower(trim(text)), ' mix', ''), '/', 1)), ' ', '_') end as primary_breed,
contains(lower(text), 'mix') or contains(text, '/') as is_mixed_breed,
case when trim(text) = '' then 'unknown' when contains(lower(text), 'widget') then 'retriever_type' when contains(lower(text), 'bolt') then 'hound_type' else 'other' end as own_rules
from t"""
)
def text_rules(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_size") % 3
    text = (
        F.when(k == 0, F.concat("p_name", F.lit(" Mix")))
        .when(k == 1, F.concat(F.upper("p_name"), F.lit("/"), F.col("p_type")))
        .otherwise("  ")
    )
    t = F.col("text")
    own = (("retriever_type", ("widget",)), ("hound_type", ("bolt",)))
    return read_table(spark, folder, "part").select("p_partkey", text.alias("text")).select(
        "p_partkey",
        tx.color_group(t).alias("color_group"),
        tx.primary_color(t).alias("primary_color"),
        tx.primary_breed(t).alias("primary_breed"),
        tx.is_mixed_breed(t).alias("is_mixed_breed"),
        tx.breed_group(t, own).alias("own_rules"),
    )


_PLACE_SQL = """select c_custkey, case c_custkey % 7 when 0 then c_custkey || ' Main St in ' || n_name || ' (TX)' when 1 then n_name || ' (tx) ' when 2 then 'Outside Jurisdiction'
when 3 then 'Elm St and Oak Ave in Austin (TX)' when 4 then 'Austin (TX)' when 5 then 'Airport Blvd' else null end as place, n_name from customer join nation on n_nationkey = c_nationkey"""


@registry.query(
    f"""select c_custkey, case c_custkey % 7 when 0 then 'address_like' when 1 then 'county_or_region' when 2 then 'outside_jurisdiction' when 3 then 'intersection' when 4 then 'austin_city' else 'other' end as kind,
case c_custkey % 7 when 0 then lower(n_name) when 1 then lower(n_name) when 3 then 'austin' when 4 then 'austin' else 'unknown' end as area,
c_custkey % 7 in (3, 4) as is_austin_found_location, c_custkey % 7 = 2 as is_outside_jurisdiction, c_custkey % 7 = 3 as is_intersection_location, c_custkey % 7 = 0 as is_address_like_location,
c_custkey % 7 = 5 as is_airport_location from ({_PLACE_SQL})"""
)
def location_kinds(spark: SparkSession, folder: str) -> DataFrame:
    nations = read_table(spark, folder, "nation")
    k, name = F.col("c_custkey") % 7, F.col("n_name")
    place = (
        F.when(k == 0, F.concat(F.col("c_custkey").cast("string"), F.lit(" Main St in "), name, F.lit(" (TX)")))
        .when(k == 1, F.concat(name, F.lit(" (tx) ")))
        .when(k == 2, "Outside Jurisdiction")
        .when(k == 3, "Elm St and Oak Ave in Austin (TX)")
        .when(k == 4, "Austin (TX)")
        .when(k == 5, "Airport Blvd")
    )
    rows = read_table(spark, folder, "customer").join(nations, F.col("n_nationkey") == F.col("c_nationkey")).select(
        "c_custkey", place.alias("place")
    )
    area = tx.location_area(F.col("place"))
    flags = tx.location_flags(F.col("place"), area=area)
    return rows.select(
        "c_custkey", tx.location_kind(F.col("place"), flags, area).alias("kind"), area.alias("area"), *[c.alias(n) for n, c in flags.items()]
    )


@registry.query(
    r"""select page_id, regexp_matches(url, '(?i)\bintersection\b|/|&|\band\b') as is_intersection_location, regexp_matches(url, '^\s*\d+') as is_address_like_location,
coalesce(nullif(trim(regexp_replace(lower(trim(url)), '[^0-9a-z]+', '_', 'g'), '_'), ''), 'unknown') as slug from pages"""
)
def page_location_flags(spark: SparkSession, folder: str) -> DataFrame:
    flags = tx.location_flags(F.col("url"))
    keep = ("is_intersection_location", "is_address_like_location")
    return read_table(spark, folder, "pages").select(
        "page_id", *[flags[k].alias(k) for k in keep], tx.slug(F.col("url")).alias("slug")
    )


@registry.query(
    """with q as (select o_orderstatus, quantile_cont(o_totalprice, [0.01, 0.99]) as b from orders where year(o_orderdate) <= 1998 group by 1)
select o_orderkey, round(least(greatest(o_totalprice, b[1]), b[2]), 4) as clipped from orders join q using (o_orderstatus)"""
)
def winsorize(spark: SparkSession, folder: str) -> DataFrame:
    from sojourn.operators.encoders import winsor_bounds, winsorize as apply

    orders = read_table(spark, folder, "orders")
    bounds = winsor_bounds(orders.filter(F.year("o_orderdate") <= 1998), ["o_orderstatus"], "o_totalprice")
    return apply(orders, bounds, ["o_orderstatus"], "o_totalprice").select(
        "o_orderkey", F.round("o_totalprice", 4).alias("clipped")
    )


@registry.query(
    f"""with {LINES_SQL} select l_orderkey, l_linenumber, l_partkey, l_suppkey, days, round(ln(greatest(days, 1)), 6) as log_e, round(log10(greatest(days, 1)), 6) as log_10, round(log2(greatest(days, 1)), 6) as log_2,
case when days < 0 then 'invalid' when days <= 7 then '0-7d' when days <= 30 then '8-30d' when days <= 60 then '31-60d' when days <= 90 then '61-90d' else '90+d' end as bucket from lines"""
)
def duration_scales(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("days")
    return rounded(
        lines(spark, folder).select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "days",
            cl.log_days(d).alias("log_e"), cl.log_days(d, base="10").alias("log_10"), cl.log_days(d, base="2").alias("log_2"),
            lb.days_bucket(d).alias("bucket"),
        )
    )


_CONDITIONS = ("Normal", "Sick", "Neonatal", "Feral", "Parvo", "Other")


@registry.query(
    """with c as (select p_partkey, (['Normal', 'Sick', 'Neonatal', 'Feral', 'Parvo', 'Other'])[(p_size % 6 + 1)::INTEGER] as condition, case when p_type = 'SMALL' then 'Aggressive' end as subtype from part)
select p_partkey, case condition when 'Normal' then 'normal' when 'Sick' then 'medical_or_injured' when 'Neonatal' then 'vulnerable_life_stage' when 'Feral' then 'behavior_or_feral' when 'Parvo' then 'urgent_medical' else 'other_unknown' end as health_profile,
case when condition = 'Feral' or coalesce(subtype = 'Aggressive', false) then 'behavior_support_signal' else 'no_behavior_signal' end as behavior_support_flag from c"""
)
def descriptors(spark: SparkSession, folder: str) -> DataFrame:
    condition = F.element_at(F.array(*[F.lit(c) for c in _CONDITIONS]), (F.col("p_size") % 6 + 1).cast("int"))
    rows = read_table(spark, folder, "part").select(
        "p_partkey", condition.alias("intake_condition"), F.when(F.col("p_type") == "SMALL", "Aggressive").alias("outcome_subtype")
    )
    return lb.add_descriptors(rows).select("p_partkey", "health_profile", "behavior_support_flag")


@registry.query(
    """select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'unknown') as status, try_cast(case when o_orderkey % 3 = 0 then 'n/a' else o_totalprice::VARCHAR end as DOUBLE) as price,
(o_orderpriority = '1-URGENT')::INTEGER::DOUBLE as urgent from orders"""
)
def model_frame(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "orders").select(
        "o_orderkey",
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    return cl.model_frame(rows, ["status"], ["price", "urgent"])


@registry.query(
    """select o_orderkey, case o_orderstatus when 'F' then true when 'O' then false end as flag, o_totalprice as price, o_orderkey::VARCHAR as key from orders"""
)
def schema_casts(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "0")
    rows = read_table(spark, folder, "orders").select(
        "o_orderkey", text.alias("flag"), F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderkey").alias("key")
    )
    return with_schema(rows, {"flag": "bool", "price": "float", "key": "str"})


@registry.query(
    """select o_orderkey as order_key, o_orderstatus as status, null::DOUBLE as weight, false as is_named, 0::INTEGER as target from orders"""
)
def fixed_schema(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("Order/Key"), F.col("o_orderstatus").alias(" Status "), "o_custkey")
    named = contracts.standard_names(rows)
    schema = {"order_key": "bigint", "status": "string", "weight": "double", "is_named": "boolean", "target": "int"}
    return contracts.select_with_defaults(named, schema, {"is_named": False, "target": 0})


@registry.query(
    """select n_nationkey::BIGINT as key, n_name as name, null::DOUBLE as balance from nation union all select s_suppkey, s_name, s_acctbal from supplier"""
)
def ragged_union(spark: SparkSession, folder: str) -> DataFrame:
    nation = read_table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_name").alias("name"))
    supplier = read_table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return union_ragged([nation, supplier])


@registry.query(
    f"""with {LINES_SQL}, stays as (select * from lines where days >= 0), g as (select o_orderpriority, count(*) as n, avg(label) as r from stays group by 1)
select o_orderpriority as age_group, case o_orderpriority when '1-URGENT' then 0.5::DOUBLE else 2.0::DOUBLE end * 365.25 as age_days,
round(case o_orderpriority when '1-URGENT' then 0.5::DOUBLE else 2.0::DOUBLE end * 365.25 / 30.4375, 6) as age_months, 2024::INTEGER as intake_year, 'summer' as intake_season,
'post_covid' as covid_period, 'mixed_breed' as primary_breed, 'black_or_dark' as simplified_color_group from g"""
)
def profile_records_query(spark: SparkSession, folder: str) -> DataFrame:
    """Representative feature rows for the profiles of a cohort table."""
    from sojourn.catalog.tables import stays

    profiles = stays(spark, folder).groupBy(F.col("o_orderpriority").alias("age_group")).agg(F.count(F.lit(1)).alias("records"))
    rows = profile_records(profiles, years_by_group={"1-URGENT": 0.5}, default_years=2.0)
    return rounded(
        rows.select("age_group", "age_days", "age_months", "intake_year", "intake_season", "covid_period", "primary_breed", "simplified_color_group")
    )


def _importances(spark: SparkSession, folder: str) -> DataFrame:
    """Importance-like rows: parts stand for features, their price for the score."""
    names = ("age_days", "age_group", "intake_type", "primary_breed", "color", "is_named", "intake_month", "daily_temp_max", "p_other")
    pick = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 9 + 1).cast("int"))
    return read_table(spark, folder, "part").select(
        pick.alias("feature"), F.col("p_retailprice").alias("importance"), F.col("p_brand").alias("animal_subset"),
        F.when(F.col("p_size") > 25, "permutation").otherwise("coefficients").alias("source"),
    )


_IMP_SQL = """imp as (select (['age_days', 'age_group', 'intake_type', 'primary_breed', 'color', 'is_named', 'intake_month', 'daily_temp_max', 'p_other'])[(p_partkey % 9 + 1)::INTEGER] as feature,
p_retailprice as importance, p_brand as animal_subset, case when p_size > 25 then 'permutation' else 'coefficients' end as source from part),
fam as (select *, case feature when 'age_days' then 'age' when 'age_group' then 'age' when 'intake_type' then 'intake_circumstances' when 'primary_breed' then 'breed_appearance' when 'color' then 'color'
when 'is_named' then 'name_identity' when 'intake_month' then 'timing_seasonality' when 'daily_temp_max' then 'weather_context' else 'other' end as family from imp)"""


@registry.query(
    f"""with {_IMP_SQL} select family, round(sum(importance), 4) as sum_importance, round(avg(importance), 4) as mean_importance, count(*)::BIGINT as n_features,
(select string_agg(f, ', ' order by f) from (select distinct feature as f from fam x where x.family = fam.family)) as feature_list from fam group by 1"""
)
def family_importance(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(im.family_totals(_importances(spark, folder), "importance").drop("display_label"), 4)


@registry.query(
    f"""with {_IMP_SQL}, g as (select family, animal_subset, source, avg(importance) as m from fam where family <> 'other' group by all), o as (select family, avg(importance) as a from fam where family <> 'other' group by 1)
select family, animal_subset, source, round(m, 4) as mean_importance, round(a, 4) as overall_mean_importance from g join o using (family)"""
)
def family_importance_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(im.family_means(_importances(spark, folder), "importance"), 4)


@registry.query(
    f"""with {_IMP_SQL} select feature, round(avg(importance), 4) as importance_score from imp where regexp_matches(feature, '(?i)age_|breed') group by 1"""
)
def feature_keyword_filter(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(im.matching_features(_importances(spark, folder), ["age_", "breed"], "importance"), 4)


@registry.query(
    f"""with {_IMP_SQL}, t as (select 'classification: ' || family as item, sum(importance) as v from fam group by 1)
select 'interpretability' as section, item, 'sum_importance' as metric, round(v, 4) as value from t order by v desc, item limit 5"""
)
def family_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(im.family_evidence(im.family_totals(_importances(spark, folder), "importance"), "classification", "sum_importance"), 4)


@registry.query(
    f"""with {_IMP_SQL}, a as (select feature, avg(abs(importance - 1000)) as m, avg(importance - 1000) as s, count(*)::BIGINT as n from imp group by 1)
select feature, round(m, 4) as mean_abs_contribution, round(s, 4) as mean_contribution, n as sample_rows from a"""
)
def attribution_table(spark: SparkSession, folder: str) -> DataFrame:
    long = _importances(spark, folder).withColumn("contribution", F.col("importance") - 1000)
    return rounded(im.attribution_totals(long, "contribution"), 4)


@registry.query(
    """select case when n_name like '%1' then 'true' end as raw, case when n_name like '%1' then true end as flag, n_nationkey from nation"""
)
def strict_booleans(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.when(F.col("n_name").like("%1"), "true")
    return read_table(spark, folder, "nation").select(raw.alias("raw"), strict_boolean(raw).alias("flag"), "n_nationkey")
