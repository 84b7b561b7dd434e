"""Splits, folds, samples, windows and fitted encoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.catalog import Registry
from sojourn.catalog.tables import LINES_SQL, lines, rounded
from sojourn.functions.clean import recency_weight
from sojourn.operators import encoders as en
from sojourn.operators import splits as sp
from sojourn.sources.tables import read_table

registry = Registry()

PERIODS = sp.Periods((1995, 1998), (1999, 1999), (2000, 2000), (2001, 2001))
_ORDERS_SQL = "o as (select *, year(o_orderdate)::INTEGER as yr, (o_orderpriority in ('1-URGENT', '2-HIGH'))::INTEGER as label from orders)"


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").withColumns(
        {"yr": F.year("o_orderdate"), "label": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")}
    )


def _share_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '42', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@registry.query(
    f"""with {_ORDERS_SQL} select o_orderkey, yr, case when yr <= 1998 then 'train' when yr = 1999 then 'calibration' when yr = 2000 then 'selection' else 'test' end as split,
case when yr <= 1998 then least(greatest(1 + 0.5::DOUBLE * (yr - 1995) / 3, 1), 1.5) end as sample_weight from o where yr between 1995 and 2001"""
)
def time_split(spark: SparkSession, folder: str) -> DataFrame:
    out = sp.time_split(_orders(spark, folder), year="yr", target="label", periods=PERIODS)
    return out.select("o_orderkey", "yr", "split", "sample_weight")


@registry.query(
    f"with {_ORDERS_SQL} select o_orderkey, round(case when yr is null then 1 else least(greatest(1 + 0.5::DOUBLE * (yr - 1996) / 4, 1), 1.5) end, 6) as weight from o"
)
def recency_weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_orders(spark, folder).select("o_orderkey", recency_weight(F.col("yr"), 1996, 2000).alias("weight")))


@registry.query(f"with {_ORDERS_SQL} select o_orderkey, label from o where lower(o_orderstatus) = 'f'")
def subset_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = sp.subset_rows(_orders(spark, folder), "finished", entity_type="o_orderstatus", kinds={"finished": "f", "open": "o"})
    return rows.select("o_orderkey", "label")


@registry.query(
    f"""with {_ORDERS_SQL}, h as (select o_orderkey, {_share_sql('o_orderkey')} as u from o)
select o_orderkey, case when u < 0.2 then 'test' when u < 0.28 then 'calibration' when u < 0.36 then 'selection' else 'train' end as split from h"""
)
def random_split(spark: SparkSession, folder: str) -> DataFrame:
    return sp.random_split(_orders(spark, folder), key=["o_orderkey"]).select("o_orderkey", "split")


@registry.query(
    f"with {_ORDERS_SQL} select o_orderkey, label from o where {_share_sql('label', 'o_orderkey')} < 5000::DOUBLE / (select count(*) from o)"
)
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = sp.stratified_sample(_orders(spark, folder), classes="label", key=["o_orderkey"], max_rows=5000)
    return rows.select("o_orderkey", "label")


@registry.query(f"with {_ORDERS_SQL} select o_orderkey, floor({_share_sql('label', 'o_orderkey')} * 5)::INTEGER as fold from o")
def stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    return sp.folds(_orders(spark, folder), key=["o_orderkey"], k=5, classes="label").select("o_orderkey", "fold")


@registry.query(
    """with p as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as position, count(*) over () as n from orders)
select o_orderkey, position::BIGINT as position, case when position < n - 3 * (n // 4) then 0 else (position - (n - 3 * (n // 4))) // (n // 4) + 1 end::INTEGER as block from p"""
)
def expanding_folds(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return sp.expanding_folds(rows, ts="o_orderdate", tie="o_orderkey", k=3).select("o_orderkey", "position", "block")


@registry.query(
    f"""with {_ORDERS_SQL}, y as (select o_orderstatus, yr, count(*) as n from o group by all), b as (select o_orderstatus, min(yr) as f, sum(n)::BIGINT as e from y group by 1),
w as (select b.*, t from b cross join (select distinct yr as t from o)), s as (select *, case when greatest(f, 1995) > t - 1 then f else greatest(f, 1995) end as start from w),
c as (select s.o_orderstatus, t as test_year, start as train_start_year, e as eligible_target_count, coalesce(sum(n) filter (where yr between start and t - 1), 0)::BIGINT as train_rows, coalesce(sum(n) filter (where yr = t), 0)::BIGINT as test_rows
from s join y on y.o_orderstatus = s.o_orderstatus group by all)
select *, test_year - 1 as train_end_year, train_start_year || '-' || (test_year - 1) as train_years,
case when train_rows = 0 then 'Empty train set' when train_rows < 10 or test_rows < 10 then 'Insufficient data (<10 rows)' end as skip_reason,
case when train_rows < 10 or test_rows < 10 then 'SKIPPED' else 'READY' end as status from c where test_rows > 0"""
)
def backtest_windows(spark: SparkSession, folder: str) -> DataFrame:
    return sp.backtest_windows(
        _orders(spark, folder), year="yr", target="label", subset="o_orderstatus", first_year=1995
    )


@registry.query(
    f"""with {_ORDERS_SQL}, s as (select * from (values ('full_history', 1995, 2000, false), ('recent_5yr', 1996, 2000, false), ('recent_3yr', 1998, 2000, false), ('recency_weighted', 1995, 2000, true)) t(strategy, a, b, w))
select strategy, yr, count(*)::BIGINT as rows, round(sum(case when w then least(greatest(1 + 0.5::DOUBLE * (yr - a) / (b - a), 1), 1.5) else 1 end), 6) as total_weight from o join s on yr between a and b group by 1, 2"""
)
def recency_strategies(spark: SparkSession, folder: str) -> DataFrame:
    strategies = sp.recency_strategies(2001, first_year=1995, gap=1)
    tagged = sp.strategy_rows(_orders(spark, folder), strategies, year="yr")
    return rounded(tagged.groupBy("strategy", "yr").agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("total_weight")))


_ENC_SQL = f"{LINES_SQL}, t as (select l.*, p_brand, case when p_size > 3 then p_size end as p_size from lines l join part on p_partkey = l_partkey), f as (select *, (l_orderkey % 5)::INTEGER as fold from t)"


def _encoder_rows(spark: SparkSession, folder: str) -> DataFrame:
    part = read_table(spark, folder, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 3, F.col("p_size")).alias("p_size"))
    return lines(spark, folder).join(part, F.col("p_partkey") == F.col("l_partkey")).withColumn(
        "fold", F.pmod("l_orderkey", F.lit(5)).cast("int")
    )


@registry.query(
    f"""with {_ENC_SQL}, c as (select p_brand, fold, sum(label) as s, count(*) as n from f group by all), a as (select fold, sum(s) as s, sum(n) as n from c group by 1),
e as (select c.p_brand, c.fold, (select (sum(x.s) + 10 * p.m) / (sum(x.n) + 10) from c x where x.p_brand = c.p_brand and x.fold <> c.fold) as encoded
from c join (select a.fold, (select sum(y.s)::DOUBLE / sum(y.n) from a y where y.fold <> a.fold) as m from a) p on p.fold = c.fold)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(encoded, 6) as encoded from f join e using (p_brand, fold)"""
)
def target_encode_oof(spark: SparkSession, folder: str) -> DataFrame:
    out = en.encode_out_of_fold(_encoder_rows(spark, folder), "p_brand", "label", "fold")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "encoded"))


@registry.query(
    f"""with {_ENC_SQL}, tr as (select * from t where ship_year <= 1998 and p_brand <> 'Brand#1'), m as (select p_brand, (sum(label) + 10 * (select avg(label) from tr)) / (count(*) + 10) as e from tr group by 1)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(e, 6) as encoded from t left join m using (p_brand) where ship_year > 1998"""
)
def target_encode_new_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _encoder_rows(spark, folder)
    means = en.target_means(rows.filter((F.col("ship_year") <= 1998) & (F.col("p_brand") != "Brand#1")), "p_brand", "label")
    out = en.encode_target(rows.filter(F.col("ship_year") > 1998), means, "p_brand")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "encoded"))


@registry.query(
    f"""with {_ENC_SQL}, m as (select p_brand, avg(label) as e from t where ship_year <= 1998 and p_brand <> 'Brand#1' group by 1)
select p_brand, round(coalesce(e, (select avg(e) from m)), 6) as encoded, count(*)::BIGINT as rows from t left join m using (p_brand) where ship_year > 1998 group by 1, 2"""
)
def mean_encode(spark: SparkSession, folder: str) -> DataFrame:
    rows = _encoder_rows(spark, folder)
    train = rows.filter((F.col("ship_year") <= 1998) & (F.col("p_brand") != "Brand#1"))
    out = en.mean_encoding(train, rows.filter(F.col("ship_year") > 1998), "p_brand", "label")
    return out.groupBy("p_brand", F.round("encoded", 6).alias("encoded")).agg(F.count(F.lit(1)).alias("rows"))


@registry.query(
    f"""with {_ENC_SQL}, m as (select quantile_cont(p_size::DOUBLE, 0.5) as md from t where ship_year <= 1998), f2 as (select coalesce(p_size, md)::DOUBLE as v from t cross join m where ship_year <= 1998),
p as (select md, avg(v) as mu, stddev_pop(v) as sd from f2 cross join m group by md)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((coalesce(p_size, md) - mu) / sd, 6) as p_size from t cross join p where ship_year > 1998"""
)
def numeric_preparation(spark: SparkSession, folder: str) -> DataFrame:
    rows = _encoder_rows(spark, folder)
    fit = en.numeric_fit(rows.filter(F.col("ship_year") <= 1998), ["p_size"])
    out = en.numeric_apply(rows.filter(F.col("ship_year") > 1998), fit, ["p_size"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_size"))


@registry.query(
    """with n as (select p_brand, count(*) as n from part group by 1), md as (select p_brand as mode from n order by n desc, p_brand desc limit 1)
select p_partkey, case when (select n from n where n.p_brand = x.v) < 80 then '_rare' else x.v end as p_brand from (select p_partkey, case when p_type = 'SMALL' then (select mode from md) else p_brand end as v from part) x"""
)
def rare_levels(spark: SparkSession, folder: str) -> DataFrame:
    part = read_table(spark, folder, "part").select("p_partkey", "p_type", "p_brand")
    counts = en.level_counts(part, ["p_brand"])
    gaps = part.withColumn("p_brand", F.when(F.col("p_type") != "SMALL", F.col("p_brand")))
    return en.apply_levels(gaps, en.level_map(counts, 80), "p_brand", en.level_modes(counts)["p_brand"]).select("p_partkey", "p_brand")


@registry.query(
    """with c as (select p_type, dense_rank() over (order by p_type) - 1 as code from (select distinct p_type from part where p_size <= 25 and p_type <> 'SMALL'))
select p_partkey, coalesce(code, -1)::INTEGER as p_type from part left join c using (p_type)"""
)
def ordinal_codes(spark: SparkSession, folder: str) -> DataFrame:
    part = read_table(spark, folder, "part")
    codes = en.ordinal_map(en.level_counts(part.filter((F.col("p_size") <= 25) & (F.col("p_type") != "SMALL")), ["p_type"]))
    return en.ordinal_encode(part.select("p_partkey", "p_type"), codes, "p_type")
