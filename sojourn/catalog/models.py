"""Training, calibration, ensembles, search, backtests and explanations over order lines.

Labels carry a planted signal: quantity, discount and priority raise the chance of the positive
class, the rest is a hash of the line's key. ``regression_models`` uses the library's defaults, which are the
full-size models; the other queries use small ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.catalog import Registry
from sojourn.catalog.splits import PERIODS
from sojourn.catalog.tables import rounded
from sojourn.functions.labels import visibility_from_history
from sojourn.operators import metrics as mx
from sojourn.operators import splits as sp
from sojourn.operators.similar import similar_cases
from sojourn.plans import calibration as cal
from sojourn.plans import experiments as ex
from sojourn.plans import explain
from sojourn.plans import training as tr
from sojourn.session import stored
from sojourn.sources.tables import read_table

registry = Registry()

KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
FEATURES = tr.Features(
    numeric=("l_quantity", "l_discount", "l_tax", "p_size"),
    categorical=("o_orderpriority", "o_orderstatus", "p_brand"),
    key=KEY,
    label="label",
)
DAYS = FEATURES.with_label("days")

SMALL_TREES = {"numTrees": 8, "maxDepth": 4}
SMALL_BOOST = {"maxIter": 6, "maxDepth": 3}


def _subsets():
    return {"combined": F.lit(True), "open": F.col("l_linestatus") == "O", "finished": F.col("l_linestatus") == "F"}


def model_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    part = read_table(spark, folder, "part").select("p_partkey", "p_brand", "p_size")
    items = read_table(spark, folder, "lineitem")
    noise = sp.hash_share([F.col(k) for k in KEY], 7)
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("double")
    signal = F.col("l_quantity") / 50 + F.col("l_discount") * 4 + 0.4 * urgent + noise
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            *KEY, "l_quantity", "l_discount", "l_tax", "p_size", "p_brand", "o_orderpriority", "o_orderstatus", "l_linestatus",
            "o_custkey", "o_orderdate",
            F.year("o_orderdate").alias("yr"),
            (signal > 1.4).cast("int").alias("label"),
            (5.0 + F.col("l_quantity") * 0.6 + 8 * urgent + noise * 20).alias("days"),
        )
    )


def split_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sp.time_split(model_rows(spark, folder), year="yr", target="label", periods=PERIODS)


def split_table(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows for queries that read them several times: joined once and stored."""
    return stored(split_rows(spark, folder), "split-table")


@registry.query()
def baseline_models(spark: SparkSession, folder: str) -> DataFrame:
    models = [tr.dummy_classifier(), tr.logistic(maxIter=15), tr.forest_classifier(**SMALL_TREES)]
    return rounded(tr.train_models(split_rows(spark, folder), FEATURES, models, _subsets(), task=tr.CLASSIFICATION)[0])


@registry.query()
def regression_models(spark: SparkSession, folder: str) -> DataFrame:
    models = [tr.dummy_regressor(), tr.ridge(), tr.forest_regressor(), tr.boosting_regressor()]
    return rounded(
        tr.train_models(
            split_rows(spark, folder), DAYS, models, _subsets(), task=tr.REGRESSION, winsor=(0.01, 0.99)
        )[0]
    )


@registry.query()
def boosting_models(spark: SparkSession, folder: str) -> DataFrame:
    models = [tr.boosting_classifier(**SMALL_BOOST), tr.target_boosting_classifier(**SMALL_BOOST)]
    return rounded(
        tr.train_models(split_rows(spark, folder), FEATURES, models, _subsets(), task=tr.CLASSIFICATION)[0]
    )


@registry.query()
def adopted_regression(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        tr.adopted_regression(
            split_rows(spark, folder), DAYS, tr.target_boosting_regressor(**SMALL_BOOST), adopted="label",
            subsets=_subsets(),
        )
    )


def _fitted_forest(rows: DataFrame) -> tr.Fitted:
    return tr.fit(tr.forest_classifier(**SMALL_TREES), rows.filter(F.col("split") == "train"), FEATURES, ready=True)


@registry.query()
def calibrated_models(spark: SparkSession, folder: str) -> DataFrame:
    """A balanced forest before and after both calibrations, fitted on the calibration year only."""
    rows = split_table(spark, folder)
    subsets = _subsets()
    return rounded(cal.calibrated_reports(rows, {n: _fitted_forest(rows.filter(c)) for n, c in subsets.items()}, subsets, label="label"))


@registry.query(
    """with s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_returnflag = 'R')::INTEGER as label, l_discount * 10 as a, l_quantity / 50 as b, l_tax * 12 as c from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((a + b + c) / 3, 6) as equal_weights, round((2 * a + b + c) / 4, 6) as own_weights from s"""
)
def weighted_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "lineitem").select(
        *KEY, (F.col("l_discount") * 10).alias("a"), (F.col("l_quantity") / 50).alias("b"), (F.col("l_tax") * 12).alias("c")
    )
    return rounded(
        rows.select(
            *KEY,
            cal.weighted_score(["a", "b", "c"]).alias("equal_weights"),
            cal.weighted_score(["a", "b", "c"], {"a": 2.0, "b": 1.0, "c": 1.0}).alias("own_weights"),
        )
    )


@registry.query()
def stacked_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    rows = split_table(spark, folder)
    bases = [tr.logistic(maxIter=10), tr.forest_classifier(**SMALL_TREES)]
    stacked = cal.stack(rows.filter(F.col("split") == "train"), FEATURES, bases, k=2)
    scored = stacked.score(rows.filter(F.col("split") == "test")).select("label", "score", F.lit("stacked").alias("model_name"))
    return rounded(tr.evaluate(scored, ["model_name"], tr.CLASSIFICATION))


@registry.query()
def parameter_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = split_rows(spark, folder).filter(F.col("split") == "train").withColumn(
        "_tie", F.xxhash64(*KEY)
    )
    windows = ex.search_windows(rows, FEATURES, ["label", "days"], ts="o_orderdate", tie="_tie", k=FOLDS)
    return rounded(reduce(DataFrame.unionByName, [_study(windows, *study) for study in STUDIES]))


# name, model, label, space: one search each
STUDIES = (
    ("boosting", tr.boosting_classifier(maxIter=6), "label", {"maxDepth": (2, 4), "stepSize": (0.05, 0.3, "log")}),
    ("forest", tr.forest_classifier(numTrees=12), "label", {"maxDepth": (2, 6), "minInstancesPerNode": (5, 50)}),
    ("boosting_days", tr.boosting_regressor(maxIter=6), "days", {"maxDepth": (2, 4), "stepSize": (0.05, 0.3, "log")}),
    ("forest_days", tr.forest_regressor(numTrees=12), "days", {"maxDepth": (2, 6), "minInstancesPerNode": (5, 50)}),
)
TRIALS, FOLDS = 5, 3


def _study(windows: list, name: str, spec: tr.Model, label: str, space: dict) -> DataFrame:
    found = ex.search(windows, label, spec, ex.draw_params(space, TRIALS))
    best = ex.best_params(found, spec.task).select("trial", F.lit(True).alias("is_best"))
    return found.join(best, "trial", "left").withColumns({"study": F.lit(name), "is_best": F.coalesce("is_best", F.lit(False))})


@registry.query()
def backtest_runs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        ex.backtest(
            model_rows(spark, folder), FEATURES, [tr.forest_classifier(**SMALL_TREES)], year="yr", subset="l_linestatus",
            cluster="o_custkey", first_year=1995, replicates=50,
        )
    )


@registry.query()
def recency_runs(spark: SparkSession, folder: str) -> DataFrame:
    strategies = sp.recency_strategies(2001, first_year=1995, gap=1)
    return rounded(
        ex.recency_comparison(
            model_rows(spark, folder), FEATURES, tr.logistic(maxIter=10), tr.ridge(maxIter=10), strategies, _subsets(),
            days="days", year="yr", test_years=(2001, 2001), cluster="o_custkey", replicates=50,
        )
    )


@registry.query()
def family_ablation(spark: SparkSession, folder: str) -> DataFrame:
    families = {
        "intake_context": ["o_orderpriority", "o_orderstatus"],
        "appearance": ["p_brand", "p_size"],
        "age": ["l_quantity"],
    }
    return rounded(
        ex.family_ablation(
            split_rows(spark, folder), FEATURES, tr.logistic(maxIter=8), families, _subsets(),
            context="intake_context", appearance="appearance", age="age",
        )
    )


@registry.query(
    """with s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 12 as p, case when l_quantity = 13 then null else l_quantity / 6 - 0.5 end as raw from lineitem),
d as (select *, exp(raw) - 1 as days from s), e as (select *, case when p < 0 or p > 1 then 'INVALID_PROB' when days is null or days < 0 then 'INVALID_DAYS' when days > 4000 then 'OUT_OF_BOUNDS' end as error_code from d)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, error_code is null as ok, error_code, case when error_code is null then round(p, 6) end as adoption_probability,
case when error_code is null then round(days, 4) end as predicted_days_to_outcome,
case when error_code is null then case when days <= 7 then '0-7d' when days <= 30 then '8-30d' when days <= 60 then '31-60d' when days <= 90 then '61-90d' else '90+d' end end as los_bucket from e"""
)
def batch_scoring(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "lineitem").select(
        *KEY, (F.col("l_discount") * 12).alias("p"), F.when(F.col("l_quantity") != 13, F.col("l_quantity") / 6 - 0.5).alias("raw")
    )
    out = cal.bounded_predictions(rows, probability="p", raw_days="raw", transform="expm1").drop("p", "raw")
    return out.withColumns(
        {
            "adoption_probability": F.round("adoption_probability", 6),
            "predicted_days_to_outcome": F.round("predicted_days_to_outcome", 4),
        }
    )


@registry.query()
def coefficients(spark: SparkSession, folder: str) -> DataFrame:
    train = split_rows(spark, folder).filter(F.col("split") == "train")
    return rounded(explain.coefficient_table(tr.fit(tr.logistic(maxIter=10), train, FEATURES), train))


@registry.query()
def tree_importances(spark: SparkSession, folder: str) -> DataFrame:
    rows = split_table(spark, folder)
    return rounded(explain.tree_importance_table(_fitted_forest(rows), rows))


@registry.query()
def permutation_importance(spark: SparkSession, folder: str) -> DataFrame:
    rows = split_table(spark, folder)
    validation = rows.filter(F.col("split").isin("calibration", "selection"))
    return rounded(explain.permutation_importance(_fitted_forest(rows), validation, repeats=5))


@registry.query()
def local_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Reasons for every test row."""
    rows = split_table(spark, folder)
    model = _fitted_forest(rows)
    base = explain.baselines(rows.filter(F.col("split") == "train"), FEATURES)
    found = explain.contributions(model, rows.filter(F.col("split") == "test"), base)
    return rounded(explain.local_reasons(found, list(KEY), top=3))


@registry.query()
def profile_journeys(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of the data with their prediction, similar cases and reasons."""
    rows = split_table(spark, folder)
    model = _fitted_forest(rows)
    train = rows.filter(F.col("split") == "train")
    base = explain.baselines(train, FEATURES)
    named = rows.withColumn("profile_id", F.concat_ws(" | ", "o_orderpriority", "o_orderstatus"))
    profiles = named.groupBy("profile_id", "o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("records"), F.avg("label").alias("observed_rate")
    )
    filled = profiles.select(
        "profile_id", "o_orderpriority", "o_orderstatus",
        *[F.lit(base[c]).alias(c) for c in (*FEATURES.numeric, "p_brand")],
    )
    by_profile = tr.Fitted(model.spec, tr.Features(FEATURES.numeric, FEATURES.categorical, ("profile_id",), "label"), model.preparation, model.model)
    scored = by_profile.score(filled).select("profile_id", F.col("score").alias("predicted_adoption_probability"))
    reasons = explain.local_reasons(explain.contributions(by_profile, filled, base), ["profile_id"], top=3)
    history = train.withColumn("end_type", F.when(F.col("label") == 1, "Adoption").otherwise("Transfer"))
    tiers = (("exact visible profile", ("o_orderpriority", "o_orderstatus")), ("coarse", ("o_orderstatus",)))
    similar = similar_cases(
        history, filled, profile_id="profile_id", tiers=tiers, label="label", days="days", end_type="end_type",
        end_types={"transfer": "Transfer"},
    ).withColumn("median_days", F.col("median_days_to_outcome"))
    out = explain.journeys(
        profiles, scored.join(similar.select("profile_id", "median_days"), "profile_id"), similar, reasons, profile_id="profile_id",
        visibility=visibility_from_history(F.col("predicted_adoption_probability") * 100, F.col("median_days")),
    )
    return rounded(out.drop("o_orderpriority", "o_orderstatus"))


@registry.query()
def explanation_examples(spark: SparkSession, folder: str) -> DataFrame:
    return explain.explanation_examples(profile_journeys(spark, folder), profile_id="profile_id")


@registry.query()
def drift_of_model(spark: SparkSession, folder: str) -> DataFrame:
    """One forest scored on successive years."""
    rows = model_rows(spark, folder)
    model = tr.fit(tr.forest_classifier(**SMALL_TREES), rows.filter(F.col("yr") <= 1996), FEATURES)
    return rounded(mx.drift_by_period(model.score(rows.filter(F.col("yr") > 1996)), "yr", label="label", score="score"))


# --- models whose result SQL can state -------------------------------------------------------

_MODEL_SQL = """m as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, p_size, p_brand, o_orderpriority, year(o_orderdate)::INTEGER as yr,
  (l_returnflag = 'R')::INTEGER as returned, date_diff('day', o_orderdate, l_shipdate)::DOUBLE as days
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
train as (select * from m where yr <= 1998), test as (select * from m where yr = 2001)"""
PLAIN = tr.Features(numeric=("l_quantity",), categorical=(), key=KEY, label="days")


def _plain_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    part = read_table(spark, folder, "part").select("p_partkey", "p_brand", "p_size")
    items = read_table(spark, folder, "lineitem")
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            *KEY, "l_quantity", "l_discount", "p_size", "p_brand", "o_orderpriority", F.year("o_orderdate").alias("yr"),
            (F.col("l_returnflag") == "R").cast("int").alias("returned"),
            F.datediff("l_shipdate", "o_orderdate").cast("double").alias("days"),
        )
    )


@registry.query(
    f"""with {_MODEL_SQL}, c as (select (avg(returned) > 0.5)::INTEGER::DOUBLE as mode, quantile_cont(days, 0.5) as middle from train)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, mode as most_frequent, middle as median_days from test cross join c"""
)
def dummy_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The constant models: most frequent class and median."""
    # three reads of one stored join
    rows = stored(_plain_rows(spark, folder).select(*KEY, "returned", "days", "yr").filter("yr <= 1998 or yr = 2001"), "plain-rows")
    train, test = rows.filter("yr <= 1998"), rows.filter("yr = 2001")
    classes = tr.fit(tr.dummy_classifier(), train, PLAIN.with_label("returned"), ready=True).score(test).withColumnRenamed("score", "most_frequent")
    return tr.fit(tr.dummy_regressor(), train, PLAIN, ready=True).score(classes).select(*KEY, "most_frequent", F.col("score").alias("median_days"))


@registry.query(
    f"""with {_MODEL_SQL}, c as (select regr_slope(days, l_quantity) as a, regr_intercept(days, l_quantity) as b from train)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(a * l_quantity + b, 4) as score from test cross join c"""
)
def one_feature_regression(spark: SparkSession, folder: str) -> DataFrame:
    """Least squares on one number: imputing, scaling and fitting end to end."""
    rows = _plain_rows(spark, folder)
    model = tr.fit(tr.ridge(regParam=0.0), rows.filter("yr <= 1998"), PLAIN)
    return model.score(rows.filter("yr = 2001")).select(*KEY, F.round("score", 4).alias("score"))


@registry.query(
    f"""with {_MODEL_SQL}, c as (select regr_slope(days, l_quantity) * stddev_samp(l_quantity) as a from train)
select 'l_quantity' as feature, round(a, 4) as coefficient, round(abs(a), 4) as abs_coefficient from c"""
)
def one_feature_coefficient(spark: SparkSession, folder: str) -> DataFrame:
    train = _plain_rows(spark, folder).filter("yr <= 1998")
    table = explain.coefficient_table(tr.fit(tr.ridge(regParam=0.0), train, PLAIN), train)
    return rounded(table, 4)


@registry.query(
    f"""with {_MODEL_SQL}, n as (select returned, count(*) as n from train group by 1)
select returned, round((select sum(n) from n) / (2.0::DOUBLE * n.n), 9) as weight, n.n::BIGINT as rows from n"""
)
def balanced_weights(spark: SparkSession, folder: str) -> DataFrame:
    train = _plain_rows(spark, folder).filter("yr <= 1998")
    weight = F.round(tr.class_weights(train, "returned"), 9).alias("weight")
    return train.groupBy("returned", weight).agg(F.count(F.lit(1)).alias("rows")).select("returned", "weight", "rows")


@registry.query(
    f"""with {_MODEL_SQL}, c as (select quantile_cont(l_quantity, 0.5) as q, quantile_cont(l_discount, 0.5) as d, quantile_cont(p_size::DOUBLE, 0.5) as s from train),
n as (select o_orderpriority as p, count(*) as n from train group by 1), o as (select p as mode from n order by n desc, p desc limit 1),
k as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest([
  {{'feature': 'l_quantity', 'value': l_quantity, 'c': (l_quantity - q) * 0.02::DOUBLE}}, {{'feature': 'l_discount', 'value': l_discount, 'c': (l_discount - d) * -3}},
  {{'feature': 'p_size', 'value': p_size, 'c': (p_size - s) * 0.001::DOUBLE}},
  {{'feature': 'o_orderpriority', 'value': null, 'c': (case when o_orderpriority = '1-URGENT' then 0.3::DOUBLE else 0 end) - (case when mode = '1-URGENT' then 0.3::DOUBLE else 0 end)}}]) as x from test cross join c cross join o),
r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, x.feature as feature, round(x.c, 6) as contribution from k),
g as (select *, row_number() over (partition by l_orderkey, l_linenumber, l_partkey, l_suppkey order by abs(contribution) desc, feature) as i from r)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, feature, contribution, abs(contribution) as abs_contribution,
case when contribution > 0 then 'raises prediction' else 'lowers prediction' end as association from g where i <= 3"""
)
def reasons_of_formula(spark: SparkSession, folder: str) -> DataFrame:
    """Reasons for every test row of a score that is a formula of four features."""
    rows = _plain_rows(spark, folder)
    features = tr.Features(("l_quantity", "l_discount", "p_size"), ("o_orderpriority",), KEY, "returned")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 0.3).otherwise(0.0)
    score = F.col("l_quantity") * 0.02 + F.col("l_discount") * -3 + F.col("p_size") * 0.001 + urgent
    model = tr.Formula(tr.logistic(), features, score)
    base = explain.baselines(rows.filter("yr <= 1998"), features)
    found = explain.contributions(model, rows.filter("yr = 2001"), base, digits=6)
    return explain.local_reasons(found, list(KEY), top=3).drop("value")


def _round_sql(number: int) -> str:
    """One Feistel round of ``shuffled_place`` on the columns a (base), l, r."""
    return f"(l{number} + ((((r{number} + (k * 4 + {number + 1}) * 7919) % 2147483647 * 48271) % 2147483647 * 69621) % 2147483647)) % a as r{number + 1}, r{number} as l{number + 1}"


_SHUFFLE_SQL = ", ".join(_round_sql(i) for i in range(4))


@registry.query(
    f"""with recursive {_MODEL_SQL},
s as (select *, 40 + l_quantity * 2 - l_discount * 100 as own, row_number() over (order by ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15))::BIGINT) - 1 as p from test),
n as (select count(*)::BIGINT as n, ceil(sqrt(count(*)::DOUBLE))::BIGINT as a from s),
w as (
  select p as p, k, x, n, a from (select p, k, n, a, l4 * a + r4 as x from (select *, {_SHUFFLE_SQL} from (select p, k, n, a, p // a as l0, p % a as r0 from s, n, (select unnest(range(5))::BIGINT as k))))
  union all
  select p, k, l4 * a + r4 as x, n, a from (select *, {_SHUFFLE_SQL} from (select p, k, n, a, x // a as l0, x % a as r0 from w where x >= n))),
pairs as (select s.days, s.own, w.k, s.l_quantity, s.l_discount, o.l_quantity as other_quantity, o.l_discount as other_discount from w join s using (p) join s o on o.p = w.x where w.x < w.n),
base as (select avg(abs(days - own)) as m from s),
moved as (select 'l_quantity' as feature, k, avg(abs(days - (40 + other_quantity * 2 - l_discount * 100))) - (select m from base) as d from pairs group by k
  union all select 'l_discount', k, avg(abs(days - (40 + l_quantity * 2 - other_discount * 100))) - (select m from base) from pairs group by k)
select feature, round(avg(d), 6) as importance_mean, round(stddev_pop(d), 6) as importance_std from moved group by feature"""
)
def permutation_of_formula(spark: SparkSession, folder: str) -> DataFrame:
    """Five shuffles of two features of a formula, over all test rows; SQL walks the same bijection."""
    rows = _plain_rows(spark, folder).filter("yr = 2001")
    features = tr.Features(("l_quantity", "l_discount"), (), KEY, "days")
    model = tr.Formula(tr.ridge(), features, 40 + F.col("l_quantity") * 2 - F.col("l_discount") * 100)
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in KEY]))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    table = explain.permutation_importance(model, rows, repeats=5, number=number)
    return table.select("feature", F.round("importance_mean", 6).alias("importance_mean"), F.round("importance_std", 6).alias("importance_std"))
