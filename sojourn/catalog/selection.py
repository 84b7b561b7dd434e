"""Model comparison and selection over metric rows computed from several scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.catalog import Registry
from sojourn.catalog.scores import _auc_sql, _ece_sql
from sojourn.catalog.tables import rounded
from sojourn.operators import metrics as mx
from sojourn.operators import selection as sel
from sojourn.operators.cohorts import with_subsets
from sojourn.sources.tables import read_table

registry = Registry()

# Scores that play the part of models; the second of each pair "adds context".
MODELS = {
    "random_forest": "round(l_discount * 10, 2)",
    "boosting": "round(l_tax * 12, 2)",
    "dummy_prior": "round(l_quantity / 64, 2)",
}

_LONG_SQL = """
base as (select l_linestatus, year(l_shipdate) as y, (l_returnflag = 'R')::INTEGER as label, l_discount, l_tax, l_quantity,
                l_quantity * 2 as d1, 30 + l_quantity as d2, 10 + l_linenumber * 5 as actual from lineitem),
subs as (select 'combined' as animal_subset, * from base union all select case l_linestatus when 'O' then 'open' else 'finished' end, * from base),
long as (
""" + " union all ".join(
    f"select '{m}' as model_name, '{fs}' as feature_set, animal_subset, case when y <= 1998 then 'selection' else 'test' end as metric_split, label, "
    f"{e if fs == 'intake_time_v2' else f'round({e} * 0.5 + l_quantity / 100, 2)'} as score from subs"
    for m, e in MODELS.items()
    for fs in ("intake_time_v2", "intake_time_context_v2")
) + "), keyed as (select model_name || '/' || feature_set || '/' || animal_subset || '/' || metric_split as g, * from long)"

_METRICS_SQL = f"""{_LONG_SQL}, {_auc_sql('keyed', 'g')}, {_ece_sql('keyed', 'g')},
f as (select g as k, coalesce(2.0::DOUBLE * count(*) filter (where label = 1 and score >= 0.5)
            / nullif(2 * count(*) filter (where label = 1 and score >= 0.5) + count(*) filter (where label = 0 and score >= 0.5) + count(*) filter (where label = 1 and score < 0.5), 0), 0) as f1
      from keyed group by 1),
metric_rows as (
  select split_part(k, '/', 1) as model_name, split_part(k, '/', 2) as feature_set, split_part(k, '/', 3) as animal_subset, split_part(k, '/', 4) as metric_split,
         roc_auc, pr_auc, brier_score, expected_calibration_error, f1,
         split_part(k, '/', 1) || '-' || split_part(k, '/', 2) || '-' || split_part(k, '/', 3) as artifact_path
  from auc join ece using (k) join f using (k))"""


def _tagged(spark: SparkSession, folder: str) -> DataFrame:
    items = read_table(spark, folder, "lineitem").withColumn("y", F.year("l_shipdate"))
    subsets = with_subsets(items, "l_linestatus", {"open": "o", "finished": "f"})
    return subsets.select(
        "animal_subset",
        F.when(F.col("y") <= 1998, "selection").otherwise("test").alias("metric_split"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        "l_discount", "l_tax", "l_quantity", "l_linenumber",
    )


def metric_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Classification metrics of every model, feature set, subset and split in one job."""
    scores = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("model_name"),
                    F.lit(fs).alias("feature_set"),
                    (F.expr(e) if fs == "intake_time_v2" else F.expr(f"round({e} * 0.5 + l_quantity / 100, 2)")).alias("score"),
                )
                for m, e in MODELS.items()
                for fs in ("intake_time_v2", "intake_time_context_v2")
            ]
        )
    )
    rows = _tagged(spark, folder).select("animal_subset", "metric_split", "label", scores.alias("_m")).select(
        "animal_subset", "metric_split", "label", "_m.*"
    )
    keys = ["model_name", "feature_set", "animal_subset", "metric_split"]
    report = mx.classification_report(rows, keys, label="label", score="score")
    return report.select(
        *keys,
        "roc_auc", "pr_auc", "brier_score", "expected_calibration_error", "f1",
        F.concat_ws("-", "model_name", "feature_set", "animal_subset").alias("artifact_path"),
        F.lit("time").alias("split_strategy"),
    )


def regression_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Regression metrics of two rules for days."""
    rows = _tagged(spark, folder).withColumn("actual", 10 + F.col("l_linenumber") * 5)
    rules = F.explode(
        F.array(
            F.struct(F.lit("boosting").alias("model_name"), (F.col("l_quantity") * 2).alias("p")),
            F.struct(F.lit("ridge").alias("model_name"), (F.col("l_quantity") + 30).alias("p")),
        )
    )
    long = rows.select("animal_subset", "metric_split", "actual", rules.alias("_m")).select(
        "animal_subset", "metric_split", "actual", "_m.*"
    )
    keys = ["model_name", "animal_subset", "metric_split"]
    return mx.regression_report(long, keys, actual="actual", predicted="p", whole_units=True).select(
        *keys, "mae", "rmse", "median_absolute_error",
        F.concat_ws("-", "model_name", "animal_subset").alias("artifact_path"), F.lit("time").alias("split_strategy"),
    )


_REG_SQL = f"""{_LONG_SQL},
reg as (select 'boosting' as model_name, animal_subset, case when y <= 1998 then 'selection' else 'test' end as metric_split, abs(actual - d1) as e from subs
        union all select 'ridge', animal_subset, case when y <= 1998 then 'selection' else 'test' end, abs(actual - d2) from subs),
regm as (select model_name, animal_subset, metric_split, avg(e) as mae, sqrt(avg(e * e)) as rmse, quantile_cont(e, 0.5) as median_absolute_error from reg group by all)"""


@registry.query(
    f"""with {_METRICS_SQL} select model_name, feature_set, animal_subset, round(roc_auc, 6) as roc_auc, round(pr_auc, 6) as pr_auc, round(f1, 6) as f1,
rank() over (partition by animal_subset order by round(roc_auc, 9) desc)::INTEGER as roc_auc_rank, rank() over (partition by animal_subset order by round(pr_auc, 9) desc)::INTEGER as pr_auc_rank,
rank() over (partition by animal_subset order by round(f1, 9) desc)::INTEGER as f1_rank from metric_rows where metric_split = 'selection'"""
)
def model_ranks(spark: SparkSession, folder: str) -> DataFrame:
    rows = rounded(metric_rows(spark, folder).filter(F.col("metric_split") == "selection"), 9)
    ranked = sel.rank_models(rows, {"roc_auc": False, "pr_auc": False, "f1": False})
    return rounded(ranked).select(
        "model_name", "feature_set", "animal_subset", "roc_auc", "pr_auc", "f1", "roc_auc_rank", "pr_auc_rank", "f1_rank"
    )


_WINNERS_SQL = f"""{_METRICS_SQL}, win as (
  select * from metric_rows where metric_split = 'selection' and model_name not like '%dummy%'
  qualify row_number() over (partition by animal_subset order by round(pr_auc, 4) desc, round(brier_score, 4), round(expected_calibration_error, 4), round(roc_auc, 4) desc, model_name) = 1),
rf as (select animal_subset, max(roc_auc) as forest from metric_rows where metric_split = 'selection' and model_name = 'random_forest' group by 1)"""


@registry.query(
    f"""with {_WINNERS_SQL} select w.model_name, w.feature_set, w.animal_subset, true as selected, round(w.pr_auc, 6) as pr_auc,
printf('pr_auc %.4f, brier_score %.4f, expected_calibration_error %.4f, roc_auc %.4f', w.pr_auc, w.brier_score, w.expected_calibration_error, w.roc_auc) as criteria,
round(w.roc_auc - rf.forest, 6) as gain_over_baseline
from win w join rf using (animal_subset)"""
)
def best_classifiers(spark: SparkSession, folder: str) -> DataFrame:
    winners = sel.select_winners(metric_rows(spark, folder), classification=True, baseline="random_forest")
    return rounded(winners.select("model_name", "feature_set", "animal_subset", "selected", "pr_auc", "criteria", "gain_over_baseline"))


@registry.query(
    f"""with {_REG_SQL}, w as (select * from regm where metric_split = 'selection' qualify row_number() over (partition by animal_subset order by mae, model_name) = 1)
select model_name, animal_subset, round(mae, 6) as mae, printf('mae %.4f', mae) as criteria from w"""
)
def best_regressors(spark: SparkSession, folder: str) -> DataFrame:
    winners = sel.select_winners(regression_rows(spark, folder), classification=False)
    return rounded(winners.select("model_name", "animal_subset", "mae", "criteria"))


@registry.query(
    f"""with {_WINNERS_SQL} select w.model_name, w.feature_set, w.animal_subset, round(w.pr_auc, 6) as pr_auc, round(t.pr_auc, 6) as test_pr_auc,
round(t.roc_auc, 6) as test_roc_auc, round(t.f1, 6) as test_f1
from win w left join metric_rows t on t.metric_split = 'test' and t.model_name = w.model_name and t.feature_set = w.feature_set and t.animal_subset = w.animal_subset"""
)
def winners_on_test(spark: SparkSession, folder: str) -> DataFrame:
    rows = metric_rows(spark, folder)
    joined = sel.with_test_metrics(sel.select_winners(rows, classification=True), rows)
    return rounded(
        joined.select("model_name", "feature_set", "animal_subset", "pr_auc", "test_pr_auc", "test_roc_auc", "test_f1")
    )


@registry.query(
    f"""with {_METRICS_SQL}, bs as (select * from metric_rows where metric_split = 'test' and feature_set = 'intake_time_v2'),
cx as (select * from metric_rows where metric_split = 'test' and feature_set = 'intake_time_context_v2')
select 'classification' as task, animal_subset, model_name, 'roc_auc' as primary_metric, round(bs.roc_auc, 6) as base_score, round(cx.roc_auc, 6) as context_score,
round(cx.roc_auc - bs.roc_auc, 6) as delta, 'f1' as secondary_metric, round(bs.f1, 6) as secondary_base_score, round(cx.f1, 6) as secondary_context_score,
round(cx.f1 - bs.f1, 6) as secondary_delta, true as higher_is_better from bs join cx using (animal_subset, model_name)"""
)
def context_delta(spark: SparkSession, folder: str) -> DataFrame:
    rows = metric_rows(spark, folder).filter(F.col("metric_split") == "test")
    return rounded(
        sel.context_deltas(
            rows, task="classification", primary="roc_auc", secondary="f1", higher_is_better=True,
            has_context=F.contains(F.col("feature_set"), F.lit("context")),
        )
    )


@registry.query(
    f"""with {_METRICS_SQL} select 'classification' as task, animal_subset, model_name, 'pr_auc' as primary_metric, round(pr_auc, 6) as score from metric_rows
where metric_split = 'test' qualify row_number() over (partition by animal_subset order by pr_auc desc, roc_auc desc, model_name) = 1"""
)
def best_model_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = metric_rows(spark, folder).filter(F.col("metric_split") == "test")
    return rounded(sel.best_rows(rows, task="classification", primary="pr_auc", ascending=False, then="roc_auc"))


@registry.query(
    f"""with {_METRICS_SQL} select 'classification' as task, animal_subset, model_name, 'pr_auc' as primary_metric, round(pr_auc, 6) as score from metric_rows
where metric_split = 'test' and animal_subset = 'combined' order by pr_auc desc, roc_auc desc, model_name limit 1"""
)
def overview_model(spark: SparkSession, folder: str) -> DataFrame:
    return sel.overview_row(best_model_rows(spark, folder), "classification")


@registry.query(
    f"""with {_METRICS_SQL}, c as (select * from metric_rows where metric_split = 'test' qualify row_number() over (partition by animal_subset order by pr_auc desc, roc_auc desc, model_name) = 1),
{_REG_SQL[_REG_SQL.index('reg as'):]},
r as (select * from regm where metric_split = 'test' qualify row_number() over (partition by animal_subset order by mae, model_name) = 1)
select 'model_choice' as section, animal_subset || ' classification' as item, model_name, 'pr_auc' as metric, round(pr_auc, 6) as value from c
union all select 'model_choice', animal_subset || ' regression', model_name, 'mae', round(mae, 6) from r"""
)
def model_evidence(spark: SparkSession, folder: str) -> DataFrame:
    cls = metric_rows(spark, folder).filter(F.col("metric_split") == "test")
    reg = regression_rows(spark, folder).filter(F.col("metric_split") == "test")
    return rounded(sel.model_evidence(cls, reg))
