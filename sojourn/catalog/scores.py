"""Metrics, thresholds, calibration, reliability and bootstrap over scored lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.catalog import Registry
from sojourn.catalog.tables import SCORED_SQL, rounded, scored
from sojourn.operators import bootstrap as bs
from sojourn.operators import metrics as mx
from sojourn.operators.cohorts import nearest_row, slice_view
from sojourn.operators.isotonic import isotonic_values, pooled_blocks
from sojourn.operators.skew import exact_quantiles
from sojourn.sources.tables import read_table

registry = Registry()

COHORTS = ("l_linestatus", "o_orderstatus", "o_orderpriority", "ship_year")
_COLS = {"label": "label", "score": "score", "predicted": "predicted"}


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Quality labels scored by text length: the score hardly repeats."""
    docs = read_table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    labels = read_table(spark, folder, "labels")
    score = F.col("n_chars") / (F.col("n_chars") + 2000.0)
    return labels.join(docs, "doc_id").select(
        "doc_id", "lang", F.col("quality").alias("label"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted")
    )


_DOCS_SQL = """
docs as (select doc_id, lang, quality as label, n_chars / (n_chars + 2000.0::DOUBLE) as score,
                (n_chars / (n_chars + 2000.0::DOUBLE) >= 0.5)::INTEGER as predicted from labels join documents using (doc_id))"""


def _confusion_sql(source: str, key: str) -> str:
    return f"""
c as (select {key} as k, count(*) filter (where label = 0 and predicted = 0)::BIGINT as tn, count(*) filter (where label = 0 and predicted = 1)::BIGINT as fp,
             count(*) filter (where label = 1 and predicted = 0)::BIGINT as fn, count(*) filter (where label = 1 and predicted = 1)::BIGINT as tp
      from {source} group by 1)"""


_CONFUSION_OUT = """tn, fp, fn, tp, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) as accuracy,
round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) as recall,
round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1"""


def _auc_sql(source: str, key: str) -> str:
    """Area by comparing every positive with every negative score, precision by definition."""
    return f"""
h as (select {key} as k, score, sum(label)::BIGINT as p, count(*) - sum(label)::BIGINT as n from {source} group by 1, 2),
w as (select a.k, sum(a.p * b.n * case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end)::DOUBLE as wins
      from h a join h b on a.k = b.k group by 1),
q as (select k, score, p, sum(p) over o as cp, sum(p + n) over o as cn from h window o as (partition by k order by score desc)),
t as (select k, sum(p)::DOUBLE as p, sum(n)::DOUBLE as n from h group by 1),
auc as (select t.k, w.wins / nullif(t.p * t.n, 0) as roc_auc,
               case when t.p > 0 and t.n > 0 then (select sum(q.p * q.cp::DOUBLE / q.cn) from q where q.k = t.k) / t.p end as pr_auc
        from t join w on w.k = t.k)"""


def _ece_sql(source: str, key: str) -> str:
    return f"""
b as (select {key} as k, least(floor(round(score * 10, 9)), 9) as bin, count(*) as n, sum(label) as y, sum(score) as p, sum((score - label) * (score - label)) as sq
      from {source} group by 1, 2),
ece as (select k, sum(sq) / sum(n) as brier_score, sum(abs(y - p)) / sum(n) as expected_calibration_error from b group by 1)"""


@registry.query(f"with {SCORED_SQL}, {_confusion_sql('scored', 'o_orderpriority')} select k as o_orderpriority, {_CONFUSION_OUT} from c")
def confusion_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mx.confusion(scored(spark, folder), ["o_orderpriority"], label="label", predicted="predicted"))


@registry.query(
    f"with {SCORED_SQL}, {_ece_sql('scored', 'o_orderpriority')} select k as o_orderpriority, round(brier_score, 6) as brier_score, round(expected_calibration_error, 6) as expected_calibration_error from ece"
)
def brier_and_ece(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mx.calibration_errors(scored(spark, folder), ["o_orderpriority"], label="label", score="score"))


@registry.query(
    f"with {SCORED_SQL}, {_auc_sql('scored', 'ship_year')} select k as ship_year, round(roc_auc, 6) as roc_auc, round(pr_auc, 6) as pr_auc from auc"
)
def ranking_areas(spark: SparkSession, folder: str) -> DataFrame:
    counts = mx.score_counts(scored(spark, folder), ["ship_year"], label="label", score="score")
    return rounded(mx.ranking_metrics(counts, ["ship_year"]).select("ship_year", "roc_auc", "pr_auc"))


@registry.query(
    f"with {_DOCS_SQL}, {_auc_sql('docs', 'lang')} select k as lang, round(roc_auc, 6) as roc_auc, round(pr_auc, 6) as pr_auc from auc"
)
def ranking_areas_distinct_scores(spark: SparkSession, folder: str) -> DataFrame:
    counts = mx.score_counts(_documents(spark, folder), ["lang"], label="label", score="score")
    return rounded(mx.ranking_metrics(counts, ["lang"]).select("lang", "roc_auc", "pr_auc"))


_CURVE_SQL = f"""with {_DOCS_SQL},
h as (select score, sum(label) as p, count(*) - sum(label) as n from docs group by 1),
r as (select score, sum(p) over (order by score desc)::DOUBLE as tp, sum(n) over (order by score desc)::DOUBLE as fp,
             sum(p) over ()::DOUBLE as pp, sum(n) over ()::DOUBLE as nn from h)"""


@registry.query(f"{_CURVE_SQL} select round(score, 9) as threshold, round(fp / nn, 6) as fpr, round(tp / pp, 6) as tpr from r")
def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    counts = mx.score_counts(_documents(spark, folder), [], label="label", score="score")
    return mx.roc_curve(counts, []).select(
        F.round("threshold", 9).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr")
    )


@registry.query(f"{_CURVE_SQL} select round(score, 9) as threshold, round(tp / (tp + fp), 6) as precision, round(tp / pp, 6) as recall from r")
def pr_points(spark: SparkSession, folder: str) -> DataFrame:
    counts = mx.score_counts(_documents(spark, folder), [], label="label", score="score")
    return mx.pr_curve(counts, []).select(
        F.round("threshold", 9).alias("threshold"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall")
    )


@registry.query(
    f"""{_CURVE_SQL}, c as (select tp / pp as rec, tp / (tp + fp) as prec, row_number() over (order by score desc) as i from r
union all select 0, 1, 0), d as (select a.rec - b.rec as w, (a.prec + b.prec) / 2 as h from c a join c b on a.i = b.i + 1)
select round(sum(w * h), 6) as pr_auc_trapezoid from d"""
)
def pr_area_trapezoid(spark: SparkSession, folder: str) -> DataFrame:
    counts = mx.score_counts(_documents(spark, folder), [], label="label", score="score")
    return rounded(mx.ranking_metrics(counts, []).select("pr_auc_trapezoid"))


@registry.query(
    f"""with {SCORED_SQL}, {_confusion_sql('scored', 'o_orderstatus')}, {_auc_sql('scored', 'o_orderstatus')}, {_ece_sql('scored', 'o_orderstatus')}
select k as o_orderstatus, {_CONFUSION_OUT}, round(roc_auc, 6) as roc_auc, round(pr_auc, 6) as pr_auc, round(brier_score, 6) as brier_score,
round(expected_calibration_error, 6) as expected_calibration_error from c join auc using (k) join ece using (k)"""
)
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mx.classification_report(scored(spark, folder), ["o_orderstatus"], label="label", score="score"))


_REGRESSION_OUT = """count(*)::BIGINT as records, round(avg(e), 6) as mae, round(sqrt(avg(e * e)), 6) as rmse,
round(quantile_cont(e, 0.5), 6) as median_absolute_error, round(1 - sum(e * e) / nullif(var_pop(y) * count(*), 0), 6) as r2"""


@registry.query(
    f"""with {SCORED_SQL}, m as (select o_orderpriority as g, quantile_cont(days::DOUBLE, 0.5) as p from scored group by 1),
v as (select o_orderpriority, days::DOUBLE as y, abs(days - p) as e from scored join m on g = o_orderpriority)
select o_orderpriority, {_REGRESSION_OUT} from v group by 1"""
)
def regression_report(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted days are the cohort's median."""
    rows = scored(spark, folder)
    medians = rows.groupBy("o_orderpriority").agg(F.percentile("days", 0.5).alias("p"))
    return rounded(
        mx.regression_report(rows.join(medians, "o_orderpriority"), ["o_orderpriority"], actual="days", predicted="p", whole_units=True)
    )


@registry.query(
    f"""with v as (select o_orderstatus, o_totalprice as y, abs(o_totalprice - 250000) as e from orders)
select o_orderstatus, {_REGRESSION_OUT.replace('avg(e), 6', 'avg(e), 4').replace('avg(e * e)), 6', 'avg(e * e)), 4').replace('0.5), 6', '0.5), 4')} from v group by 1"""
)
def regression_report_any_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "orders").withColumn("p", F.lit(250000.0))
    out = mx.regression_report(rows, ["o_orderstatus"], actual="o_totalprice", predicted="p")
    return out.withColumns({c: F.round(c, 4) for c in ("mae", "rmse", "median_absolute_error")} | {"r2": F.round("r2", 6)})


def _grid_sql(thresholds, source: str = "scored") -> str:
    values = ", ".join(repr(t) for t in thresholds)
    return f"""
grid as (select unnest([{values}]::DOUBLE[]) as threshold),
cut as (select threshold, count(*) filter (where label = 1 and score >= threshold)::BIGINT as tp,
              count(*) filter (where label = 0 and score >= threshold)::BIGINT as fp,
              count(*) filter (where label = 1 and score < threshold)::BIGINT as fn,
              count(*) filter (where label = 0 and score < threshold)::BIGINT as tn from {source} cross join grid group by 1),
m as (select *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) as precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) as recall,
             coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, (tp + fp)::DOUBLE / (tp + fp + fn + tn) as share from cut)"""


@registry.query(
    f"""with {SCORED_SQL}, {_grid_sql(mx.COARSE_THRESHOLDS)}
select threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
round(share, 6) as flagged_for_adoption_share, tn, fp, fn, tp from m"""
)
def threshold_grid(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mx.threshold_table(scored(spark, folder), [], label="label", score="score"))


@registry.query(
    f"""with {SCORED_SQL}, {_grid_sql(mx.COARSE_THRESHOLDS)}
select threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
round(share, 6) as flagged_for_adoption_share, tn, fp, fn, tp from m order by abs(threshold - 0.42), threshold limit 1"""
)
def nearest_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_row(rounded(mx.threshold_table(scored(spark, folder), [], label="label", score="score")), "threshold", 0.42)


def _points_sql(source: str, name: str) -> str:
    values = ", ".join(repr(t) for t in mx.FINE_THRESHOLDS)
    s = name
    return f"""
{s}g as (select unnest([{values}]::DOUBLE[]) as threshold),
{s}a as (select threshold, count(*) filter (where label = 1 and score >= threshold) as tp, count(*) filter (where label = 0 and score >= threshold) as fp,
             count(*) filter (where label = 1 and score < threshold) as fn from {source} cross join {s}g group by 1),
{s}m as (select *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) as prec, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) as rec,
             coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) as f1 from {s}a),
{s}h as (select score, sum(label) as p, count(*) - sum(label) as n from {source} group by 1),
{s}j as (select score, sum(p) over (order by score desc)::DOUBLE / sum(p) over () - sum(n) over (order by score desc)::DOUBLE / sum(n) over () as j from {s}h),
{s}t as (
  select 'default_0.50' as threshold_label, 0.5::DOUBLE as threshold
  union all select 'max_f1', (select threshold from {s}m order by f1 desc, threshold limit 1)
  union all select 'youden_j', (select score from {s}j order by j desc, score desc limit 1)
  union all select 'high_recall_ge85', coalesce((select threshold from {s}m where rec >= 0.85 order by prec desc, threshold limit 1), 0.30)
  union all select 'balanced_precision_recall', (select threshold from {s}m order by abs(prec - rec), threshold limit 1)
  union all select 'top_10_percent_capacity', (select quantile_cont(score, 0.9) from {source}))"""


def _at_sql(source: str, thresholds: str, prefix: str, rates: bool = True) -> str:
    p = prefix
    both = (
        f"round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 4) as {p}false_positive_rate, round(coalesce(fn::DOUBLE / nullif(fn + tp, 0), 0), 4) as {p}false_negative_rate,"
        if rates
        else ""
    )
    return f"""
select threshold_label, threshold, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 4) as {p}precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 4) as {p}recall,
round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 4) as {p}f1, {both}
tp as {p}tp, fp as {p}fp, tn as {p}tn, fn as {p}fn from (
select threshold_label, threshold, count(*) filter (where label = 1 and score >= threshold)::BIGINT as tp, count(*) filter (where label = 0 and score >= threshold)::BIGINT as fp,
count(*) filter (where label = 1 and score < threshold)::BIGINT as fn, count(*) filter (where label = 0 and score < threshold)::BIGINT as tn
from {source} cross join {thresholds} group by 1, 2)"""


@registry.query(
    f"""with {_DOCS_SQL}, {_points_sql('docs', 'z')}
select * replace (round(threshold, 4) as threshold), 'selection' as selection_source from ({_at_sql('docs', 'zt', '')})"""
)
def operating_points(spark: SparkSession, folder: str) -> DataFrame:
    return mx.operating_points(_documents(spark, folder), label="label", score="score")


@registry.query(
    f"""with {SCORED_SQL}, sel as (select * from scored where ship_year <= 1998), tst as (select * from scored where ship_year > 1998),
{_points_sql('sel', 'z')}, s as (select * replace (round(threshold, 4) as threshold) from ({_at_sql('sel', 'zt', 'selection_')})),
x as ({_at_sql('tst', '(select threshold_label, threshold from s)', 'test_', rates=False)})
select s.*, x.* exclude (threshold_label, threshold) from s join x using (threshold_label)"""
)
def frozen_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored(spark, folder)
    return mx.frozen_thresholds(
        rows.filter(F.col("ship_year") <= 1998), rows.filter(F.col("ship_year") > 1998), label="label", score="score"
    )


@registry.query(
    f"""with {SCORED_SQL}, b as (select unnest(range(1, 11))::INTEGER as bin),
c as (select greatest(ceil(round(score * 10, 9)), 1)::INTEGER as bin, count(label)::BIGINT as records, round(avg(score), 6) as m, round(avg(label), 6) as o from scored group by 1)
select b.bin, coalesce(records, 0)::BIGINT as records, m as mean_predicted_probability, o as observed_adoption_rate,
'(' || case when b.bin = 1 then '-0.001' else printf('%.1f', (b.bin - 1) / 10.0) end || ', ' || printf('%.1f', b.bin / 10.0) || ']' as probability_bin
from b left join c on b.bin = c.bin"""
)
def calibration_bins(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mx.calibration_table(scored(spark, folder), [], label="label", score="score"))


_ODD_SCORES_SQL = f"""{SCORED_SQL},
odd as (select * replace (case predicted_days when 70 then null when 80 then -0.25 when 90 then 1.5 when 100 then 'inf'::DOUBLE when 110 then 'nan'::DOUBLE else score end as score) from scored)"""


def _odd_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scored lines, some of them with a missing, infinite or out-of-range score."""
    days = F.col("predicted_days")
    value = F.when(days == 70, None).when(days == 80, -0.25).when(days == 90, 1.5).when(days == 100, float("inf"))
    return scored(spark, folder).withColumn("score", value.when(days == 110, float("nan")).otherwise(F.col("score")))


@registry.query(
    f"""with {_ODD_SCORES_SQL}, b as (select greatest(ceil(round(score * 10, 9)), 1)::INTEGER as bin, count(label)::BIGINT as n, avg(score) as p, avg(label) as y
  from odd where score between 0 and 1 group by 1)
select g.bin::INTEGER as bin, coalesce(n, 0) as records, round(p, 6) as mean_predicted_probability, round(y, 6) as observed_adoption_rate
from (select unnest(range(1, 11)) as bin) g left join b using (bin)"""
)
def calibration_bins_odd_scores(spark: SparkSession, folder: str) -> DataFrame:
    table = mx.calibration_table(_odd_scores(spark, folder), [], label="label", score="score")
    return rounded(table.select("bin", "records", "mean_predicted_probability", "observed_adoption_rate"))


@registry.query(
    f"""with {_ODD_SCORES_SQL}, k as (select * from odd where score is not null and not isnan(score) and not isinf(score))
select o_orderpriority, count(*)::BIGINT as records, round(avg((score - label) * (score - label)), 6) as brier_score from k group by 1"""
)
def brier_odd_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = _odd_scores(spark, folder).filter("score is null or isnan(score) or abs(score) < double('inf')")
    errors = mx.calibration_errors(rows, ["o_orderpriority"], label="label", score="score")
    sizes = rows.filter(mx.known_score("label", "score")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("records"))
    return rounded(errors.join(sizes, "o_orderpriority").select("o_orderpriority", "records", "brier_score"))


@registry.query(
    f"""with {_ODD_SCORES_SQL} select ship_year, quantile_cont(score, 0.5) as middle, quantile_cont(score, 0.99) as top
from odd where score is not null and not isnan(score) group by 1"""
)
def quantiles_odd_scores(spark: SparkSession, folder: str) -> DataFrame:
    return exact_quantiles(_odd_scores(spark, folder), ["ship_year"], "score", {"middle": 0.5, "top": 0.99})


_RELIABILITY_SQL = f"""{SCORED_SQL}, rel as (
""" + " union all ".join(
    f"""select '{c}' as cohort, {c}::VARCHAR as value, count(*)::BIGINT as records, count(*) < 870 as small_cohort_flag,
avg(label) as observed_adoption_rate, avg(score) as mean_predicted_adoption_probability, abs(avg(label) - avg(score)) as calibration_gap,
avg((score - label) * (score - label)) as brier_score, avg(absolute_error) as mae,
count(*) filter (where predicted = 1 and label = 0)::DOUBLE / count(*) as false_positive_rate,
count(*) filter (where predicted = 0 and label = 1)::DOUBLE / count(*) as false_negative_rate from scored group by {c}"""
    for c in COHORTS
) + "), reliability as (select *, not small_cohort_flag and calibration_gap <= 0.1 and brier_score <= 0.25 as is_reliable from rel)"


def _reliability(spark: SparkSession, folder: str) -> DataFrame:
    return mx.cohort_reliability(scored(spark, folder), COHORTS, absolute_error="absolute_error", min_records=870, **_COLS)


def _r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


_RATES = ("observed_adoption_rate", "mean_predicted_adoption_probability", "calibration_gap", "brier_score", "mae", "false_positive_rate", "false_negative_rate")


@registry.query(f"with {_RELIABILITY_SQL} select cohort, value, records, small_cohort_flag, is_reliable, {_r6(*_RATES)} from reliability")
def cohort_reliability(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_reliability(spark, folder))


@registry.query(
    f"""with {_RELIABILITY_SQL} select cohort, value, records, cohort as subgroup_field, value as subgroup_value, small_cohort_flag,
{_r6('observed_adoption_rate', 'mean_predicted_adoption_probability', 'calibration_gap', 'false_positive_rate', 'false_negative_rate')},
round(mean_predicted_adoption_probability, 6) as mean_predicted_probability, round(mae, 6) as regression_mae,
case when small_cohort_flag or calibration_gap >= 0.15 then 'high' when calibration_gap >= 0.08 then 'medium' else 'low' end as risk_level,
concat_ws(',', case when small_cohort_flag then 'few_records' end,
 case when not small_cohort_flag and calibration_gap >= 0.15 then 'gap_large_' || side when calibration_gap >= 0.08 then 'gap_medium_' || side end,
 case when false_positive_rate >= 0.15 then 'false_positives' end, case when false_negative_rate >= 0.2 then 'false_negatives' end) as cautions
from (select *, case when mean_predicted_adoption_probability > observed_adoption_rate then 'over' else 'under' end as side from reliability)"""
)
def red_flags(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mx.red_flags(_reliability(spark, folder)))


@registry.query(
    f"""with {_RELIABILITY_SQL} select 'combined' as animal_subset, sum(records)::BIGINT as records, round(avg(calibration_gap), 4) as mean_calibration_gap,
arg_max(cohort, (calibration_gap, cohort)) as worst_cohort, round(max(calibration_gap), 4) as worst_calibration_gap,
round(avg(small_cohort_flag::INTEGER) * 100, 1) as pct_small_cohort_flagged,
round(avg((records >= 100 and calibration_gap <= 0.1 and brier_score <= 0.25)::INTEGER) * 100, 1) as pct_reliable_cohort,
0.1::DOUBLE as cohort_threshold, 100 as min_records_for_cohort,
avg(mean_predicted_adoption_probability) > avg(observed_adoption_rate) as overconfident,
round(avg(observed_adoption_rate), 4) as mean_observed_adoption_rate, round(avg(mean_predicted_adoption_probability), 4) as mean_predicted_probability from reliability"""
)
def calibration_summary(spark: SparkSession, folder: str) -> DataFrame:
    return mx.calibration_summary(_reliability(spark, folder))


@registry.query(
    f"""with {_RELIABILITY_SQL}, f as (
"""
    + " union all ".join(
        f"select '{mode}' as failure_mode, '{metric}' as metric, {metric} as value_score, cohort, value, records from reliability where not small_cohort_flag"
        for mode, metric in mx.FAILURE_MODES
    )
    + """) select failure_mode, metric, round(value_score, 6) as value_score, cohort, value, records from f
qualify row_number() over (partition by failure_mode order by value_score desc nulls last, cohort, value) <= 3"""
)
def failure_modes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mx.failure_modes(_reliability(spark, folder), top=3))


_SLICES = dict(absolute_error="absolute_error", min_records=870, **_COLS)


@registry.query(
    f"""with {_RELIABILITY_SQL} select cohort as slice, value, records, round(observed_adoption_rate, 6) as adoption_rate,
round(mean_predicted_adoption_probability, 6) as predicted_adoption_probability, {_r6('false_positive_rate', 'false_negative_rate')} from reliability where not small_cohort_flag"""
)
def error_slices_classification(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mx.error_slices(scored(spark, folder), COHORTS, **_SLICES)[0])


@registry.query(
    f"with {SCORED_SQL} "
    + " union all ".join(
        f"""select '{c}' as slice, {c}::VARCHAR as value, count(absolute_error)::BIGINT as records, round(avg(absolute_error), 6) as mae,
round(quantile_cont(absolute_error, 0.5), 6) as median_absolute_error from scored group by {c} having count(*) >= 870"""
        for c in COHORTS
    )
)
def error_slices_regression(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mx.error_slices(scored(spark, folder), COHORTS, **_SLICES)[1])


@registry.query(
    f"with {SCORED_SQL} "
    + " union all ".join(
        f"""select '{c}: ' || {c}::VARCHAR as cohort, round(avg(absolute_error), 6) as mae, count(absolute_error)::BIGINT as records from scored group by {c} having count(*) >= 870"""
        for c in COHORTS
    )
)
def slice_labels(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(slice_view(mx.error_slices(scored(spark, folder), COHORTS, **_SLICES)[1], "mae"))


@registry.query(
    f"""with {SCORED_SQL}, v as (select *, case when score >= 0.5 and predicted_days < 250 then 'likely_quick_placement' when score >= 0.5 then 'adoptable_needs_visibility'
when predicted_days >= 250 then 'long_stay_risk' else 'non_adoption_or_fast_exit_risk' end as risk_quadrant from scored)
select risk_quadrant, count(label)::BIGINT as records, round(avg(label), 6) as observed_adoption_rate, round(avg(score), 6) as mean_predicted_adoption_probability,
round(quantile_cont(predicted_days, 0.5), 6) as median_predicted_days_to_outcome from v group by 1"""
)
def risk_quadrants(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        mx.risk_quadrants(scored(spark, folder), label="label", score="score", predicted_days="predicted_days", long_days=250, whole_days=True)
    )


@registry.query(
    f"""with {_DOCS_SQL}, {_auc_sql('docs', 'lang')}, {_ece_sql('docs', 'lang')}
select auc.k as subgroup, (select count(*) from docs d where d.lang = auc.k)::BIGINT as n_samples, {_r6('pr_auc', 'roc_auc', 'brier_score', 'expected_calibration_error')}
from auc join ece on auc.k = ece.k
where (select count(distinct label) from docs d where d.lang = auc.k) = 2"""
)
def subgroup_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mx.subgroup_report(_documents(spark, folder), "lang", label="label", score="score"))


@registry.query(
    f"with {SCORED_SQL}, {_auc_sql('scored', 'ship_year')} select k as ship_year, round(roc_auc, 6) as roc_auc, (t.p + t.n)::BIGINT as records from auc join t using (k)"
)
def drift_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mx.drift_by_period(scored(spark, folder), "ship_year", label="label", score="score"))


REPLICATES = 50
_CUTS = " + ".join(f"(hash >= {c})::BIGINT" for c in bs.poisson_cuts())


def _bootstrap_sql(cells: str, keys: str) -> str:
    return f"""
cells as ({cells}),
reps as (select unnest(range(0, {REPLICATES})) as rep),
hw as (select cells.*, rep, ('0x' || substr(md5(cluster::VARCHAR || '-' || rep::VARCHAR), 1, 8))::BIGINT as hash from cells cross join reps),
ww as (select *, {_CUTS} as w from hw),
sw as (select {keys}, rep, score, sum(w * pos)::DOUBLE as pos, sum(w * neg)::DOUBLE as neg, sum(w * tp)::DOUBLE as tp, sum(w * fp)::DOUBLE as fp, sum(w * fn)::DOUBLE as fn, sum(w * ae) as ae
       from ww group by all),
rk as (select *, sum(pos) over o as cp, sum(neg) over o as cn, sum(pos) over g as ap, sum(neg) over g as an
       from sw window o as (partition by {keys}, rep order by score desc), g as (partition by {keys}, rep)),
mm as (select {keys}, rep, sum(neg * (cp - pos / 2)) / nullif(max(ap) * max(an), 0) as roc_auc,
              case when max(ap) > 0 and max(an) > 0 then sum(pos * cp / nullif(cp + cn, 0)) / max(ap) end as pr_auc,
              coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0) as f1_at_0_50, sum(ae) / (max(ap) + max(an)) as mae
       from rk group by all),
iv as (unpivot mm on roc_auc, pr_auc, f1_at_0_50, mae into name metric value v),
ci as (select {keys}, metric, round(quantile_cont(v, 0.025), 6) as lower, round(avg(v), 6) as estimate, round(quantile_cont(v, 0.975), 6) as upper, count(v)::BIGINT as bootstrap_samples from iv group by all)"""


_CELL_SUMS = """sum(label) as pos, count(*) - sum(label) as neg, count(*) filter (where label = 1 and predicted = 1) as tp,
count(*) filter (where label = 0 and predicted = 1) as fp, count(*) filter (where label = 1 and predicted = 0) as fn, sum(absolute_error) as ae"""


@registry.query(
    f"""with {SCORED_SQL}, {_bootstrap_sql(f"select 1 as one, l_suppkey as cluster, score, {_CELL_SUMS} from scored group by all", "one")}
select metric, 'combined' as animal_subset, lower, estimate, upper, bootstrap_samples, metric = 'pr_auc' as pr_auc_first from ci"""
)
def bootstrap_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        bs.bootstrap_intervals(
            scored(spark, folder), replicates=REPLICATES, cluster="l_suppkey", absolute_error="absolute_error", **_COLS
        )
    )


_STACKED_CELLS = " union all ".join(
    f"select '{c}' as cohort, {c}::VARCHAR as value, l_suppkey as cluster, score, {_CELL_SUMS} from scored group by all"
    for c in ("l_linestatus", "ship_year")
)


@registry.query(
    f"""with {SCORED_SQL}, {_bootstrap_sql(_STACKED_CELLS, "cohort, value")},
n as (select 'l_linestatus' as cohort, l_linestatus as value, count(*)::BIGINT as records from scored group by 2
      union all select 'ship_year', ship_year::VARCHAR, count(*)::BIGINT from scored group by 2)
select cohort, value, metric, records, lower, estimate, upper, bootstrap_samples, 'ok' as status
from ci join n using (cohort, value) where records >= 8000
union all select cohort, value, 'all', records, null, null, null, 0, 'small_cohort' from n where records < 8000"""
)
def subgroup_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        bs.subgroup_intervals(
            scored(spark, folder), ["l_linestatus", "ship_year"], replicates=REPLICATES, min_records=8000,
            cluster="l_suppkey", absolute_error="absolute_error", **_COLS,
        )
    )


@registry.query(
    f"""with {SCORED_SQL}, {_bootstrap_sql(f"select 1 as one, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) as cluster, score, {_CELL_SUMS} from scored group by all", "one")}
select metric, 'combined' as animal_subset, lower, estimate, upper, bootstrap_samples, metric = 'pr_auc' as pr_auc_first from ci"""
)
def bootstrap_intervals_by_row(spark: SparkSession, folder: str) -> DataFrame:
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rounded(
        bs.row_bootstrap_intervals(scored(spark, folder), key, replicates=REPLICATES, absolute_error="absolute_error", **_COLS)
    )


_ISOTONIC_POINTS = f"""{SCORED_SQL},
points as (select floor(score * 200) / 200 as s, sum(label)::DOUBLE as t, count(label)::DOUBLE as w from scored group by 1),
numbered as (select *, row_number() over (order by s) as i, sum(t) over (order by s) as st, sum(w) over (order by s) as sw from points),
spans as (select a.i as lo, b.i as hi, (b.st - a.st + a.t) / (b.sw - a.sw + a.w) as mean from numbered a join numbered b on a.i <= b.i),
ends as (select lo, i, min(mean) as least from spans join numbered n on n.i between lo and hi group by lo, i),
fitted as (select i, max(least) as value from ends group by i)"""


def _isotonic(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    at = F.floor(F.col("score") * 200) / 200
    points = scored(spark, folder).groupBy(at.alias("s")).agg(
        F.sum(F.col("label").cast("double")).alias("t"), F.count("label").cast("double").alias("w")
    )
    return points, pooled_blocks(points, score="s", total="t", weight="w", slice_rows=16)


@registry.query(
    f"""with {_ISOTONIC_POINTS} select min(s) as low, max(s) as high, sum(t)::BIGINT as positives, sum(w)::BIGINT as records, round(value, 8) as value
from numbered join fitted using (i) group by value"""
)
def isotonic_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Level sets of labels over rounded scores, pooled in many small slices; SQL states the max-min formula."""
    blocks = _isotonic(spark, folder)[1]
    return blocks.select(
        "low", "high", F.col("total").cast("bigint").alias("positives"), F.col("weight").cast("bigint").alias("records"), F.round("value", 8).alias("value")
    )


@registry.query(
    f"""with {_ISOTONIC_POINTS}, edges as (select min(s) as low, max(s) as high, value from numbered join fitted using (i) group by value),
asked as (select distinct floor(score * 1000) / 1000 + 0.0005 as s from scored)
select s, round(case when b.value is null then a.value when a.value is null then b.value when s <= a.high then a.value
  else a.value + (b.value - a.value) * ((s - a.high) / (b.low - a.high)) end, 8) as value
from (select s, (select arg_max(low, low) from edges where low <= s) as under, (select arg_min(low, low) from edges where low > s) as over from asked)
left join edges a on a.low = under left join edges b on b.low = over"""
)
def isotonic_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Calibrated values at scores between the points."""
    asked = scored(spark, folder).select((F.floor(F.col("score") * 1000) / 1000 + 0.0005).alias("s")).distinct()
    out = isotonic_values(asked, _isotonic(spark, folder)[1], score="s", output="value", slice_rows=50)
    return out.select("s", F.round("value", 8).alias("value"))
