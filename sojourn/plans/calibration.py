"""Probability calibration, ensembles and bounded batch scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions.labels import days_bucket
from sojourn.operators.isotonic import isotonic_values, pooled_blocks
from sojourn.operators.splits import folds
from sojourn.plans.training import CLASSIFICATION, Features, Fitted, Model, evaluate, fit_all
from sojourn.session import ensure_checkpoint_dir, stored

MAX_DAYS = 4000.0


@dataclass(frozen=True)
class Calibrator:
    """Fitted on scores of the calibration period only."""

    method: str
    model: object  # blocks of the isotonic regression as a table, or a fitted logistic model

    def apply(self, scored: DataFrame, output: str = "calibrated") -> DataFrame:
        bounded = lambda value: F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias(output)
        if self.method == "isotonic":
            out = isotonic_values(scored, self.model, score="score", output="_value")
            return out.select(*scored.columns, bounded(F.col("_value")))
        out = self.model.transform(VectorAssembler(inputCols=["score"], outputCol="_v").transform(scored))
        return out.select(*scored.columns, bounded(vector_to_array("probability")[1]))


def calibrate(scored: DataFrame, *, label: str, method: str = "isotonic") -> Calibrator:
    """Isotonic or sigmoid map from score to observed rate.

    Isotonic regression depends on the count and sum of labels per score only; its blocks are pooled
    slice by slice and stay a table.
    """
    method = "sigmoid" if method in ("sigmoid", "platt") else "isotonic"
    if method == "isotonic":
        points = scored.groupBy("score").agg(
            F.sum(F.col(label).cast("double")).alias("total"), F.count(label).cast("double").alias("weight")
        )
        return Calibrator(method, pooled_blocks(points, score="score", total="total", weight="weight"))
    # a distinct (score, label) pair enters once with its count as weight
    pairs = scored.groupBy("score", F.col(label).cast("double").alias("label")).agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )
    rows = VectorAssembler(inputCols=["score"], outputCol="_v").transform(pairs)
    return Calibrator(method, LogisticRegression(featuresCol="_v", labelCol="label", weightCol="weight").fit(rows))


def calibrated_reports(
    split: DataFrame,
    fitted: Mapping[str, Fitted],
    subsets: Mapping[str, Column],
    *,
    label: str,
    methods: Sequence[str] = ("isotonic", "sigmoid"),
) -> DataFrame:
    """Metric rows of each subset's model before and after calibration on the calibration period.

    The selection and test periods are only scored.
    """
    ensure_checkpoint_dir(split.sparkSession)
    parts = []
    for subset, condition in subsets.items():
        scored = (
            fitted[subset]
            .score(split.filter(condition & F.col("split").isin("calibration", "selection", "test")), compact=True)
            .select("split", label, "score")
        )
        scored = stored(scored, "scored")
        own, rest = scored.filter(F.col("split") == "calibration"), scored.filter(F.col("split") != "calibration")
        versions = {"none": rest} | {
            m: calibrate(own, label=label, method=m).apply(rest).drop("score").withColumnRenamed("calibrated", "score")
            for m in methods
        }
        parts += [
            rows.select(
                F.lit(subset).alias("animal_subset"), F.lit(m).alias("calibration_method"),
                F.col("split").alias("metric_split"), F.col(label).alias("label"), "score",
            )
            for m, rows in versions.items()
        ]
    keys = ["animal_subset", "calibration_method", "metric_split"]
    # the metrics read the scores many times, and an isotonic score is a plan of several shuffles
    return evaluate(stored(reduce(DataFrame.unionByName, parts), "calibrated"), keys, CLASSIFICATION)


def weighted_score(columns: Sequence[str], weights: Mapping[str, float] | None = None) -> Column:
    """Weighted mean of score columns; equal weights by default."""
    w = {c: (weights or {}).get(c, 1.0 / len(columns)) for c in columns}
    total = sum(w.values())
    return reduce(lambda a, b: a + b, [F.col(c) * F.lit(w[c] / total) for c in columns])


def with_base_scores(models: Mapping[str, Fitted], rows: DataFrame) -> DataFrame:
    """Rows with ``score_<name>`` of every model; models of one preparation share the encoded row."""
    out, shared = rows, None
    for name, model in models.items():
        kept = [c for c in out.columns if c in rows.columns or c.startswith("score_")]
        if model.preparation is None:
            out = model.score(out.select(*kept)).withColumnRenamed("score", f"score_{name}")
            shared = None
            continue
        if shared is None or model.preparation is not shared:
            out = model.preparation.apply(out.select(*kept)).select(*kept, "features")
            shared = model.preparation
        out = model.score_encoded(out).withColumnRenamed("score", f"score_{name}")
    return out.drop("features")


@dataclass(frozen=True)
class Stack:
    bases: Mapping[str, Fitted]
    meta: object
    task: str

    def score(self, rows: DataFrame) -> DataFrame:
        scored = with_base_scores(self.bases, rows)
        inputs = [f"score_{n}" for n in self.bases]
        out = self.meta.transform(VectorAssembler(inputCols=inputs, outputCol="_v").transform(scored))
        value = vector_to_array("probability")[1] if self.task == CLASSIFICATION else F.col("prediction")
        return out.select(*rows.columns, value.alias("score"))


def stack(train: DataFrame, features: Features, bases: Sequence[Model], *, k: int = 5, task: str = CLASSIFICATION) -> Stack:
    """Meta model on out-of-fold base scores; base models refitted on all training rows."""
    label = features.label
    if task == CLASSIFICATION:
        sizes = [r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()]
        if len(sizes) < 2 or min(sizes) < k:
            raise ValueError(f"stacking needs at least {k} rows of both classes, got {sizes}")
    # the folds are digests of the key: stored with what fitting reads
    known = dict.fromkeys([*features.key, *features.columns(), label])
    folded = stored(folds(train, key=features.key, k=k, classes=label if task == CLASSIFICATION else None).select("fold", *known), "folds")
    parts = []
    for i in range(k):
        inside = folded.filter(F.col("fold") != i).drop("fold")
        outside = folded.filter(F.col("fold") == i).drop("fold")
        models = {m.name: own for m, own in zip(bases, fit_all(bases, inside, features, ready=True))}
        parts.append(with_base_scores(models, outside).select(label, *[f"score_{name}" for name in models]))
    # the meta model reads the scores in every step
    scored = stored(reduce(DataFrame.unionByName, parts), "base-scores")
    inputs = [f"score_{m.name}" for m in bases]
    rows = VectorAssembler(inputCols=inputs, outputCol="_v").transform(scored).select("_v", F.col(label).cast("double").alias("label"))
    meta = LogisticRegression if task == CLASSIFICATION else LinearRegression
    fitted_meta = meta(featuresCol="_v", labelCol="label").fit(rows)
    return Stack({m.name: own for m, own in zip(bases, fit_all(bases, folded, features, ready=True))}, fitted_meta, task)


def bounded_predictions(
    rows: DataFrame, *, probability: str, raw_days: str, transform: str = "none", max_days: float = MAX_DAYS
) -> DataFrame:
    """Predictions with an error code instead of a value where they are out of bounds."""
    p = F.col(probability)
    days = F.expm1(raw_days) if transform == "expm1" else F.col(raw_days).cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    code = (
        F.when(~finite(p) | (p < 0) | (p > 1), "INVALID_PROB")
        .when(~finite(days) | (days < 0), "INVALID_DAYS")
        .when(days > max_days, "OUT_OF_BOUNDS")
    )
    ok = code.isNull()
    return rows.withColumns(
        {
            "ok": ok,
            "adoption_probability": F.when(ok, p),
            "predicted_days_to_outcome": F.when(ok, days),
            "los_bucket": F.when(ok, days_bucket(days)),
            "error_code": code,
        }
    )
