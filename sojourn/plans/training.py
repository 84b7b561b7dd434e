"""Training, scoring and evaluation with Spark ML.

The driver loops over models, subsets and windows; rows never leave the cluster. All scored
rows of a run are kept in one long table (model, subset, split, label, score), and every
metric comes from one job over it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StandardScalerModel, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.functions.clean import clip
from sojourn.operators import encoders as en
from sojourn.operators import metrics as mx
from sojourn.operators.skew import column_quantiles, null_safe_join
from sojourn.operators.splits import folds
from sojourn.session import ensure_checkpoint_dir, read_by, stored
from sojourn.sources.contracts import check_no_leakage

CLASSIFICATION, REGRESSION = "classification", "regression"
MIN_LEVEL_ROWS = 20
FEW_LEVELS = 200
NARROW = 64  # entries up to which a feature vector is made from one array
MATRIX_ROWS = 250_000  # encoded rows that one task of a fit holds: stored they take a few bytes each, what trees make of them up to a KB
FILE_ROWS = 50_000  # encoded rows of a file, the least that tasks share out: a table of few bytes still reaches all cores


@dataclass(frozen=True)
class Features:
    """Columns of a model and the names of its key, label and entity."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    key: tuple[str, ...]
    label: str

    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def only(self, names: Sequence[str]) -> Features:
        return Features(
            tuple(c for c in self.numeric if c in names), tuple(c for c in self.categorical if c in names), self.key, self.label
        )

    def with_label(self, label: str) -> Features:
        return Features(self.numeric, self.categorical, self.key, label)


@dataclass(frozen=True)
class Model:
    """What to fit. ``build`` makes the Spark estimator; ``encoding`` is one-hot or target."""

    name: str
    task: str
    build: Callable[..., object] | None
    encoding: str = "onehot"
    balanced: bool = False
    log_target: bool = False
    early_stop: bool = False
    params: Mapping[str, object] = field(default_factory=dict)


def logistic(**params) -> Model:
    build = lambda **p: LogisticRegression(maxIter=p.pop("maxIter", 1000), **p)
    return Model("logistic_regression", CLASSIFICATION, build, balanced=True, params=params)


def forest_classifier(**params) -> Model:
    base = {"numTrees": 200, "maxDepth": 14, "minInstancesPerNode": 10, "seed": 42} | params
    return Model("random_forest", CLASSIFICATION, RandomForestClassifier, balanced=True, params=base)


def boosting_classifier(**params) -> Model:
    base = {"maxIter": 100, "stepSize": 0.08, "maxDepth": 5, "seed": 42} | params
    return Model("boosting", CLASSIFICATION, GBTClassifier, params=base)


def target_boosting_classifier(**params) -> Model:
    base = {"maxIter": 1000, "stepSize": 0.05, "maxDepth": 6, "validationTol": 0.001, "seed": 42} | params
    return Model(
        "target_boosting", CLASSIFICATION, GBTClassifier, encoding="target", balanced=True, early_stop=True, params=base
    )


def dummy_classifier() -> Model:
    return Model("dummy_most_frequent", CLASSIFICATION, None)


def ridge(**params) -> Model:
    base = {"regParam": 1.0, "elasticNetParam": 0.0} | params
    return Model("ridge", REGRESSION, LinearRegression, params=base)


def forest_regressor(**params) -> Model:
    base = {"numTrees": 200, "maxDepth": 14, "minInstancesPerNode": 10, "seed": 42} | params
    return Model("random_forest", REGRESSION, RandomForestRegressor, params=base)


def boosting_regressor(**params) -> Model:
    base = {"maxIter": 100, "stepSize": 0.08, "maxDepth": 5, "seed": 42} | params
    return Model("boosting", REGRESSION, GBTRegressor, params=base)


def target_boosting_regressor(**params) -> Model:
    base = {"maxIter": 1000, "stepSize": 0.05, "maxDepth": 6, "lossType": "absolute", "seed": 42} | params
    return Model(
        "target_boosting", REGRESSION, GBTRegressor, encoding="target", log_target=True, early_stop=True, params=base
    )


def dummy_regressor() -> Model:
    return Model("dummy_median", REGRESSION, None)


# --- preparation ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Preparation:
    """Fitted preprocessing: level tables for categories, imputing and scaling for numbers."""

    features: Features
    encoding: str
    levels: DataFrame | None
    literals: Mapping[str, Mapping[str, str]]
    modes: Mapping[str, str]
    means: Mapping[str, DataFrame]
    folds: Mapping[str, DataFrame]
    pipeline: PipelineModel
    medians: Mapping[str, float] = field(default_factory=dict)
    coded: Mapping[str, int] = field(default_factory=dict)  # columns whose names stay in the level table, and how many
    scaling: Sequence[Sequence[float]] = ()  # mean and factor of the numbers, where the vector is made from one array

    def apply(self, rows: DataFrame, training: bool = False, compact: bool = False) -> DataFrame:
        """Rows with ``features``; narrow ones that are stored and read again are made ``compact``, in one step."""
        encoded = self.fill(self.encode(rows, training))
        entries = self.entries() if compact else []
        if not entries:
            return self.pipeline.transform(encoded)
        # the stages in one step; their attributes tell trees which entries are levels
        facts = self.pipeline.transform(encoded.limit(0)).schema["features"].metadata
        out = encoded.select("*", array_to_vector(F.concat(*entries)).alias("features", metadata=facts))
        packed = VectorAssembler(inputCols=["features"], outputCol="_packed").transform(out)
        return packed.select(*encoded.columns, F.col("_packed").alias("features", metadata=facts))

    def entries(self) -> list[Column]:
        """The entries of a narrow feature vector as arrays: the scaled numbers, then the levels of each category. Empty for a wide one.

        An array of a level is looked up, not computed entry by entry: generated code too long to be compiled runs very slowly.
        """
        onehot = [f"{c}__x" for c in self.features.categorical] if self.encoding == "onehot" else []
        labels = {n: _labels(self.literals, n) for n in onehot}
        if self.coded or len(self.scaling) != len(self.medians) or not 0 < sum(map(len, labels.values())) + len(self.scaling) <= NARROW:
            return []
        numbers = [(F.col(f"{c}_f") - F.lit(mean)) * F.lit(factor) for c, (mean, factor) in zip(self.medians, self.scaling)]
        arrays = [F.array(*numbers)] if numbers else []
        for n, own in labels.items():
            row = lambda level, own=own: F.array(*[F.lit(float(x == level)) for x in own])
            table = F.create_map(*[x for level in own for x in (F.lit(level), row(level))])
            arrays.append(F.coalesce(F.try_element_at(table, F.col(n).cast("string")), row(None)))
        return arrays

    def fill(self, rows: DataFrame) -> DataFrame:
        """Numbers with their training median where they are missing or NaN."""
        known = {c: F.when(~F.isnan(c), F.col(c)) for c in self.medians}
        return rows.withColumns({f"{c}_f": F.coalesce(known[c], F.lit(m)) for c, m in self.medians.items()}) if known else rows

    def encode(self, rows: DataFrame, training: bool = False) -> DataFrame:
        out = _numbers(rows, self.features.numeric)
        if self.encoding == "onehot":
            for c in self.features.categorical:
                name = f"{c}__x"
                out = out.withColumn(name, F.col(c))
                if name in self.literals:
                    out = en.apply_level_literals(out, self.literals[name], name, self.modes.get(name))
                elif name in self.coded:
                    out = en.apply_codes(out, self.levels, name, self.modes.get(name), self.coded[name], f"{name}_i")
            return out
        for c in self.features.categorical:
            if training:
                out = null_safe_join(out, self.folds[c], [c, "_fold"], "left").withColumnRenamed("encoded", f"{c}__x")
            else:
                out = en.encode_target(out, self.means[c], c).withColumnRenamed("encoded", f"{c}__x")
        return out


def _labels(literals: Mapping[str, Mapping[str, str]], name: str) -> list[str]:
    return sorted(set(literals[name].values())) if name in literals else ["_none"]


def _numbers(rows: DataFrame, numeric: Sequence[str]) -> DataFrame:
    return rows.withColumns({f"{c}__n": F.col(c).cast("double") for c in numeric}) if numeric else rows


def one_hot(counts: DataFrame, names: Sequence[str]):
    """From the counts per (column, level): level table, its few-level part, modes, coded columns, stages and the columns they make.

    The names of a column with more than ``FEW_LEVELS`` levels stay in the level table, with their codes; only how many they
    are reaches the driver.
    """
    literals: dict[str, dict[str, str]] = {}
    levels = en.level_map(counts, MIN_LEVEL_ROWS)
    modes = en.level_modes(counts)
    known = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.count("level").alias("n")).collect()}
    few = [c for c, n in known.items() if 0 < n <= FEW_LEVELS]
    for r in levels.filter(F.col("column").isin(few)).collect():
        literals.setdefault(r["column"], {})[r["level"]] = r["encoded"]
    coded: dict[str, int] = {}
    if any(n > FEW_LEVELS for n in known.values()):
        large = en.level_codes(levels.filter(~F.col("column").isin(few)))
        levels = levels.filter(F.col("column").isin(few)).withColumn("code", F.lit(None).cast("int")).unionByName(large).checkpoint()
        coded = {r["column"]: r["n"] for r in levels.groupBy("column").agg((F.max("code") + 1).alias("n")).collect() if r["n"]}
    labels = {n: _labels(literals, n) for n in names if n not in coded}
    sizes = {n: coded[n] if n in coded else len(labels[n]) for n in names}
    stages = [StringIndexerModel.from_labels(own, inputCol=n, outputCol=f"{n}_i", handleInvalid="keep") for n, own in labels.items()]
    # the extra index of unknown levels is last and dropped: they become zeros
    stages.append(OneHotEncoder(inputCols=[f"{n}_i" for n in names], outputCols=[f"{n}_v" for n in names], dropLast=True).fit(_sizes(counts, sizes)))
    return levels, literals, modes, coded, stages, [f"{n}_v" for n in names]


def _sizes(counts: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    """One row that tells the encoder how many values each index has."""
    row = counts.sparkSession.createDataFrame([tuple(float(n) for n in sizes.values())], ", ".join(f"`{n}_i` double" for n in sizes))
    # the largest index is that of unknown levels
    return row.select(*[F.col(f"{n}_i").alias(f"{n}_i", metadata=_nominal(f"{n}_i", size + 1)) for n, size in sizes.items()])


def _nominal(name: str, size: int) -> dict:
    return {"ml_attr": {"type": "nominal", "num_vals": size, "name": name}}


def prepare(train: DataFrame, features: Features, encoding: str) -> Preparation:
    """Fit the preprocessing on training rows only."""
    check_no_leakage(features.columns())
    levels = None
    literals: dict[str, dict[str, str]] = {}
    modes: dict[str, str] = {}
    coded: dict[str, int] = {}
    means: dict[str, DataFrame] = {}
    by_fold: dict[str, DataFrame] = {}
    numeric_inputs = [f"{c}__n" for c in features.numeric]
    stages = []
    if encoding == "onehot" and features.categorical:
        ensure_checkpoint_dir(train.sparkSession)
        renamed = train.select(*[F.col(c).alias(f"{c}__x") for c in features.categorical])
        counts = en.level_counts(renamed, renamed.columns).checkpoint()
        levels, literals, modes, coded, more, vectors = one_hot(counts, list(renamed.columns))
        stages += more
    elif encoding == "target":
        ensure_checkpoint_dir(train.sparkSession)
        for c in features.categorical:
            # stored with a known size: few levels are broadcast, as a shuffle by them would put many rows into few tasks
            means[c], by_fold[c] = (stored(t, "means") for t in en.target_tables(train, c, features.label, "_fold"))
        numeric_inputs += [f"{c}__x" for c in features.categorical]
        vectors = []
    else:
        vectors = []
    if numeric_inputs:
        filled = [f"{c}_f" for c in numeric_inputs]
        stages += [
            VectorAssembler(inputCols=filled, outputCol="_numbers"),
            StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        ]
        vectors = ["_scaled", *vectors]
    stages.append(VectorAssembler(inputCols=vectors, outputCol="features"))
    empty = Preparation(features, encoding, levels, literals, modes, means, by_fold, None, coded=coded)
    encoded = empty.encode(train, training=encoding == "target")
    medians = {}
    if numeric_inputs:
        medians = {c: found["median"] or 0.0 for c, found in column_quantiles(encoded, numeric_inputs, {"median": 0.5}).items()}
    empty = replace(empty, medians=medians)
    fitted = replace(empty, pipeline=Pipeline(stages=stages).fit(empty.fill(encoded)))
    scaler = [s for s in fitted.pipeline.stages if isinstance(s, StandardScalerModel)]
    if scaler:
        fitted = replace(fitted, scaling=[(float(m), 1 / float(d) if d else 0.0) for m, d in zip(scaler[0].mean, scaler[0].std)])
    return fitted


# --- fitting and scoring -------------------------------------------------------------------


@dataclass(frozen=True)
class Fitted:
    spec: Model
    features: Features
    preparation: Preparation | None
    model: object | None
    constant: float | None = None

    def score(self, rows: DataFrame, compact: bool = False) -> DataFrame:
        """Rows with ``score``: a probability, or a prediction on the original scale. ``compact`` as in ``Preparation.apply``."""
        if self.preparation is None:
            return rows.withColumn("score", F.lit(self.constant))
        return self.score_encoded(self.preparation.apply(rows, compact=compact), rows.columns)

    def score_encoded(self, rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """The same for rows that have their ``features`` already."""
        out = self.model.transform(rows)
        if self.spec.task == CLASSIFICATION:
            score = vector_to_array("probability")[1]
        else:
            score = F.greatest(F.expm1("prediction"), F.lit(0.0)) if self.spec.log_target else F.col("prediction")
        return out.select(*(rows.columns if columns is None else columns), score.alias("score"))

    def save(self, path: str) -> None:
        """Everything that scoring needs, under ``path``; ``load_fitted`` reads it back."""
        spec, prep = self.spec, self.preparation
        facts = {
            "name": spec.name, "task": spec.task, "encoding": spec.encoding, "balanced": spec.balanced,
            "log_target": spec.log_target, "early_stop": spec.early_stop, "params": dict(spec.params),
            "numeric": self.features.numeric, "categorical": self.features.categorical, "key": self.features.key,
            "label": self.features.label, "constant": self.constant, "fitted": prep is not None,
        }
        if prep is not None:
            facts |= {
                "literals": {c: list(pairs.items()) for c, pairs in prep.literals.items()},
                "modes": dict(prep.modes), "coded": dict(prep.coded), "medians": dict(prep.medians), "scaling": list(prep.scaling), "means": list(prep.means), "levels": prep.levels is not None,
            }
            prep.pipeline.write().overwrite().save(f"{path}/preparation")
            PipelineModel([self.model]).write().overwrite().save(f"{path}/model")
            if prep.levels is not None:
                prep.levels.write.mode("overwrite").parquet(f"{path}/levels")
            for c, means in prep.means.items():
                means.write.mode("overwrite").parquet(f"{path}/means_{c}")
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def load_fitted(spark: SparkSession, path: str) -> Fitted:
    """A saved model; it scores as the one that was saved."""
    facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
    build = {(m.name, m.task): m.build for m in (f() for f in KNOWN_MODELS)}.get((facts["name"], facts["task"]))
    spec = Model(
        facts["name"], facts["task"], build, facts["encoding"], facts["balanced"], facts["log_target"], facts["early_stop"], facts["params"]
    )
    features = Features(tuple(facts["numeric"]), tuple(facts["categorical"]), tuple(facts["key"]), facts["label"])
    if not facts["fitted"]:
        return Fitted(spec, features, None, None, facts["constant"])
    preparation = Preparation(
        features,
        spec.encoding,
        spark.read.parquet(f"{path}/levels") if facts["levels"] else None,
        {c: dict(pairs) for c, pairs in facts["literals"].items()},
        facts["modes"],
        {c: spark.read.parquet(f"{path}/means_{c}") for c in facts["means"]},
        {},
        PipelineModel.load(f"{path}/preparation"),
        facts["medians"],
        facts.get("coded", {}),
        facts.get("scaling", ()),
    )
    return Fitted(spec, features, preparation, PipelineModel.load(f"{path}/model").stages[0])


KNOWN_MODELS = (
    logistic, forest_classifier, boosting_classifier, target_boosting_classifier, dummy_classifier,
    ridge, forest_regressor, boosting_regressor, target_boosting_regressor, dummy_regressor,
)


@dataclass(frozen=True)
class Formula:
    """A score that is an expression of the features; explanations take it like a fitted model."""

    spec: Model
    features: Features
    expression: Column

    def score(self, rows: DataFrame) -> DataFrame:
        return rows.select("*", self.expression.alias("score"))


def class_weights(train: DataFrame, label: str) -> Column:
    """Weights that give both classes the same total."""
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, result = sum(counts.values()), F.lit(1.0)
    for value, n in counts.items():
        result = F.when(F.col(label) == value, F.lit(total / (len(counts) * n))).otherwise(result)
    return result


def fit(
    spec: Model,
    train: DataFrame,
    features: Features,
    *,
    validation: DataFrame | None = None,
    weight: str | None = None,
    winsor: tuple[float, float] | None = None,
    preparation: Preparation | None = None,
    ready: bool = False,
) -> Fitted:
    """Fit one model on training rows; a regression target may be clipped to training quantiles.

    ``preparation`` is that of another model fitted on the same rows, features, encoding and target.
    """
    prepared = {spec.encoding: preparation} if preparation else {}
    return fit_all([spec], train, features, validation=validation, weight=weight, winsor=winsor, prepared=prepared, ready=ready)[0]


def _read(rows: DataFrame, spec: Model, features: Features, weight: str | None) -> list[str]:
    """The columns that fitting reads: a constant only its label, out-of-fold encoding also the key."""
    if spec.build is None:
        return [features.label]
    names = [*features.columns(), features.label, *(features.key if spec.encoding == "target" else ()), *([weight] if weight else [])]
    return [c for c in dict.fromkeys(names) if c in rows.columns]


def fit_all(
    specs: Sequence[Model],
    train: DataFrame,
    features: Features,
    *,
    validation: DataFrame | None = None,
    weight: str | None = None,
    winsor: tuple[float, float] | None = None,
    prepared: Mapping[str, Preparation] | None = None,
    ready: bool = False,
) -> list[Fitted]:
    """The models of several specifications, fitted on the same rows.

    Rows of one encoding are prepared and encoded once and the encoded rows are stored: fits read them several times, and
    keep in memory only what they make of them. ``ready`` rows are read from a stored table already.
    """
    train = train.filter(F.col(features.label).isNotNull())
    if not ready:
        train = stored(train.select(*dict.fromkeys(c for spec in specs for c in _read(train, spec, features, weight))), "fit-rows")
    if winsor and any(spec.task == REGRESSION for spec in specs):
        bounds = column_quantiles(train, [features.label], {"low": winsor[0], "high": winsor[1]})[features.label]
    prepared, matrices, out = dict(prepared or {}), {}, []
    for spec in specs:
        own = train
        if winsor and spec.task == REGRESSION:
            own = train.withColumn(features.label, clip(F.col(features.label), F.lit(bounds["low"]), F.lit(bounds["high"])))
        if spec.build is None:
            out.append(Fitted(spec, features, None, None, _constant(spec, own, features.label)))
            continue
        if (spec.encoding, spec.task) not in matrices:
            if spec.encoding == "target":
                # stored: the folds are digests of the key
                own = folds(own, key=features.key, classes=features.label if spec.task == CLASSIFICATION else None)
                own = stored(own.withColumnRenamed("fold", "_fold").select("_fold", *_read(own, spec, features, weight)), "folded")
            if spec.encoding not in prepared:
                prepared[spec.encoding] = prepare(own, features, spec.encoding)
            matrices[(spec.encoding, spec.task)] = stored(
                prepared[spec.encoding].apply(own, training=True, compact=True).select("features", *dict.fromkeys([features.label, *([weight] if weight else [])])), "matrix", file_rows=min(FILE_ROWS, MATRIX_ROWS)
            )
        matrix = matrices[(spec.encoding, spec.task)]
        with read_by(matrix.sparkSession, -(-matrix.count() // MATRIX_ROWS)):
            out.append(_fit(spec, matrix, features, validation, weight, prepared[spec.encoding]))
    return out


def _fit(spec: Model, matrix: DataFrame, features: Features, validation: DataFrame | None, weight: str | None, preparation: Preparation) -> Fitted:
    target = F.col(features.label).cast("double")
    target = F.log1p(target) if spec.log_target else target
    own = F.coalesce(F.col(weight), F.lit(1.0)) if weight else F.lit(1.0)
    balance = class_weights(matrix, features.label) if spec.balanced else F.lit(1.0)
    data = matrix.select(
        "features", target.alias("label"), (own * balance).alias("weight"), F.lit(False).alias("is_validation")
    )
    extra = {}
    if spec.early_stop and validation is not None:
        held = preparation.apply(validation.filter(F.col(features.label).isNotNull())).select(
            "features", target.alias("label"), F.lit(1.0).alias("weight"), F.lit(True).alias("is_validation")
        )
        data = data.unionByName(held)
        extra["validationIndicatorCol"] = "is_validation"
    if spec.build in (GBTClassifier, GBTRegressor):
        ensure_checkpoint_dir(matrix.sparkSession)
    estimator = spec.build(featuresCol="features", labelCol="label", weightCol="weight", **extra, **dict(spec.params))
    return Fitted(spec, features, preparation, estimator.fit(data))


def _constant(spec: Model, train: DataFrame, label: str) -> float:
    if spec.task == CLASSIFICATION:
        row = train.agg(F.avg(F.col(label).cast("double")).alias("m")).first()
        return 1.0 if row["m"] is not None and row["m"] > 0.5 else 0.0
    return float(column_quantiles(train, [label], {"m": 0.5})[label]["m"])


def evaluate(scored: DataFrame, keys: Sequence[str], task: str, label: str = "label") -> DataFrame:
    """Metric rows of a long scored table."""
    if task == CLASSIFICATION:
        return mx.classification_report(scored, keys, label=label, score="score")
    return mx.regression_report(scored, keys, actual=label, predicted="score")


def train_models(
    split: DataFrame,
    features: Features,
    models: Sequence[Model],
    subsets: Mapping[str, Column],
    *,
    task: str,
    winsor: tuple[float, float] | None = None,
) -> tuple[DataFrame, dict[tuple[str, str], Fitted]]:
    """Fit every model on every subset; metric rows for the selection and test parts.

    ``split`` has the columns ``split`` and ``sample_weight``.
    """
    fitted: dict[tuple[str, str], Fitted] = {}
    scored = []
    # the rows are read for every subset and model: what these need is stored once
    flags = {f"_in{i}": test for i, test in enumerate(subsets.values())}
    read = dict.fromkeys(c for spec in models for c in _read(split, spec, features, "sample_weight"))
    split = stored(split.select("split", *read, *[test.alias(flag) for flag, test in flags.items()]), "split-rows")
    for subset, flag in zip(subsets, flags):
        rows = split.filter(flag)
        held = rows.filter(F.col("split").isin("selection", "test"))
        found = fit_all(
            models, rows.filter(F.col("split") == "train"), features, validation=rows.filter(F.col("split") == "calibration"),
            weight="sample_weight", winsor=winsor, ready=True,
        )
        encoded: dict[int, DataFrame] = {}
        for spec, model in zip(models, found):
            fitted[(spec.name, subset)] = model
            if model.preparation is None:
                own = model.score(held)
            else:
                # models of one preparation score the same encoded rows
                if id(model.preparation) not in encoded:
                    encoded[id(model.preparation)] = stored(model.preparation.apply(held, compact=True).select("split", features.label, "features"), "held")
                own = model.score_encoded(encoded[id(model.preparation)])
            scored.append(
                own.select(
                    F.lit(spec.name).alias("model_name"),
                    F.lit(subset).alias("animal_subset"),
                    F.col("split").alias("metric_split"),
                    F.col(features.label).alias("label"),
                    "score",
                )
            )
    # scoring is expensive and the metrics read the scores more than once
    long = stored(reduce(DataFrame.unionByName, scored), "scores")
    table = evaluate(long, ["model_name", "animal_subset", "metric_split"], task)
    return (
        table.withColumns(
            {
                "task": F.lit(task),
                "split_strategy": F.lit("time"),
                "target_column": F.lit(features.label),
                "selection_eligible": F.col("metric_split") == "selection",
            }
        ),
        fitted,
    )


def adopted_regression(
    split: DataFrame, features: Features, spec: Model, *, adopted: str, subsets: Mapping[str, Column]
) -> DataFrame:
    """Duration of positive episodes only, trained on log1p and scored back with expm1."""
    rows = split.filter((F.col(adopted) == 1) & F.col(features.label).isNotNull())
    table, _ = train_models(rows, features, [spec], subsets, task=REGRESSION)
    return table.withColumns(
        {"target_transform": F.lit("log1p"), "prediction_inverse_transform": F.lit("expm1")}
    )
