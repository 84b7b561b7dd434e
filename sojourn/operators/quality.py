"""Audits of tables: attrition, missing values, cardinality, leakage and follow-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.operators.ranking import first_per_group
from sojourn.operators.skew import stack_dimensions
from sojourn.sources.contracts import prohibited
from sojourn.sources.tables import union_ragged

# Words in start-time columns that hint at knowledge of the end.
SUSPICIOUS_WORDS: Mapping[str, Sequence[str]] = {
    "intake_condition": ("adopt", "adoption", "transfer"),
    "sex_upon_intake": ("spayed", "neutered"),
}


def value_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, value); counts are combined before the shuffle."""
    return (
        stack_dimensions(rows, columns, [])
        .groupBy("variable", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumnRenamed("variable", "feature")
    )


def _ordered_text(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, output: str) -> DataFrame:
    """The first n values of every group joined to one text (n is small and fixed)."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = first_per_group(rows, keys, order, n).withColumn("_i", position)
    listed = F.array_sort(F.collect_list(F.struct("_i", "value")))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda s: s["value"]), " | ").alias(output))


def missingness(rows: DataFrame, columns: Sequence[str], examples: int = 5) -> DataFrame:
    """Nulls, distinct values and a few example values per column, most missing first.

    Examples are the smallest values, so that they do not depend on row order.
    """
    counts = value_counts(rows, columns)
    per_column = counts.groupBy("feature").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(F.lit(0).cast("bigint"))).alias("missing_count"),
        F.round(
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(F.lit(0).cast("bigint"))) * 100.0 / F.sum("n"), 2
        ).alias("missing_percent"),
        F.count("value").alias("unique_values"),
    )
    shown = _ordered_text(counts.filter(F.col("value").isNotNull()), ["feature"], [F.col("value")], examples, "example_values")
    kinds = dict(rows.dtypes)
    dtype = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(kinds[c]))])[F.col("feature")]
    return (
        per_column.join(shown, "feature", "left")
        .withColumns({"dtype": dtype, "example_values": F.coalesce("example_values", F.lit(""))})
        .orderBy(F.desc("missing_percent"), "feature")
    )


def cardinality(rows: DataFrame, columns: Sequence[str], top: int = 10, rare_percent: float = 1.0) -> DataFrame:
    """Distinct values, the most frequent ones, and how many values are rare."""
    counts = value_counts(rows, columns).filter(F.col("value").isNotNull())
    totals = counts.groupBy("feature").agg(F.sum("n").alias("_total"))
    rare = (F.col("n") * 100.0 / F.col("_total") < rare_percent).cast("int")
    per_column = (
        counts.join(totals, "feature")
        .groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("unique_values"),
            F.sum(rare).alias("rare_category_count"),
            F.round(F.avg(rare) * 100, 1).alias("rare_category_percent"),
        )
    )
    most = _ordered_text(counts, ["feature"], [F.desc("n"), F.col("value")], top, f"top_{top}_values")
    return per_column.join(most, "feature").orderBy(F.desc("unique_values"), "feature")


def stage_counts(
    rows: DataFrame, stage: str, *, entity: str, entity_type: str | None, kinds: Mapping[str, str], ts: str | None
) -> DataFrame:
    """Rows, rows per kind, distinct and repeated entities and date range of one stage.

    Entities are counted per entity first, so the distinct count is an ordinary sum.
    """
    kind = F.lower(F.trim(F.col(entity_type).cast("string"))) if entity_type else None
    per_entity = rows.groupBy(entity).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(kind == value).alias(f"_{name}") for name, value in kinds.items() if kind is not None],
        *([F.min(ts).alias("_min"), F.max(ts).alias("_max")] if ts else []),
    )
    def day(fn, c):
        return fn(c).cast("date").cast("string") if ts else F.lit(None).cast("string")
    return per_entity.agg(
        F.lit(stage).alias("stage"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        *[
            (F.sum(f"_{name}") if kind is not None else F.lit(None).cast("bigint")).alias(f"{name}_rows")
            for name in kinds
        ],
        F.count(entity).alias("unique_entities"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_entity_ids"),
        day(F.min, "_min").alias("min_start_date"),
        day(F.max, "_max").alias("max_start_date"),
    )


def attrition(stages: Sequence[tuple[DataFrame, str | None, str]]) -> DataFrame:
    """Stage rows in order with the rows removed since a named earlier stage.

    ``stages`` holds (one-row counts, stage to compare with, reason).
    """
    numbered = union_ragged(
        [
            counts.withColumns(
                {"position": F.lit(i), "_from": F.lit(previous).cast("string"), "reason": F.lit(reason)}
            )
            for i, (counts, previous, reason) in enumerate(stages)
        ]
    )
    before = numbered.select(F.col("stage").alias("_from"), F.col("rows").alias("_before"))
    return (
        numbered.join(F.broadcast(before), "_from", "left")
        .withColumn("rows_removed", F.col("_before") - F.col("rows"))
        .drop("_from", "_before")
        .orderBy("position")
    )


def followup_audit(
    horizon_rows: DataFrame, horizons: Sequence[int], *, followup: str = "followup_days_available",
    adopted: str = "adopted", days: str = "days_to_outcome",
) -> DataFrame:
    """Labelled, censored, fully and shortly followed rows per horizon."""
    aggs = []
    for h in horizons:
        full = F.coalesce(F.col(followup) >= h, F.lit(False))
        labelled = F.col(f"adopted_in_{h}d").isNotNull()
        fast = F.coalesce(F.col(adopted) & (F.col(days) <= h), F.lit(False))
        aggs.append(
            F.struct(
                F.lit(h).alias("horizon_days"),
                F.count(F.lit(1)).alias("total_rows"),
                F.count_if(labelled).alias("included_rows"),
                F.count_if(~labelled).alias("censored_rows"),
                F.count_if(~labelled).alias("excluded_rows"),
                F.count_if(full).alias("full_followup_rows"),
                F.count_if(~full).alias("short_followup_rows"),
                F.count_if(~full & fast).alias("fast_adopted_short_followup_rows"),
            )
        )
    return horizon_rows.agg(F.array(*aggs).alias("_h")).select(F.explode("_h").alias("_h")).select("_h.*")


def leakage_by_data(
    rows: DataFrame, columns: Sequence[str], words: Mapping[str, Sequence[str]] = SUSPICIOUS_WORDS
) -> DataFrame:
    """Risk level of start-time columns judged by their values, from one wide aggregate.

    Unsafe: all null, a single value, or a timestamp. Needs audit: values with suspicious words.
    """
    kinds = dict(rows.dtypes)
    aggs = []
    for c in columns:
        text = F.lower(F.col(c).cast("string"))
        hit = F.lit(False)
        for word in words.get(c, ()):
            hit = hit | F.contains(text, F.lit(word))
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("non_null"),
                F.coalesce(F.min(text) == F.max(text), F.lit(True)).alias("constant"),
                F.lit(kinds[c].startswith("timestamp")).alias("is_time"),
                F.coalesce(F.bool_or(hit), F.lit(False)).alias("suspicious"),
            )
        )
    long = rows.agg(F.array(*aggs).alias("_a")).select(F.explode("_a").alias("_a")).select("_a.*")
    risk = (
        F.when(F.col("suspicious"), "needs_audit")
        .when((F.col("non_null") == 0) | F.col("constant") | F.col("is_time"), "unsafe")
        .otherwise("probably_safe")
    )
    return long.withColumn("risk_level", risk)


def leakage_roles(
    rows: DataFrame, *, features: Sequence[str], targets: Sequence[str], metadata: Sequence[str], extra_prohibited: Sequence[str] = ()
) -> DataFrame:
    """One row per column of the table with its role and whether it breaks the feature rules."""
    table = []
    for c in sorted(rows.columns):
        is_feature, banned = c in features, bool(prohibited([c], extra_prohibited))
        if is_feature:
            role = "predictor and prohibited" if banned else "predictor"
        else:
            role = "target" if c in targets else "metadata" if c in metadata else "other"
        risk = "unsafe" if banned else "safe" if is_feature else "unsafe"
        table.append((c, role, is_feature, c in targets, c in metadata, banned, is_feature and banned, is_feature and not banned, risk))
    return rows.sparkSession.createDataFrame(
        table,
        "column string, role string, in_features boolean, in_targets boolean, in_metadata boolean, "
        "in_prohibited boolean, leakage_violation boolean, allowed_as_predictor boolean, risk_level string",
    )


def leakage_audit(
    rows: DataFrame,
    *,
    features: Sequence[str],
    targets: Sequence[str],
    metadata: Sequence[str],
    audited: Sequence[str],
    extra_prohibited: Sequence[str] = (),
    words: Mapping[str, Sequence[str]] = SUSPICIOUS_WORDS,
) -> DataFrame:
    """Roles of all columns; audited columns get the risk level their values show."""
    roles = leakage_roles(rows, features=features, targets=targets, metadata=metadata, extra_prohibited=extra_prohibited)
    by_data = leakage_by_data(rows, audited, words).select("column", F.col("risk_level").alias("_seen"))
    # one row per audited column
    return (
        roles.join(F.broadcast(by_data), "column", "left")
        .withColumn("risk_level", F.coalesce("_seen", "risk_level"))
        .drop("_seen")
    )


def require_no_unsafe(audit: DataFrame, columns: Sequence[str]) -> None:
    bad = [r["column"] for r in audit.filter(F.col("risk_level") == "unsafe").collect() if r["column"] in set(columns)]
    if bad:
        raise ValueError(f"unsafe columns: {sorted(bad)}")
