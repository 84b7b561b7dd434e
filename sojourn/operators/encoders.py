"""Preprocessing fitted by aggregation: clipping, imputing, scaling, rare levels, target means."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions.clean import clip
from sojourn.operators.skew import SLICE_ROWS, exact_quantiles, null_safe_join
from sojourn.session import ensure_checkpoint_dir, stored
from sojourn.sources.contracts import check_no_leakage


def winsor_bounds(train: DataFrame, keys: Sequence[str], value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Quantile bounds of the training rows."""
    return exact_quantiles(train, keys, value, {"_low": low, "_high": high})


def winsorize(rows: DataFrame, bounds: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values clipped to the bounds of their group; nulls stay."""
    if keys:
        joined = null_safe_join(rows, bounds, keys, "left")
    else:
        # one row of bounds
        joined = rows.withColumn("_k", F.lit(0)).join(F.broadcast(bounds.withColumn("_k", F.lit(0))), "_k").drop("_k")
    return joined.withColumn(value, clip(F.col(value), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def numeric_fit(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median, and mean and deviation after filling with the median, one row per column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = train.select(pairs.alias("_p")).select("_p.column", "_p.v")
    medians = exact_quantiles(long, ["column"], "v", {"median": 0.5})
    sums = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("_n"), F.count("v").alias("_nv"), F.sum("v").alias("_s"), F.sum(F.col("v") * F.col("v")).alias("_q")
    )
    gaps = F.col("_n") - F.col("_nv")
    mean = (F.col("_s") + gaps * F.col("median")) / F.col("_n")
    square = (F.col("_q") + gaps * F.col("median") * F.col("median")) / F.col("_n")
    return sums.join(medians, "column").select(
        "column", "median", mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("deviation")
    )


def numeric_apply(rows: DataFrame, fit: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filled and standardised columns; the fit has one row per column and travels as literals."""
    table = {r["column"]: r for r in fit.collect()}
    out = {}
    for c in columns:
        r = table[c]
        scale = r["deviation"] or 1.0
        out[c] = (F.coalesce(F.col(c).cast("double"), F.lit(r["median"])) - F.lit(r["mean"])) / F.lit(scale)
    return rows.withColumns(out)


def level_counts(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns]))
    return train.select(pairs.alias("_p")).select("_p.column", "_p.level").groupBy("column", "level").agg(
        F.count(F.lit(1)).alias("records")
    )


def level_map(counts: DataFrame, min_records: int = 20, rare: str = "_rare") -> DataFrame:
    """Encoded name of each level: itself, or a shared name below ``min_records`` rows."""
    return counts.filter(F.col("level").isNotNull()).withColumn(
        "encoded", F.when(F.col("records") < min_records, rare).otherwise(F.col("level"))
    )


def level_modes(counts: DataFrame) -> dict[str, str]:
    """Most frequent level of every column: one small row per column."""
    modes = (
        counts.filter(F.col("level").isNotNull())
        .groupBy("column")
        .agg(F.max_by("level", F.struct("records", "level")).alias("mode"))
    )
    return {r["column"]: r["mode"] for r in modes.collect()}


def apply_levels(rows: DataFrame, levels: DataFrame, column: str, mode: str | None) -> DataFrame:
    """Nulls become the most frequent level, rare levels share one, unseen ones become null."""
    own = levels.filter(F.col("column") == column).select(F.col("level").alias("_level"), F.col("encoded").alias("_encoded"))
    filled = rows.withColumn("_level", F.coalesce(F.col(column).cast("string"), F.lit(mode)))
    return filled.join(own, "_level", "left").withColumn(column, F.col("_encoded")).drop("_level", "_encoded")


def apply_level_literals(rows: DataFrame, encoded: Mapping[str, str], column: str, mode: str | None) -> DataFrame:
    """The same for a column with few levels, without a join."""
    table = F.create_map(*[F.lit(x) for pair in encoded.items() for x in pair])
    return rows.withColumn(column, F.try_element_at(table, F.coalesce(F.col(column).cast("string"), F.lit(mode))))


def ordinal_map(counts: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Number of each level in the order of its name, per column, from the level table; null levels have none.

    Levels are dealt to ranges of about ``slice_rows`` names, numbered inside them, and moved up by the levels of the
    ranges before. The ranges are stored, as another sample of the names would draw other borders.
    """
    ensure_checkpoint_dir(counts.sparkSession)
    levels = counts.filter(F.col("level").isNotNull()).select("column", "level").checkpoint()
    ranges = levels.repartitionByRange(1 + levels.count() // slice_rows, "column", "level")
    sliced = ranges.withColumn("_slice", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy("column", "_slice").orderBy("level")
    earlier = Window.partitionBy("column").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy("column", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("column", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = sliced.withColumn("_at", F.row_number().over(inside) - 1)
    return local.join(before, ["column", "_slice"]).select("column", "level", (F.col("_at") + F.col("_before")).cast("int").alias("code"))


def level_codes(levels: DataFrame, rare: str = "_rare") -> DataFrame:
    """The level table with ``code``: the place of a level's encoded name among those of its column, from 0.

    Frequent levels find their code by their own name; the shared name has one code per column, which needs no join.
    """
    names = levels.select("column", F.col("encoded").alias("level")).distinct()
    codes = ordinal_map(names).checkpoint()
    shared = {r["column"]: r["code"] for r in codes.filter(F.col("level") == rare).collect()}
    own = F.lit(None).cast("int")
    for column, code in shared.items():
        own = F.when(F.col("column") == column, F.lit(code)).otherwise(own)
    joined = levels.join(codes, ["column", "level"], "left")
    return joined.withColumn("code", F.when(F.col("encoded") == rare, own).otherwise(F.col("code")))


def apply_codes(rows: DataFrame, levels: DataFrame, column: str, mode: str | None, unknown: int, name: str) -> DataFrame:
    """Adds ``name``: the code of the level, of the most frequent one for nulls, and ``unknown`` for unseen levels."""
    own = levels.filter(F.col("column") == column).select(F.col("level").alias("_level"), F.col("code").alias("_code"))
    filled = rows.withColumn("_level", F.coalesce(F.col(column).cast("string"), F.lit(mode)))
    return filled.join(own, "_level", "left").withColumn(name, F.coalesce("_code", F.lit(unknown)).cast("double")).drop("_level", "_code")


def ordinal_encode(rows: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """Level numbers; unknown levels are -1."""
    own = codes.filter(F.col("column") == column).select(F.col("level").alias("_level"), F.col("code").alias("_code"))
    joined = rows.withColumn("_level", F.col(column).cast("string")).join(own, "_level", "left")
    return joined.withColumn(column, F.coalesce(F.col("_code"), F.lit(-1))).drop("_level", "_code")


def _smoothed(total: Column, count: Column, prior: Column, smoothing: float) -> Column:
    return (total + smoothing * prior) / (count + smoothing)


def target_means(train: DataFrame, category: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """Smoothed target mean per level, with the overall mean alongside."""
    check_no_leakage([category])
    cells = train.filter(F.col(category).isNotNull()).groupBy(category).agg(
        F.sum(F.col(target).cast("double")).alias("_s"), F.count(target).alias("_n")
    )
    prior = train.agg(F.avg(F.col(target).cast("double")).alias("_prior"))
    # one row
    joined = cells.withColumn("_k", F.lit(0)).join(F.broadcast(prior.withColumn("_k", F.lit(0))), "_k")
    return joined.select(category, _smoothed(F.col("_s"), F.col("_n"), F.col("_prior"), smoothing).alias("encoded"), "_prior")


def target_tables(train: DataFrame, category: str, target: str, fold: str, smoothing: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """``target_means`` and ``out_of_fold_table`` from one pass over the rows, which stores the sums per (level, fold)."""
    check_no_leakage([category])
    value = F.col(target).cast("double")
    cells = stored(train.groupBy(category, fold).agg(F.sum(value).alias("_s"), F.count(target).alias("_n")), "target-sums")
    known = cells.filter(F.col(category).isNotNull()).groupBy(category).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    # one row
    prior = F.broadcast(cells.agg((F.sum("_s") / F.sum("_n")).alias("_prior")).withColumn("_k", F.lit(0)))
    means = known.withColumn("_k", F.lit(0)).join(prior, "_k").select(category, _smoothed(F.col("_s"), F.col("_n"), F.col("_prior"), smoothing).alias("encoded"), "_prior")
    return means, _outside_fold(cells, category, fold, smoothing)


def encode_target(rows: DataFrame, means: DataFrame, category: str, unknown: str = "null") -> DataFrame:
    """Encoding of new rows; unknown levels are null or the overall mean."""
    joined = rows.join(means.select(category, "encoded"), category, "left")
    if unknown == "null":
        return joined
    prior = means.select("_prior").first()
    return joined.withColumn("encoded", F.coalesce("encoded", F.lit(prior[0] if prior else None)))


def out_of_fold_table(
    train: DataFrame, category: str, target: str, fold: str, smoothing: float = 10.0
) -> DataFrame:
    """Encoding of every (level, fold) from the other folds only.

    Sums per (level, fold) minus the own fold give the level's sums outside it; the prior is the
    mean outside the fold. A level not seen outside the fold gets that prior.
    """
    check_no_leakage([category])
    cells = train.groupBy(category, fold).agg(
        F.sum(F.col(target).cast("double")).alias("_s"), F.count(target).alias("_n")
    )
    return _outside_fold(cells, category, fold, smoothing)


def _outside_fold(cells: DataFrame, category: str, fold: str, smoothing: float) -> DataFrame:
    levels = cells.groupBy(category).agg(F.sum("_s").alias("_ls"), F.sum("_n").alias("_ln"))
    per_fold = cells.groupBy(fold).agg(F.sum("_s").alias("_fs"), F.sum("_n").alias("_fn"))
    everything = per_fold.agg(F.sum("_fs").alias("_as"), F.sum("_fn").alias("_an"))
    # one row per fold
    priors = (
        per_fold.withColumn("_k", F.lit(0))
        .join(F.broadcast(everything.withColumn("_k", F.lit(0))), "_k")
        .select(fold, ((F.col("_as") - F.col("_fs")) / (F.col("_an") - F.col("_fn"))).alias("_prior"))
    )
    outside_n = F.col("_ln") - F.col("_n")
    return (
        null_safe_join(cells, levels, [category])
        .join(F.broadcast(priors), fold)
        .select(
            category,
            fold,
            F.when(F.col(category).isNull() | (outside_n == 0), F.col("_prior"))
            .otherwise(_smoothed(F.col("_ls") - F.col("_s"), outside_n, F.col("_prior"), smoothing))
            .alias("encoded"),
        )
    )


def encode_out_of_fold(
    train: DataFrame, category: str, target: str, fold: str, smoothing: float = 10.0
) -> DataFrame:
    """Training rows with the encoding of their level and fold."""
    return null_safe_join(train, out_of_fold_table(train, category, target, fold, smoothing), [category, fold], "left")


def mean_encoding(train: DataFrame, rows: DataFrame, category: str, target: str) -> DataFrame:
    """Plain mean per level; unseen levels get the mean of the level means."""
    means = train.filter(F.col(category).isNotNull()).groupBy(category).agg(F.avg(F.col(target).cast("double")).alias("encoded"))
    fallback = means.agg(F.avg("encoded").alias("_f"))
    joined = rows.join(means, category, "left").withColumn("_k", F.lit(0))
    # one row
    return (
        joined.join(F.broadcast(fallback.withColumn("_k", F.lit(0))), "_k")
        .withColumn("encoded", F.coalesce("encoded", "_f"))
        .drop("_k", "_f")
    )
