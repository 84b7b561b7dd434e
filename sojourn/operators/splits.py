"""Time splits, hash-based random splits, folds, samples and training windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions.clean import recency_weight
from sojourn.operators.skew import micros, running_totals


@dataclass(frozen=True)
class Periods:
    """Inclusive year ranges of the four parts."""

    train: tuple[int, int] = (2013, 2021)
    calibration: tuple[int, int] = (2022, 2022)
    selection: tuple[int, int] = (2023, 2023)
    test: tuple[int, int] = (2024, 2025)

    def ranges(self) -> dict[str, tuple[int, int]]:
        return {"train": self.train, "calibration": self.calibration, "selection": self.selection, "test": self.test}


def subset_rows(rows: DataFrame, subset: str, *, entity_type: str, kinds: Mapping[str, str]) -> DataFrame:
    """Rows of one subset; ``combined`` keeps all."""
    name = (subset or "combined").lower()
    if name == "combined":
        return rows
    if name not in kinds:
        raise ValueError(f"subset must be one of {['combined', *kinds]}")
    return rows.filter(F.lower(F.col(entity_type)) == kinds[name])


def time_split(
    rows: DataFrame, *, year: str, target: str, periods: Periods = Periods(), weighted: bool = True
) -> DataFrame:
    """Rows with a target, their part of the timeline, and a recency weight on training rows."""
    part = None
    for name, (low, high) in periods.ranges().items():
        test = F.col(year).between(low, high)
        part = F.when(test, name) if part is None else part.when(test, name)
    labelled = rows.filter(F.col(target).isNotNull()).withColumn("split", part).filter(F.col("split").isNotNull())
    if not weighted:
        return labelled
    weight = recency_weight(F.col(year), *periods.train)
    return labelled.withColumn("sample_weight", F.when(F.col("split") == "train", weight))


def missing_parts(split: DataFrame, periods: Periods = Periods()) -> list[str]:
    """Names of empty parts, in order."""
    seen = {r["split"] for r in split.select("split").distinct().collect()}
    return [name for name in periods.ranges() if name not in seen]


def hash_share(key: Sequence[Column], seed: int = 42) -> Column:
    """A number in [0, 1) that depends on the key only."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def random_split(rows: DataFrame, *, key: Sequence[str], seed: int = 42) -> DataFrame:
    """80/20 into train and test, 20 % of the rest into calibration and selection.

    The share of a row is a hash of its key, so every class is split in the same proportions and
    the split does not change between runs.
    """
    u = hash_share([F.col(k) for k in key], seed)
    part = F.when(u < 0.20, "test").when(u < 0.28, "calibration").when(u < 0.36, "selection").otherwise("train")
    return rows.withColumn("split", part)


def make_split(
    rows: DataFrame,
    *,
    year: str,
    target: str,
    key: Sequence[str],
    periods: Periods = Periods(),
    weighted: bool = True,
    allow_random: bool = False,
) -> tuple[DataFrame, str]:
    """The time split, or the random one where allowed and a period is empty."""
    split = time_split(rows, year=year, target=target, periods=periods, weighted=weighted)
    missing = missing_parts(split, periods)
    if not missing:
        return split, "time"
    if not allow_random:
        low, high = periods.ranges()[missing[0]]
        raise ValueError(f"chronological split unavailable: missing {missing[0]} period {low}-{high}")
    return random_split(rows.filter(F.col(target).isNotNull()), key=key), "random_development_only"


def stratified_sample(rows: DataFrame, *, classes: str, key: Sequence[str], max_rows: int, seed: int = 42) -> DataFrame:
    """The same fraction of every class, close to ``max_rows`` rows in all, chosen by hash."""
    total = rows.count()
    if total <= max_rows:
        return rows
    chosen = hash_share([F.col(classes), *[F.col(k) for k in key]], seed) < F.lit(max_rows / total)
    return rows.filter(chosen)


def folds(rows: DataFrame, *, key: Sequence[str], k: int = 5, seed: int = 42, classes: str | None = None) -> DataFrame:
    """Shuffled fold number by hash, drawn separately per class when given."""
    parts = ([F.col(classes)] if classes else []) + [F.col(c) for c in key]
    return rows.withColumn("fold", F.floor(hash_share(parts, seed) * k).cast("int"))


def row_positions(rows: DataFrame, *, ts: str, tie: str, slice_rows: int | None = None) -> DataFrame:
    """Zero-based position of every row in the order (time, tie), without a global sort.

    ``tie`` is a number that is unique within a time; rows of one time are cut by it, so no instant is too large.
    """
    timed = rows.withColumn("_us", micros(F.col(ts)))
    per_time = timed.groupBy("_us").agg(F.count(F.lit(1)).alias("_n"))
    before = running_totals(per_time, [], "_us", {"t": "_n"}, slice_rows=slice_rows).select(
        "_us", F.col("t_before").alias("_before"), F.col("t_all").alias("total_rows")
    )
    inside = running_totals(timed.withColumn("_one", F.lit(1).cast("bigint")), ["_us"], tie, {"i": "_one"}, slice_rows=slice_rows)
    return (
        inside.join(before, "_us")
        .withColumn("position", F.col("_before") + F.col("i_before"))
        .drop("_us", "_one", "_before", "i_before", "i_all")
    )


def expanding_folds(rows: DataFrame, *, ts: str, tie: str, k: int = 3, slice_rows: int | None = None) -> DataFrame:
    """Block number 0..k of every row by time; fold f trains on blocks below f and validates on block f.

    Blocks 1..k have floor(n / (k + 1)) rows each, block 0 the earlier rest.
    """
    placed = row_positions(rows, ts=ts, tie=tie, slice_rows=slice_rows)
    size = F.floor(F.col("total_rows") / (k + 1))
    first = F.col("total_rows") - size * k
    block = F.when(F.col("position") < first, F.lit(0)).otherwise(
        F.floor((F.col("position") - first) / F.nullif(size, F.lit(0))) + 1
    )
    return placed.withColumn("block", block.cast("int")).drop("total_rows")


def backtest_windows(
    rows: DataFrame,
    *,
    year: str,
    target: str,
    subset: str,
    test_years: Sequence[int] | None = None,
    first_year: int,
    min_rows: int = 10,
) -> DataFrame:
    """Training and test sizes for every subset and test year, with a reason where a run is skipped.

    ``test_years`` defaults to every year of the data.

    Training years run from the subset's first year (not before ``first_year``) to the year before.
    """
    per_year = rows.filter(F.col(target).isNotNull()).groupBy(subset, F.col(year).alias("_y")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    early = F.min("_y")
    bounds = per_year.groupBy(subset).agg(early.alias("_first"), F.sum("_n").alias("eligible_target_count"))
    if test_years is None:
        # one row that lists the years
        years = per_year.agg(F.collect_set("_y").alias("_years")).withColumn("_k", F.lit(0))
        bounds = bounds.withColumn("_k", F.lit(0)).join(F.broadcast(years), "_k")
    else:
        bounds = bounds.withColumn("_years", F.array(*[F.lit(y) for y in test_years]))
    windows = bounds.select(subset, "_first", "eligible_target_count", F.explode("_years").alias("test_year")).withColumn(
        "_start", F.greatest("_first", F.lit(first_year))
    ).withColumn(
        "train_start_year", F.when(F.col("_start") > F.col("test_year") - 1, F.col("_first")).otherwise(F.col("_start"))
    )
    # years per subset are few: one row per (subset, year)
    counted = (
        windows.join(per_year, subset)
        .groupBy(subset, "test_year", "train_start_year", "eligible_target_count")
        .agg(
            F.sum(
                F.when(F.col("_y").between(F.col("train_start_year"), F.col("test_year") - 1), F.col("_n")).otherwise(F.lit(0))
            ).alias("train_rows"),
            F.sum(F.when(F.col("_y") == F.col("test_year"), F.col("_n")).otherwise(F.lit(0))).alias("test_rows"),
        )
        .filter(F.col("test_rows") > 0)
    )
    reason = F.when(F.col("train_rows") == 0, "Empty train set").when(
        (F.col("train_rows") < min_rows) | (F.col("test_rows") < min_rows), f"Insufficient data (<{min_rows} rows)"
    )
    return counted.withColumns(
        {
            "train_end_year": F.col("test_year") - 1,
            "train_years": F.concat_ws("-", F.col("train_start_year").cast("string"), (F.col("test_year") - 1).cast("string")),
            "skip_reason": reason,
            "status": F.when(reason.isNotNull(), "SKIPPED").otherwise("READY"),
        }
    )


@dataclass(frozen=True)
class Strategy:
    name: str
    first: int
    last: int
    weighted: bool


def recency_strategies(test_start: int, *, first_year: int = 2013, gap: int = 4) -> list[Strategy]:
    """Full history, the last five and three training years, and weighted history."""
    last = test_start - gap
    return [
        Strategy("full_history", first_year, last, False),
        Strategy("recent_5yr", max(first_year, last - 4), last, False),
        Strategy("recent_3yr", max(first_year, last - 2), last, False),
        Strategy("recency_weighted", first_year, last, True),
    ]


def strategy_rows(rows: DataFrame, strategies: Sequence[Strategy], *, year: str) -> DataFrame:
    """Training rows tagged with each strategy that uses them, and their weight."""
    tags = [
        F.when(
            F.col(year).between(s.first, s.last),
            F.struct(
                F.lit(s.name).alias("strategy"),
                (recency_weight(F.col(year), s.first, s.last) if s.weighted else F.lit(1.0)).alias("weight"),
            ),
        )
        for s in strategies
    ]
    return rows.withColumn("_s", F.explode(F.array_compact(F.array(*tags)))).select(
        *rows.columns, "_s.strategy", "_s.weight"
    )
