"""Isotonic regression by pooling adjacent violators in parallel.

The level sets of the regression over part of the points are parts of the level sets over all of them, so
pooling may start anywhere. Points are cut into slices of their order and pooled inside each; what is left are
blocks (sum, weight) in rising order, and only blocks at the border of two slices can violate it. Slices
whose borders lie in the middle of the former ones pool those, and so on until no border violates the order.
Blocks stay a table: nothing grows on the driver, and no task has more than a slice of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.operators.skew import SLICE_ROWS, with_slices
from sojourn.session import ensure_checkpoint_dir

BLOCKS = "low double, high double, total double, weight double, _half bigint"


def pool(rows: list[tuple[float, float, float, float, int]]) -> list[tuple[float, float, float, float, int]]:
    """Blocks (low, high, total, weight, number) in order, pooled until their means rise strictly."""
    out: list[tuple[float, float, float, float, int]] = []
    for low, high, total, weight, number in rows:
        while out and out[-1][2] * weight >= total * out[-1][3]:
            low, _, more, heavier, number = out.pop()
            total, weight = total + more, weight + heavier
        out.append((low, high, total, weight, number))
    return out


def _pool_slice(table: pa.Table) -> pa.Table:
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    rows = table.select(names).sort_by("low")
    done = pool(list(zip(*[rows.column(n).to_pylist() for n in names])))
    return pa.table([pa.array(list(c), rows.schema.field(n).type) for n, c in zip(names, zip(*done))], names)


def pooled_blocks(points: DataFrame, *, score: str, total: str, weight: str, slice_rows: int | None = None) -> DataFrame:
    """``low, high, total, weight, value``: the level sets of the isotonic regression over weighted points.

    ``points`` has one row per score, with the sum of the labels and of the weights; rows with a null in any of them
    or without weight are left out. No points give no blocks.
    """
    ensure_checkpoint_dir(points.sparkSession)
    rows_at_once = SLICE_ROWS if slice_rows is None else slice_rows
    cast = {n: F.col(c).cast("double") for n, c in (("low", score), ("high", score), ("total", total), ("weight", weight))}
    blocks = points.select(*[c.alias(n) for n, c in cast.items()]).filter("low is not null and total is not null and weight > 0")
    while True:
        blocks = with_slices(blocks, "low", max(rows_at_once // 2, 1), "_half")
        for shift in (0, 1):
            numbered = blocks.withColumn("_slice", F.floor((F.col("_half") + shift) / 2))
            blocks = numbered.groupBy("_slice").applyInArrow(_pool_slice, BLOCKS)
        blocks = blocks.checkpoint()
        if not _violated(blocks):
            return blocks.select("low", "high", "total", "weight", (F.col("total") / F.col("weight")).alias("value"))
        blocks = blocks.drop("_half")


def _violated(blocks: DataFrame) -> bool:
    """Whether the first block of a slice does not lie above the last block of the one before."""
    mean = F.col("total") / F.col("weight")
    edges = blocks.groupBy(F.floor((F.col("_half") + 1) / 2).alias("_slice")).agg(
        F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last")
    )
    in_order = Window.partitionBy(F.lit(0)).orderBy("_slice")  # one row per slice
    return not edges.select("first", F.lag("last").over(in_order).alias("before")).filter("before >= first").isEmpty()


def isotonic_values(rows: DataFrame, blocks: DataFrame, *, score: str, output: str, slice_rows: int | None = None) -> DataFrame:
    """``rows`` with the regression's value at their score: the block's, linear between blocks, the end blocks' beyond.

    Scores and block edges are counted once each and laid out in slices; what lies before and after a
    slice is handed to it, one row per slice. Null scores have no value.
    """
    marks = F.explode(
        F.array(F.struct(F.col("low").alias("at"), "value"), F.struct(F.col("high").alias("at"), "value"))
    )
    edges = blocks.select(marks.alias("m")).select(F.col("m.at").alias("at"), F.struct("m.at", "m.value").alias("mark")).distinct()
    asked = rows.select(F.col(score).cast("double").alias("at")).filter("at is not null").distinct()
    points = asked.withColumn("mark", F.lit(None).cast(edges.schema["mark"].dataType)).unionByName(edges)
    points = points.groupBy("at").agg(F.max("mark").alias("mark"))
    sliced = with_slices(points, "at", slice_rows, narrow=True)
    inside = Window.partitionBy("_slice").orderBy("at")
    before = inside.rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("_slice").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    per_slice = sliced.groupBy("_slice").agg(F.min("mark").alias("first"), F.max("mark").alias("last"))
    # one row per slice
    forward = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy(F.lit(0)).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select("_slice", F.max("last").over(forward).alias("_last"), F.min("first").over(backward).alias("_first"))
    local = sliced.select("_slice", "at", F.max("mark").over(before).alias("_under"), F.min("mark").over(after).alias("_over"))
    found = local.join(carried, "_slice").select(
        "at", F.coalesce("_under", "_last").alias("_under"), F.coalesce("_over", "_first").alias("_over")
    )
    low, high = F.col("_under"), F.col("_over")
    share = (F.col("at") - low["at"]) / F.nullif(high["at"] - low["at"], F.lit(0.0))
    value = (
        F.when(low.isNull(), high["value"])
        .when(high.isNull() | (low["at"] == high["at"]), low["value"])
        .otherwise(low["value"] + (high["value"] - low["value"]) * share)
    )
    values = found.select(F.col("at").alias("_at"), value.alias(output))
    keyed = rows.withColumn("_at", F.col(score).cast("double"))
    return keyed.join(values, "_at", "left").select(*rows.columns, output)
