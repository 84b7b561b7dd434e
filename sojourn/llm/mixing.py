"""Mixing sources to target weights.

Tokens are added up per source, the target of each source gives its repetition rate, and a document
is emitted floor(rate) times plus once more with probability rate - floor(rate), decided by a hash of
the seed and its doc_id. Nothing depends on partitions or on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.store import saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_TIMES = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most_times: int = MOST_TIMES) -> DataFrame:
    """``source, source_size, target, rate`` from rows ``(source, size)``.

    Sources in code-point order, null last, take the weights in turn. Filled like water: every
    target is the smaller of ``most_times`` its source's size and weight x level, the level being
    such that the targets make up ``share`` of all sizes. One row per source meets in one task here.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * most_times)
    # with the sources in order of cap / weight, the level is the largest of what is left over for those that follow
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_ = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", left / open_).withColumn("level", F.max("level").over(whole))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    return per.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def copies(rate: Column, doc_id: Column, seed: int) -> Column:
    """floor(rate), and one more with probability equal to the fraction."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    draw = F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("bigint")


def mix_report(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most_times: int = MOST_TIMES, seed: int = 7) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs(doc_id, text, source)``.

    A null text has size 0; null is a source of its own; rows with equal doc_id share their draw; an
    empty table gives no rows; other columns are ignored.
    """
    sizes = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")
    )
    sizes = saved(sizes, "mixing-sizes")
    targets = saved(source_targets(sizes, weights, share, most_times), "mixing-targets").withColumnRenamed("source", "_source")
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most_times: int = MOST_TIMES, seed: int = 7) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as ``mix_report`` says, with all its columns.

    Rows of sources without words have rate 0 and are left out. A null text has size 0 and a null source is a source;
    rows with equal doc_id share their draw; a very long text counts all its words; an empty table gives no rows.
    Columns may have any names.
    """
    place = [c.lower() for c in docs.columns]
    rows = docs.toDF(*[f"_{i}" for i in range(len(place))])  # no name meets the operator's
    doc_id, source, text = (F.col(f"_{place.index(c)}") for c in ("doc_id", "source", "text"))
    sizes = rows.select(source.cast("string").alias("source"), word_count(text).alias("size"))
    targets = saved(source_targets(sizes, weights, share, most_times).select(F.col("source").alias("mixed"), "rate"), "mixing-targets")
    times = copies(F.col("rate"), doc_id, seed).cast("int")
    taken = rows.join(targets, source.cast("string").eqNullSafe(F.col("mixed"))).withColumn("copy", F.explode(F.array_repeat(F.lit(True), times)))
    return taken.select(*rows.columns).toDF(*docs.columns)
