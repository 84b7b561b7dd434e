"""Exact duplicates by stateful streaming.

Digest rows of the documents are streamed into a keyed aggregation whose state lives in RocksDB,
never expires, and keeps for every digest the holder (largest doc_id with the locator of its content:
file and row) and the number of rows. The finished state is read back from the stream's checkpoint. A
digest seen more than once is a hit: the full text of each of its rows is compared with the holder's,
and rows that differ in spite of an equal digest are grouped again by their text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm.store import new_path, saved

# State on disk, without space laid out ahead for every one of many small stores; their memory is bounded for all of an executor.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    # executors close the stores of an ended stream at the next maintenance
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}

# Rows of one group that are compared with one copy of the holder's text.
SPLIT_ROWS = 256


def with_locator(docs: DataFrame) -> DataFrame:
    """The rows with ``_file`` and ``_row``, where their content lies; rows that come from no file are written first."""

    def pick(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))

    try:
        return pick(docs)
    except AnalysisException:
        return pick(saved(docs, "located"))


def packed(docs: DataFrame) -> DataFrame:
    """Located rows whose columns other than doc_id and text have names that meet no others."""
    return with_locator(docs.toDF(*[c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)]))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Packed rows with the columns of ``docs`` again."""
    return rows.drop("_file", "_row").toDF(*docs.columns)


def located(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (null as empty) and the locator of each row."""
    return with_locator(docs.select("doc_id", "text")).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("_file").alias("file"),
        F.col("_row").alias("row"),
    )


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _state_of(spark: SparkSession, path: str, schema, files_per_batch: int) -> DataFrame:
    """``digest, holder, n`` of all rows under ``path`` after the stream has taken them in."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    kept = stream.groupBy("digest").agg(
        F.max(F.struct("doc_id", "file", "row")).alias("holder"), F.count(F.lit(1)).alias("n")
    )
    checkpoint = new_path(spark, "exact-state")
    writer = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    state = spark.read.format("statestore").load(checkpoint)
    holder, n = (f"value.`{f.name}`" for f in state.schema["value"].dataType.fields)
    return state.select("key.digest", F.col(holder).alias("holder"), F.col(n).alias("n"))


def exact_duplicates(
    docs: DataFrame, *, digest: Callable[[Column], Column] | None = None, files_per_batch: int = 1000
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs(doc_id, text)``.

    Equal texts form a group and the row with the largest doc_id stays; a null text counts as empty.
    Of rows that repeat that doc_id one stays (the last by locator); null doc_ids come first, so they
    stay only where no other row is in the group. An empty table gives no rows; other columns are
    ignored. ``digest`` derives the state's key from the SHA-256 (default: the hash itself); whatever
    it is, the full texts decide.
    """
    rows = _judged(docs, digest, files_per_batch)
    return rows.select(
        "doc_id",
        F.col("holder.doc_id").alias("keep_id"),
        F.col("n").cast("bigint").alias("group_size"),
        _is_holder().alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def distinct_texts(docs: DataFrame, files_per_batch: int = 1000) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, one for every text, with all their columns."""
    rows = packed(docs)
    gone = _judged(rows, None, files_per_batch).filter(~_is_holder()).select(F.col("file").alias("_file"), F.col("row").alias("_row"))
    return unpacked(without(rows, gone), docs)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Located rows without those whose locators are listed."""
    return rows.join(saved(gone, "gone"), ["_file", "_row"], "left_anti").select(*rows.columns)


def _is_holder() -> Column:
    return (F.col("file") == F.col("holder.file")) & (F.col("row") == F.col("holder.row"))


def _judged(docs: DataFrame, digest: Callable[[Column], Column] | None, files_per_batch: int) -> DataFrame:
    """Locator, doc_id and sha of every row with the holder of its text and the number of rows that have it."""
    spark = docs.sparkSession
    texts = located(docs).withColumn("sha", F.unhex(F.sha2("text", 256)))
    texts = texts.withColumn("digest", digest(F.col("sha")) if digest else F.col("sha"))
    path = new_path(spark, "exact-digests")
    texts.drop("text").write.parquet(path)
    staged = spark.read.schema(texts.drop("text").schema).parquet(path)
    if not len(staged.inputFiles()):
        return staged.withColumns({"holder": F.struct("doc_id", "file", "row"), "n": F.lit(1).cast("bigint")})
    with state_on_disk(spark):
        state = saved(_state_of(spark, path, staged.schema, files_per_batch), "exact-holders")

    hits = texts.drop("sha").join(state.filter("n > 1"), "digest")
    hits = hits.withColumns(
        {
            "parts": F.ceil(F.col("n") / SPLIT_ROWS).cast("int"),
            "is_holder": _is_holder(),
        }
    )
    hits = saved(hits, "exact-hits")  # their texts, moved once
    held = hits.filter("is_holder").select(
        "digest", F.col("text").alias("held"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    dealt = hits.filter("not is_holder").withColumn("part", F.pmod(F.xxhash64("file", "row"), F.col("parts")).cast("int"))
    differing = dealt.join(held, ["digest", "part"]).filter("text <> held").select("digest", "doc_id", "file", "row", "text")
    differing = saved(differing, "exact-differing")

    regrouped = differing.groupBy("digest", "text").agg(
        F.max(F.struct("doc_id", "file", "row")).alias("own_holder"), F.count(F.lit(1)).alias("own_n")
    )
    moved = differing.join(regrouped, ["digest", "text"]).select("file", "row", "own_holder", "own_n")
    gone = differing.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
    rows = staged.join(state, "digest").join(gone, "digest", "left").join(moved, ["file", "row"], "left")
    return rows.withColumns(
        {
            "holder": F.coalesce("own_holder", "holder"),
            "n": F.coalesce("own_n", F.col("n") - F.coalesce("gone", F.lit(0))),
        }
    )
