"""Session helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "sojourn", master: str | None = None, partitions: int | None = None, checkpoint_dir: str | None = None
) -> SparkSession:
    """A session with the settings the operators rely on; ``checkpoint_dir`` is the folder all executors share."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Local wall-clock arithmetic needs a zone without daylight saving."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, or a fresh one for a local run."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="run-")
    context.setCheckpointDir(folder)
    return folder


def stored(rows: DataFrame, label: str, form: str = "parquet", file_rows: int = 0) -> DataFrame:
    """The rows as a new table in the shared folder: computed once, read by column, and of a size the planner knows.

    ``file_rows`` bounds the rows of a file, 0 does not.
    """
    spark = rows.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid4().hex}"
    rows.write.format(form).option("maxRecordsPerFile", file_rows).save(path)
    return spark.read.schema(rows.schema).format(form).load(path)


@contextmanager
def read_by(spark: SparkSession, tasks: int) -> Iterator[None]:
    """Inside, stored files are read by about this many tasks or more, however few bytes they have."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    if tasks > int(before or spark.sparkContext.defaultParallelism):
        spark.conf.set(key, str(tasks))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
