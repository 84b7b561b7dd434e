"""Tables and files in the cluster's shared folder.

Results that several plans read are written as Parquet under ``spark.checkpoint.dir`` and read
back: lineage is cut, lost executors lose nothing, and the planner knows the table's true size,
so it broadcasts a table only if its files are small.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sojourn.session import ensure_checkpoint_dir


TEXT_ROWS = 500


def new_path(spark: SparkSession, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid4().hex}"


def saved(rows: DataFrame, label: str) -> DataFrame:
    """The rows, written to a new table in the shared folder and read from there."""
    spark = rows.sparkSession
    path = new_path(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def small_batches(rows: DataFrame) -> DataFrame:
    """Rows with long texts go to Python a few hundred at a time: lowers the session's batch size if it is larger."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return rows


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives freed memory back: workers live on, and each would keep the most that any stage took."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU libc
            if trim:
                trim(0)

    return wrapped


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def document_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; whatever else a table carries stays out of the shuffles."""
    return docs.select(*[docs[f"`{c}`"] for c in columns])
