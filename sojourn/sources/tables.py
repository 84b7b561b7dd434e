"""Reading and writing tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sojourn.session import pin_utc
from sojourn.sources.contracts import standard_names

# Accepted spellings of a boolean.
TRUE_WORDS = ("true", "1", "yes", "t", "y")
FALSE_WORDS = ("false", "0", "no", "f", "n")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{folder}/{name}.parquet")


def text_schema(names: Sequence[str]) -> StructType:
    return StructType([StructField(n, StringType(), True) for n in names])


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType) -> DataFrame:
    """CSV with a header under a declared schema, with snake_case names."""
    reader = pin_utc(spark).read.schema(schema).option("header", True).option("enforceSchema", False)
    return standard_names(reader.csv(path if isinstance(path, str) else list(path)))


def read_events(spark: SparkSession, path: str, schema: StructType, role: str) -> DataFrame:
    """Event CSV whose ``datetime`` column is renamed after its role (``intake``, ``outcome``, ...)."""
    rows = read_csv(spark, path, schema)
    wanted = f"{role}_datetime"
    if "datetime" in rows.columns and wanted not in rows.columns:
        rows = rows.withColumnRenamed("datetime", wanted)
    return rows


def strict_boolean(value: Column) -> Column:
    """True, false or null of a text; any other text is an error."""
    text = F.lower(F.trim(value.cast("string")))
    return (
        F.when(text.isNull(), F.lit(None).cast("boolean"))
        .when(text.isin(*TRUE_WORDS), F.lit(True))
        .when(text.isin(*FALSE_WORDS), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))
    )


def with_schema(rows: DataFrame, columns: Mapping[str, str], name: str = "table") -> DataFrame:
    """Check that the columns exist and cast each (``bool``, ``str``, ``int``, ``float``)."""
    missing = sorted(set(columns) - set(rows.columns))
    if missing:
        raise ValueError(f"{name} missing columns: {missing}")
    casts = {
        "bool": strict_boolean,
        "str": lambda c: c.cast("string"),
        "int": lambda c: c.cast("bigint"),
        "float": lambda c: c.cast("double"),
    }
    return rows.withColumns({c: casts[kind](F.col(c)) for c, kind in columns.items()})


def pruned(rows: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    kept = rows.select(*[c for c in columns if c in rows.columns])
    return kept if limit is None else kept.limit(limit)


def union_ragged(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of tables with different columns; absent ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_existing(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """Union of the parquet tables that exist."""
    found = [spark.read.parquet(p) for p in paths if path_exists(spark, p)]
    return union_ragged(found) if found else None


RUN = "run"


def write_table(rows: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def append_table(rows: DataFrame, path: str, run: str) -> None:
    """Adds the rows of one run to a table; a run that is repeated replaces what it wrote before.

    A run is a partition of the table, written by dynamic overwrite: the other runs stay, and a task or a job that is
    tried again leaves each row once. A run without rows leaves the table as it is.
    """
    if not run:
        raise ValueError("a run needs a name")
    named = rows.withColumn(RUN, F.lit(run))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN).parquet(path)


def read_appended(spark: SparkSession, path: str, runs: Sequence[str] | None = None) -> DataFrame:
    """The rows of all runs, or of some; the runs' name is the last column ``run``."""
    # names of runs are text, also those that look like numbers
    rows = spark.read.option("basePath", path).schema(_with_run(spark.read.parquet(path).schema)).parquet(path)
    return rows if runs is None else rows.filter(F.col(RUN).isin(list(runs)))


def _with_run(schema: StructType) -> StructType:
    return StructType([*[f for f in schema if f.name != RUN], StructField(RUN, StringType())])


def write_registry(spark: SparkSession, path: str, lists: Mapping[str, Sequence[str]]) -> None:
    """Column lists (features, targets, context) as one small JSON table."""
    lines = [(name, json.dumps(list(columns))) for name, columns in lists.items()]
    spark.createDataFrame(lines, "name string, columns string").coalesce(1).write.mode("overwrite").json(path)
