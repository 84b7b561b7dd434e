"""Views of the test tables shared by several query modules.

Order lines stand in for scored episodes: the start is the order date, the end the ship
date, a returned line is the positive class, and the discount is the score (few distinct
values, so ties abound). Durations are whole days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.sources.tables import read_table

LINES_SQL = """
lines as (
  select l_orderkey, l_linenumber, l_suppkey, l_partkey, o_custkey, l_linestatus, o_orderstatus, o_orderpriority,
         case l_returnflag when 'R' then 'Adoption' when 'A' then 'Transfer' else 'Euthanasia' end as end_type,
         (l_returnflag = 'R')::INTEGER as label, date_diff('day', o_orderdate, l_shipdate)::BIGINT as days,
         year(l_shipdate)::INTEGER as ship_year, year(o_orderdate)::INTEGER as order_year, o_orderdate,
         round(l_discount * 10, 2) as score, l_quantity * 10 as predicted_days
  from lineitem join orders on l_orderkey = o_orderkey)
"""

SCORED_SQL = f"""{LINES_SQL},
scored as (select *, (score >= 0.5)::INTEGER as predicted, abs(days - predicted_days) as absolute_error from lines)
"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    items = read_table(spark, folder, "lineitem")
    flag = F.col("l_returnflag")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "o_custkey", "l_linestatus", "o_orderstatus", "o_orderpriority",
        F.when(flag == "R", "Adoption").when(flag == "A", "Transfer").otherwise("Euthanasia").alias("end_type"),
        (flag == "R").cast("int").alias("label"),
        F.datediff("l_shipdate", "o_orderdate").cast("bigint").alias("days"),
        F.year("l_shipdate").alias("ship_year"),
        F.year("o_orderdate").alias("order_year"),
        "o_orderdate",
        F.round(F.col("l_discount") * 10, 2).alias("score"),
        (F.col("l_quantity") * 10).alias("predicted_days"),
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).withColumns(
        {
            "predicted": (F.col("score") >= 0.5).cast("int"),
            "absolute_error": F.abs(F.col("days") - F.col("predicted_days")),
        }
    )


def stays(spark: SparkSession, folder: str) -> DataFrame:
    """Lines shipped on or after the order date."""
    return lines(spark, folder).filter(F.col("days") >= 0)


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, counts as bigint: results that two engines can agree on."""
    return rows.select(
        *[
            F.round(c, digits).alias(c) if kind == "double" else F.col(c)
            for c, kind in rows.dtypes
        ]
    )
