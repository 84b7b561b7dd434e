from pyspark.sql import functions as F

from sojourn.operators import encoders as en


def test_ordinal_codes_over_many_ranges(spark):
    """A million levels with one long common prefix beside a small column: no range holds many, numbers are those of a plain sort."""
    large = spark.range(1_000_000).select(F.lit("large").alias("column"), F.format_string("a long common prefix of all levels %07d", F.expr("id * 7919 % 1000000")).alias("level"))
    small = spark.createDataFrame([("small", x) for x in ("b", "é", "", "a", None, "B")], "column string, level string")
    codes = en.ordinal_map(large.unionByName(small), slice_rows=20_000).checkpoint()
    wrong = codes.filter("column = 'large' and cast(right(level, 7) as int) <> code").count()
    assert (codes.count(), wrong) == (1_000_005, 0)
    assert {r.level: r.code for r in codes.filter("column = 'small'").collect()} == {x: i for i, x in enumerate(["", "B", "a", "b", "é"])}


def test_ranges_of_levels_grow_with_their_number(spark, monkeypatch):
    asked = []
    plain = type(spark.range(1)).repartitionByRange
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda self, n, *by: asked.append(plain(self, n, *by)) or asked[-1])
    for n in (1000, 100_000):
        levels = spark.range(n).select(F.lit("x").alias("column"), F.format_string("same start %06d", "id").alias("level"))
        en.ordinal_map(levels, slice_rows=1000)
        largest = asked[-1].groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert largest <= 3000


def test_ordinal_codes_of_nothing(spark):
    empty = spark.createDataFrame([], "column string, level string")
    assert en.ordinal_map(empty).count() == 0
    assert en.ordinal_map(spark.createDataFrame([("c", None)], "column string, level string")).count() == 0
