"""Bounded tasks of a fit, quantiles per group without shuffling the rows, calibrated scores made once."""

from pyspark.sql import functions as F

from sojourn.operators import skew
from sojourn.plans import calibration as cal
from sojourn.plans import training as tr
from sojourn.session import read_by, stored


def _rows(spark, size=600):
    data = [(i, i % 7 + 0.5, "abcd"[i % 4], int(i % 4 < 1 or i % 7 > 4)) for i in range(size)]
    return spark.createDataFrame(data, "id bigint, n double, c string, label int")


def test_a_fit_reads_its_rows_in_tasks_of_bounded_size(spark, monkeypatch):
    sizes = []

    class Watched:
        def __init__(self, **params):
            pass

        def fit(self, data):
            sizes.extend(data.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect())
            return self

    monkeypatch.setattr(tr, "MATRIX_ROWS", 50)
    spec = tr.Model("watched", tr.CLASSIFICATION, Watched)
    tr.fit(spec, _rows(spark, 3000).coalesce(1), tr.Features(("n",), ("c",), ("id",), "label"))
    assert sum(sizes) == 3000 and max(sizes) <= 100
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_read_by_restores_the_setting(spark):
    table = stored(spark.range(1000).coalesce(1), "few", file_rows=10)
    before = table.select("id").rdd.getNumPartitions()
    with read_by(spark, 100):
        assert table.select("id").rdd.getNumPartitions() >= 50
    assert table.select("id").rdd.getNumPartitions() == before


def test_group_quantile_is_the_exact_one(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("g"), (F.col("id") % 5).cast("string"))).alias("g"),
        F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(1000 - F.lit(800) * (F.col("id") % 5 == 1).cast("int"))) / 7.0).alias("v"),
    ).unionByName(spark.createDataFrame([("nan", float("nan")), ("nan", 2.0), ("one", -1.0), ("none", None)], "g string, v double"))
    for share in (0.25, 1.0):
        want = {r.g: r.q for r in skew.exact_quantiles(rows, ["g"], "v", {"q": share}).collect()}
        # narrow brackets, whole groups, and brackets that miss
        for near, accuracy in ((0.05, 100), (skew.NEAR, skew.SKETCH), (0.0, 10)):
            got = {r.g: r.q for r in skew.group_quantile(rows, ["g"], "v", share, "q", near, accuracy).collect()}
            assert got == want


def test_group_quantile_shuffles_few_rows(spark, monkeypatch):
    kept = {}
    real = skew.stored

    def watched(rows, label, *rest):
        kept[label] = real(rows, label, *rest)
        return kept[label]

    monkeypatch.setattr(skew, "stored", watched)
    rows = spark.range(100_000).select((F.col("id") % 2).alias("g"), F.rand(3).alias("v"))
    skew.group_quantile(rows, ["g"], "v", 0.5, "q").collect()
    assert kept["near-quantiles"].count() < 1000


def test_calibrated_reports_read_stored_scores(spark, monkeypatch):
    found = {}

    def watched(scored, keys, task, label="label"):
        found["plan"] = scored._jdf.queryExecution().optimizedPlan().toString()
        return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    monkeypatch.setattr(cal, "evaluate", watched)
    rows = _rows(spark).withColumn("split", F.element_at(F.array(*[F.lit(s) for s in ("train", "calibration", "selection", "test")]), (F.floor(F.col("id") / 150) + 1).cast("int")))
    model = tr.fit(tr.forest_classifier(numTrees=2, maxDepth=2), rows.filter("split = 'train'"), tr.Features(("n",), ("c",), ("id",), "label"))
    out = cal.calibrated_reports(rows, {"all": model}, {"all": F.lit(True)}, label="label").collect()
    assert {(r.calibration_method, r.metric_split): r.n for r in out} == {(m, s): 150 for m in ("none", "isotonic", "sigmoid") for s in ("selection", "test")}
    assert "Join" not in found["plan"] and "Window" not in found["plan"]
