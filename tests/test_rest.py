import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sojourn.functions import clean as cl
from sojourn.functions import labels as lb
from sojourn.functions import text as tx
from sojourn.operators import encoders as en
from sojourn.operators import quality as ql
from sojourn.operators import splits as sp
from sojourn.operators import survival as sv
from sojourn.operators.similar import similar_cases
from sojourn.plans import explain
from sojourn.plans import training as tr
from sojourn.plans.dataset import build_dataset, snapshot_date, write_dataset
from sojourn.sources import contracts, tables


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "text, want",
    [
        ("2015-07-05T15:13:00-05:00", datetime(2015, 7, 5, 15, 13)), ("2015-07-05 15:13:00", datetime(2015, 7, 5, 15, 13)),
        ("07/05/2015 03:13:00 PM", datetime(2015, 7, 5, 15, 13)), ("2015-07-05", datetime(2015, 7, 5)), ("bad", None), (None, None),
    ],
)
def test_wall_clock(spark, text, want):
    assert one(spark, text, cl.parse_wall_clock) == want


@pytest.mark.parametrize(
    "text, want", [("2 years", 730.5), ("7 months", 213.0625), ("1 week", 7.0), ("-1 years", None), ("3 moons", None), (None, None)]
)
def test_age(spark, text, want):
    assert one(spark, text, tx.age_days) == want


@pytest.mark.parametrize(
    "text, color, breed, mixed",
    [
        ("Black/White", "black_or_dark", "black", True), ("Pit Bull Mix", "mixed_other", "pit_bull", True),
        ("Seal Point", "brown_tan", "seal_point", False), ("", "unknown", "unknown", False), (None, "unknown", "unknown", False),
    ],
)
def test_text_rules(spark, text, color, breed, mixed):
    assert (one(spark, text, tx.color_group), one(spark, text, tx.primary_breed), one(spark, text, tx.is_mixed_breed)) == (color, breed, mixed)


@pytest.mark.parametrize(
    "text, kind, area",
    [
        ("123 Main St in Austin (TX)", "address_like", "austin"), ("Outside Jurisdiction", "outside_jurisdiction", "unknown"),
        ("Oak & Elm in Travis (TX)", "intersection", "travis"), ("Austin (TX)", "austin_city", "austin"),
        ("Del Valle (TX)", "county_or_region", "del_valle"), ("somewhere", "other", "unknown"), (None, "other", "unknown"),
    ],
)
def test_location(spark, text, kind, area):
    def kinds(c):
        a = tx.location_area(c)
        return tx.location_kind(c, tx.location_flags(c, area=a), a)

    assert (one(spark, text, kinds), one(spark, text, tx.location_area)) == (kind, area)


@pytest.mark.parametrize("days, want", [(None, "unknown"), (-1.0, "invalid"), (7.0, "0-7d"), (7.1, "8-30d"), (90.0, "61-90d"), (91.0, "90+d")])
def test_buckets(spark, days, want):
    assert one(spark, days, lb.days_bucket, "double") == want


def test_regime_cuts(spark):
    for text, want in [("2020-02-29", "pre_covid"), ("2020-03-01", "covid"), ("2022-01-01", "post_covid")]:
        assert one(spark, datetime.fromisoformat(text), tx.regime, "timestamp_ntz") == want


def test_contracts(spark):
    rows = spark.createDataFrame([(1,)], "`Animal ID` int")
    assert contracts.standard_names(rows).columns == ["animal_id"] and contracts.snake_case(" a/b  C-d ") == "a_b_c_d"
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        contracts.require_columns(rows, {"c", "b"}, "t")
    with pytest.raises(ValueError):
        contracts.check_no_leakage(["age_days", "next_start"])
    assert contracts.first_existing(rows, ["x", "animal_id"]) == "Animal ID"


def test_strict_boolean_rejects_other_words(spark):
    assert one(spark, " Yes", tables.strict_boolean) is True and one(spark, None, tables.strict_boolean) is None
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, "maybe", tables.strict_boolean)


def test_product_limit(spark):
    rows = [(1.0, 1), (2.0, 0), (2.0, 1), (3.0, 1), (5.0, 1)]
    df = spark.createDataFrame(rows, "t double, e int")
    got = {r.time: (r.at_risk, r.survival_probability, r.cumulative_hazard) for r in sv.product_limit(df, [], time="t", event="e").collect()}
    assert got[1.0][:2] == (5, pytest.approx(0.8)) and got[2.0][:2] == (4, pytest.approx(0.6)) and got[3.0][:2] == (2, pytest.approx(0.3))
    assert got[5.0] == (1, 0.0, math.inf)
    at = {r.days: (round(r.survival_probability, 6), r.n_at_risk) for r in sv.survival_table(df, [], time="t", event="e", times=[0, 2, 4, 9]).collect()}
    assert at == {0.0: (1.0, 5), 2.0: (0.6, 4), 4.0: (0.3, 2), 9.0: (0.0, 1)}


def test_chi_square_tail():
    assert sv.chi_square_tail(15.507, 8) == pytest.approx(0.05, abs=1e-4)
    assert sv.chi_square_tail(14.067, 7) == pytest.approx(0.05, abs=1e-4)


def test_time_split_and_missing_period(spark):
    years = [2013, 2021, 2022, 2023, 2024, 2025, 2012]
    rows = spark.createDataFrame([(y, 1, i) for i, y in enumerate(years)], "intake_year int, y int, id int")
    got = {r.intake_year: (r.split, r.sample_weight) for r in sp.time_split(rows, year="intake_year", target="y").collect()}
    assert got == {
        2013: ("train", 1.0), 2021: ("train", 1.5), 2022: ("calibration", None), 2023: ("selection", None),
        2024: ("test", None), 2025: ("test", None),
    }
    with pytest.raises(ValueError, match="calibration"):
        sp.make_split(rows.filter("intake_year <> 2022"), year="intake_year", target="y", key=["id"])
    _, how = sp.make_split(rows.filter("intake_year <> 2022"), year="intake_year", target="y", key=["id"], allow_random=True)
    assert how == "random_development_only"


def test_positions_with_one_crowded_instant(spark):
    rng = random.Random(1)
    rows = [(datetime(2024, 1, 1 + (0 if rng.random() < 0.5 else rng.randrange(9))), i) for i in rng.sample(range(10000), 300)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id int")
    got = {(r.ts, r.id): r.position for r in sp.row_positions(df, ts="ts", tie="id").collect()}
    assert [got[k] for k in sorted(rows)] == list(range(300))


def test_out_of_fold_encoding_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("aaab") if i else "rare", int(rng.random() < 0.4), i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, c string, y int, f int")
    for r in en.encode_out_of_fold(df, "c", "y", "f").collect():
        rest = [x for x in rows if x[3] != r.f]
        prior = sum(x[2] for x in rest) / len(rest)
        mine = [x[2] for x in rest if x[1] == r.c]
        want = (sum(mine) + 10 * prior) / (len(mine) + 10) if mine else prior
        assert r.encoded == pytest.approx(want)
    means = en.target_means(df, "c", "y")
    new = spark.createDataFrame([("a",), ("zzz",)], "c string")
    assert {r.c: r.encoded is None for r in en.encode_target(new, means, "c").collect()} == {"a": False, "zzz": True}
    assert all(r.encoded is not None for r in en.encode_target(new, means, "c", unknown="mean").collect())


def test_similar_cases_fall_back(spark):
    history = spark.createDataFrame(
        [("Dog", "baby", 1, 10.0, "Adoption"), ("Dog", "baby", 0, 20.0, "Transfer"), ("Dog", None, 1, 60.0, "Adoption")],
        "kind string, age string, y int, d double, t string",
    )
    asked = spark.createDataFrame([(1, "Dog", "baby"), (2, "Dog", "old"), (3, "Dog", None), (4, "Cat", "x")], "id int, kind string, age string")
    out = similar_cases(
        history, asked, profile_id="id", tiers=(("exact", ("kind", "age")), ("coarse", ("kind",))), label="y", days="d",
        end_type="t", end_types={"adoption": "Adoption"},
    ).collect()
    got = {r.id: (r.similar_records, r.matching_level, r.median_days_to_outcome) for r in out}
    assert got == {1: (2, "exact", 15.0), 2: (3, "coarse", 20.0), 3: (1, "exact", 60.0)}


def test_missingness_and_leakage(spark):
    rows = spark.createDataFrame([("a", None, 1), ("b", None, 1)], "x string, y string, z int")
    got = {r.feature: (r.missing_count, r.unique_values, r.example_values) for r in ql.missingness(rows, ["x", "y"]).collect()}
    assert got == {"x": (0, 2, "a | b"), "y": (2, 0, "")}
    risk = {r.column: r.risk_level for r in ql.leakage_by_data(rows, ["x", "y", "z"]).collect()}
    assert risk == {"x": "probably_safe", "y": "unsafe", "z": "unsafe"}
    with pytest.raises(ValueError, match="'y'"):
        ql.require_no_unsafe(ql.leakage_by_data(rows, ["x", "y", "z"]), ["x", "y"])


RAW_INTAKES = [
    ("A1", "Rex", "Dog", "2020-01-01 10:00:00", "Stray", "Normal", "Intact Male", "2 years", "Pit Bull Mix", "Black/White", "Austin (TX)"),
    ("A2", None, "Cat", "01/02/2020 08:00:00 AM", "Stray", "Sick", "Unknown", "3 weeks", "Domestic Shorthair", "Calico", "Travis (TX)"),
    ("A3", "Bun", "Rabbit", "2020-01-03 10:00:00", "Stray", "Normal", "Unknown", "1 year", "Rabbit", "White", "Austin (TX)"),
    ("A4", "Late", "Dog", "2020-03-20 10:00:00", "Stray", "Normal", "Unknown", "1 year", "Beagle Hound", "Tan", "Austin (TX)"),
]
RAW_OUTCOMES = [
    ("A1", "Dog", "2020-01-05T10:00:00-06:00", "Adoption", None), ("A2", "Cat", "2020-01-04 08:00:00", "Transfer", "Partner"),
    ("A3", "Rabbit", "2020-01-04 08:00:00", "Adoption", None),
]


def raw_frames(spark):
    intakes = spark.createDataFrame(
        RAW_INTAKES,
        "animal_id string, name string, animal_type string, intake_datetime string, intake_type string, intake_condition string, "
        "sex_upon_intake string, age_upon_intake string, breed string, color string, found_location string",
    )
    outcomes = spark.createDataFrame(
        RAW_OUTCOMES, "animal_id string, animal_type string, outcome_datetime string, outcome_type string, outcome_subtype string"
    )
    return intakes, outcomes


def test_dataset_end_to_end(spark, tmp_path):
    intakes, outcomes = raw_frames(spark)
    assert snapshot_date(intakes, outcomes) == datetime(2020, 3, 20, 10)
    built = build_dataset(intakes, outcomes, extract_end=datetime(2020, 3, 31))
    rows = {r.animal_id: r for r in built.dataset.collect()}
    assert len(built.dataset.columns) == 50 and set(rows) == {"A1", "A2"}
    assert rows["A1"].days_to_outcome == 4.0 and rows["A1"].classification_target == 1 and rows["A2"].days_to_adoption is None
    assert built.unresolved.first().animal_id == "A4" and built.conservation.first().conserved

    folder = str(tmp_path / "out")
    write_dataset(intakes, outcomes, folder, extract_end=datetime(2020, 3, 31))
    assert spark.read.parquet(f"{folder}/episodes").count() == 2
    assert spark.read.parquet(f"{folder}/horizon").count() == 3
    lists = {r.name: r.columns for r in spark.read.json(f"{folder}/columns").collect()}
    assert "age_days" in lists["feature_columns"] and "outcome_type" not in lists["feature_columns"]


def test_csv_source(spark, tmp_path):
    path = str(tmp_path / "in")
    raw = spark.createDataFrame([("A1", "2020-01-01")], "`Animal ID` string, DateTime string")
    tables.write_table(raw, path, "csv")
    rows = tables.read_events(spark, path, tables.text_schema(["Animal ID", "DateTime"]), "intake")
    assert rows.columns == ["animal_id", "intake_datetime"] and rows.count() == 1
    assert tables.read_existing(spark, [str(tmp_path / "none")]) is None


def test_a_repeated_run_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "table")
    part = lambda a, b: spark.range(a, b).toDF("v")
    tables.append_table(part(0, 5), path, "2024")
    tables.append_table(part(5, 9), path, "0007")
    tables.append_table(part(0, 3), path, "2024")
    tables.append_table(part(0, 0), path, "0007")  # no rows: nothing is replaced
    back = sorted(tuple(r) for r in tables.read_appended(spark, path).collect())
    assert back == sorted([(v, "2024") for v in range(3)] + [(v, "0007") for v in range(5, 9)])
    assert tables.read_appended(spark, path, ["0007"]).count() == 4
    with pytest.raises(ValueError, match="name"):
        tables.append_table(part(0, 1), path, "")


def test_reasons_are_found_within_rows(spark):
    """No copy and no shuffle: the plan of the contributions has neither a generator nor an exchange."""
    features = tr.Features(("a", "b"), ("c",), ("k",), "y")
    score = F.col("a") * 2 + F.col("b") - F.when(F.col("c") == "x", 3.0).otherwise(0.0)
    model = tr.Formula(tr.logistic(), features, score)
    rows = spark.createDataFrame([(1, 1.0, 5.0, "x"), (2, 4.0, 0.0, None)], "k int, a double, b double, c string")
    found = explain.contributions(model, rows, {"a": 1.0, "b": 0.0, "c": "x"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = {(r.k, r.feature): (r.value, r.contribution, r.association) for r in explain.local_reasons(found, ["k"], top=2).collect()}
    assert got == {
        (1, "b"): ("5.0", 5.0, "raises prediction"), (1, "a"): ("1.0", 0.0, "lowers prediction"),
        (2, "a"): ("4.0", 6.0, "raises prediction"), (2, "c"): (None, 3.0, "raises prediction"),
    }
