import random
from datetime import date, datetime, timedelta

import pytest

from sojourn.operators import context as cx
from sojourn.operators.rolling import prior_counts, rolling_daily


def test_simultaneous_and_repeated_starts(spark):
    t = datetime(2024, 1, 1, 10)
    rows = spark.createDataFrame(
        [("A", t), ("B", t), ("A", t), ("C", t + timedelta(hours=1))], "animal_id string, intake_datetime timestamp_ntz"
    )
    out = prior_counts(rows, entity="animal_id", ts="intake_datetime", windows=[7]).collect()
    got = sorted((r.animal_id, r.intake_volume_7d) for r in out)
    assert got == [("A", 0), ("A", 0), ("B", 0), ("C", 2)]


@pytest.mark.parametrize("slice_rows", [None, 50, 3])
def test_prior_counts_by_brute_force(spark, slice_rows):
    rng = random.Random(3)
    base = datetime(2024, 1, 1)
    rows = [(f"e{rng.randrange(9)}", base + timedelta(hours=rng.randrange(24 * 40))) for _ in range(300)]
    df = spark.createDataFrame(rows, "animal_id string, intake_datetime timestamp_ntz")
    out = prior_counts(df, entity="animal_id", ts="intake_datetime", windows=[1, 7], slice_rows=slice_rows).collect()
    known = set(rows)
    assert len(out) == len(rows)
    for r in out:
        for w in (1, 7):
            low = r.intake_datetime - timedelta(days=w)
            assert r[f"intake_volume_{w}d"] == sum(low <= t < r.intake_datetime for _, t in known)


def test_rolling_daily_excludes_the_day_and_fills_gaps(spark):
    days = [(date(2024, 1, 1), 10), (date(2024, 1, 2), 20), (date(2024, 1, 3), 30), (date(2024, 1, 6), 100)]
    daily = spark.createDataFrame(days, "context_date date, intake_volume int")
    asked = spark.createDataFrame([(date(2024, 1, 5),), (date(2024, 1, 8),)], "d date")
    out = rolling_daily(daily, date="context_date", value="intake_volume", windows=(2, 7), dates=asked)
    got = {r.context_date.day: (r.intake_volume_2d, r.intake_volume_7d) for r in out.collect()}
    assert got == {1: (0, 0), 2: (10, 10), 3: (30, 30), 5: (30, 60), 6: (0, 60), 8: (100, 160)}


def test_requests_are_counted_by_keyword(spark):
    rows = spark.createDataFrame(
        [("2024-01-01 10:00:00", "Loose Animal"), ("2024-01-01 11:00:00", "Pothole"), ("2024-01-02 09:00:00", "animal bite")],
        "`Created Date` string, `SR Description` string",
    )
    got = {r.context_date.day: r.animal_311_requests for r in cx.requests_daily(rows).collect()}
    assert got == {1: 1, 2: 1}


def test_weather_flags_are_null_without_data(spark):
    weather = cx.weather_daily(spark.createDataFrame([("2024-01-01", 96.0, 70.0)], "DATE string, TMAX double, TMIN double"))
    starts = spark.createDataFrame([(datetime(2024, 1, 2, 5),), (datetime(2024, 1, 5),)], "ts timestamp_ntz")
    first, second = cx.weather_flags(cx.join_previous_day(starts, weather, ts="ts")).orderBy("ts").collect()
    assert (first.weather_available, first.is_extreme_heat, first.is_rainy_day) == (True, True, None)
    assert (second.weather_available, second.is_extreme_heat) == (False, None)


def test_missing_history_raises(spark):
    rows = spark.createDataFrame([(1.0,), (None,)], "intake_volume_7d double")
    with pytest.raises(ValueError, match="1 rows"):
        cx.require_history(rows, ["intake_volume_7d"])
