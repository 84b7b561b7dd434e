import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sojourn.operators import episodes as ep

END = datetime(2020, 6, 1)


def frames(spark, starts, ends):
    s = spark.createDataFrame(starts, "animal_id string, intake_datetime timestamp_ntz, seq int")
    e = spark.createDataFrame(ends, "animal_id string, outcome_datetime timestamp_ntz, outcome_type string")
    return s, e


def pair(spark, starts, ends, end=END, **kw):
    s, e = frames(spark, starts, ends)
    return ep.pair_episodes(
        s, e, entity="animal_id", start_ts="intake_datetime", end_ts="outcome_datetime", extract_end=end, end_type="outcome_type", **kw
    )


def d(text):
    return datetime.fromisoformat(text)


def test_two_stays_use_two_ends_and_skip_the_past(spark):
    starts = [("A", d("2020-01-10"), 1), ("A", d("2020-03-01"), 2)]
    ends = [("A", d("2020-01-01"), "Transfer"), ("A", d("2020-01-15"), "Adoption"), ("A", d("2020-03-05"), "Adoption")]
    rows = pair(spark, starts, ends).matched.orderBy("intake_datetime").collect()
    assert [r.outcome_datetime for r in rows] == [d("2020-01-15"), d("2020-03-05")]
    assert [r.episode_number for r in rows] == [1, 2]
    assert [r.is_reintake for r in rows] == [False, True]
    assert [r.days_since_last_stay for r in rows] == [9, 46]
    assert {r.censoring_reason for r in rows} == {"adopted"}


def test_end_at_the_next_start_belongs_to_the_next_start(spark):
    starts = [("A", d("2020-01-01"), 1), ("A", d("2020-01-05"), 2)]
    out = pair(spark, starts, [("A", d("2020-01-05"), "Adoption")])
    assert [r.intake_datetime for r in out.matched.collect()] == [d("2020-01-05")]
    row = out.unresolved.first()
    assert row.observation_end == d("2020-01-05") and row.followup_days_available == 4
    assert row.unresolved_reason == "no_unused_future_outcome"


def test_end_after_the_extract_is_not_used(spark):
    out = pair(spark, [("A", d("2020-01-01"), 1)], [("A", d("2020-07-01"), "Adoption")])
    assert out.matched.count() == 0 and out.unresolved.first().observation_end == END


def test_repeated_start_keeps_the_first_by_tie_break(spark):
    starts = [("A", d("2020-01-01"), 7), ("A", d("2020-01-01"), 3)]
    rows = pair(spark, starts, [("A", d("2020-01-02"), "Died")], tie_break=["seq"]).matched.collect()
    assert [(r.seq, r.censoring_reason, r.event_type) for r in rows] == [(3, "censored_unknown", "censored")]


def test_censoring_words(spark):
    words = ["Adoption", " transfer ", "Euthanasia", "Returned", "Missing", "Return to Owner", None]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select(ep.censoring_reason(F.col("t")).alias("r")).collect()
    assert [r.r for r in rows] == [
        "adopted", "censored_transfer", "censored_euthanasia", "censored_return", "censored_lost", "censored_unknown", "censored_unknown",
    ]


def greedy(starts, ends, extract):
    """The two-pointer scan that the stateless pairing must agree with."""
    out = {}
    for a in {s[0] for s in starts}:
        ts = sorted({s[1] for s in starts if s[0] == a})
        es = sorted(e[1] for e in ends if e[0] == a)
        i = 0
        for k, t in enumerate(ts):
            nxt = ts[k + 1] if k + 1 < len(ts) else None
            while i < len(es) and es[i] < t:
                i += 1
            got = None
            if i < len(es) and not (nxt is not None and es[i] >= nxt) and es[i] <= extract:
                got, i = es[i], i + 1
            before = [e for e in es if e < t]
            out[(a, t)] = (got, nxt, k + 1, (t - before[-1]).days if before else None)
    return out


@pytest.mark.parametrize("hot_rows, slice_rows", [(None, None), (5, 40), (0, 7), (30, 1)])
def test_random_histories_with_one_dominant_entity(spark, hot_rows, slice_rows):
    rng = random.Random(7)
    base = d("2020-01-01")
    moment = lambda: base + timedelta(hours=rng.randrange(0, 24 * 20))
    who = lambda: "hot" if rng.random() < 0.4 else f"e{rng.randrange(12)}"
    starts = [(who(), moment(), i) for i in range(160)]
    ends = [(who(), moment(), rng.choice(["Adoption", "Transfer"])) for _ in range(160)]
    extract = base + timedelta(days=17)
    rows = pair(spark, starts, ends, end=extract, hot_rows=hot_rows, slice_rows=slice_rows).all_starts.collect()
    want = greedy(starts, ends, extract)
    assert len(rows) == len(want)
    for r in rows:
        got = (r.outcome_datetime, r.next_start, r.episode_number, r.days_since_last_stay)
        assert got == want[(r.animal_id, r.intake_datetime)]


def test_pairing_plan_has_no_single_partition(spark):
    s, e = frames(spark, [("A", d("2020-01-01"), 1)], [("A", d("2020-01-02"), "Adoption")])
    out = ep.pair_episodes(s, e, entity="animal_id", start_ts="intake_datetime", end_ts="outcome_datetime", extract_end=END)
    assert "SinglePartition" not in out.all_starts._jdf.queryExecution().executedPlan().toString()


def labelled(spark, starts, ends, end, horizons):
    rows = ep.episode_targets(
        pair(spark, starts, ends, end=end).all_starts, start_ts="intake_datetime", end_ts="outcome_datetime", end_type="outcome_type"
    )
    return ep.horizon_labels(
        rows, start_ts="intake_datetime", end_ts="outcome_datetime", extract_end=end, horizons=horizons
    ).orderBy("intake_datetime").collect()


def test_horizon_labels(spark):
    starts = [("A", d("2020-01-01"), 1), ("B", d("2020-01-02"), 1), ("C", d("2020-01-03"), 1), ("D", d("2020-03-20"), 1)]
    ends = [("A", d("2020-01-05"), "Adoption"), ("B", d("2020-01-06"), "Transfer"), ("C", d("2020-03-01"), "Adoption")]
    a, b, c, late = labelled(spark, starts, ends, d("2020-03-31"), (7, 30))
    assert (a.adopted_in_7d, b.adopted_in_7d, c.adopted_in_7d, c.adopted_in_30d) == (1.0, 0.0, 0.0, 0.0)
    assert late.adopted_in_7d == 0.0 and late.adopted_in_30d is None


def test_exact_horizon_follow_up_counts_as_observed(spark):
    row = labelled(spark, [("A", d("2020-03-24"), 1)], [("B", d("2020-01-01"), "Adoption")], d("2020-03-31"), (7, 8))[0]
    assert row.adopted_in_7d == 0.0 and row.adopted_in_8d is None


def test_violations_raise(spark):
    rows = spark.createDataFrame(
        [("dog", 1.0, 1, True), ("fish", -1.0, 2, False)], "animal_type string, days_to_outcome double, classification_target int, adopted boolean"
    )
    table = ep.episode_violations(rows, entity_type="animal_type", allowed=("dog", "cat"))
    with pytest.raises(ValueError, match="unsupported_types"):
        ep.raise_on_violations(table)
