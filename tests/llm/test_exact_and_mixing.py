import pytest
from pyspark.sql import functions as F

from sojourn.llm.exact import exact_duplicates
from sojourn.llm.mixing import mix, mix_report, source_targets

SCHEMA = "doc_id bigint, text string, source string, kept string, n int, digest string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


ROWS = [(1, "a b", "s"), (5, "a b", "s"), (3, "A b", "s"), (None, None, None), (2, "", None), (7, "c " * 30000, "t"), (7, "c " * 30000, "t"), (8, "a b", "t")]


@pytest.mark.parametrize("digest", [None, lambda sha: F.substring(sha, 1, 0), lambda sha: F.lit(b"one")])
def test_equal_texts_form_groups_whatever_the_digest(spark, digest):
    got = exact_duplicates(table(spark, ROWS), digest=digest, files_per_batch=1).collect()
    by = {}
    for i, t, _ in ROWS:
        by.setdefault(t or "", []).append(i)
    want = []
    for ids in by.values():
        top = max((i for i in ids if i is not None), default=None)
        want += [(i, top, len(ids)) for i in ids]
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=repr) == sorted(want, key=repr)
    assert sum(r.kept for r in got) == len(by)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_no_rows(spark):
    assert exact_duplicates(table(spark, [])).count() == 0
    assert mix_report(table(spark, [])).count() == 0


def test_a_hot_group_is_compared_in_parts(spark):
    rows = [(i, "same text" if i % 3 else f"own {i}", "s") for i in range(1500)]
    got = exact_duplicates(table(spark, rows)).filter("kept").count()
    assert got == 501


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in target]
        over = [s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        share_now = left / sum(weight[o] for o in open_)
        for s in over:
            target[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        assert share_now > 0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50, None: 7}, {"b": 5, "é": 0, "z": 900}, {"x": 4}, {str(i): i * i for i in range(30)}])
def test_targets_fill_up_to_twice_the_size(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r.source: r.target for r in source_targets(rows).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in got)


def test_mix_takes_what_the_report_says(spark):
    docs = table(spark, [(i, "w " * (1 + i % 5), "ab"[i % 2] if i % 7 else None) for i in range(3000)] + [(None, None, "c")])
    report = mix_report(docs)
    taken = {r.doc_id: r.copies for r in report.collect()}
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: c for i, c in taken.items() if c}
    assert all(r.taken <= 2 * r.size for r in report.collect())
    sums = report.groupBy("source").agg(F.sum("taken").alias("got"), F.first("target").alias("want")).filter("want > 0").collect()
    assert all(abs(r.got / r.want - 1) < 0.1 for r in sums)


def test_mix_takes_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "_mix_rate", "_mix_source", "rate", "copy", "mixed", "source_size", "_0"]
    rows = [(i, "a b c", f"s{i % 3}", *range(7)) for i in range(60)]
    docs = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n in ('text', 'source') else 'int'}" for n in names))
    out = mix(docs)
    assert out.columns == names
    taken = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    report = {r.doc_id: r.copies for r in mix_report(docs).collect()}
    assert {d: report[d] for d in report if report[d]} == taken
    assert {tuple(r)[3:] for r in out.collect()} == {tuple(range(7))}
