import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sojourn.llm import queries
from sojourn.llm.pii import KINDS, PATTERNS, find_personal_data, matches

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd = [int(d) for d in digits[::-1]]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(odd)) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in re.finditer(BASE[k], text or "") if valid(k, m[0])]


def test_all_documents_against_plain_patterns(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.op2_pii(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in KINDS]
        assert set(spans) <= set(r.spans.split(",")) | {""}
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 0


PIECES = ["a.b@c.de%x@y.zz", "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567",
          "+12345678", "a@b", "@x.y", "..", "+1((((9", "é", "\n", " ", "9" * 25, "x@y.z.", "-", "+", "00000000000000000000000000000000000000000009.1.1.1"]


def test_odd_strings(spark):
    texts = ["".join(p) for n in (1, 2, 3) for p in [[PIECES[(i * 7 + j * 3 + n * j * j) % len(PIECES)] for j in range(n)] for i in range(60)]]
    texts += ["a" * 50000, "1" * 50000, "1-" * 20000, "+1" + "(" * 20000, "a." * 20000 + "@", "😀 x@y.zz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.base_spans for r in find_personal_data(rows).collect()}
    assert got == {i: ",".join(base_spans(t)) for i, t in enumerate(texts)}


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab1290.@%+-() \n", max_size=40))
def test_linear_patterns_match_the_same(text):
    # Python's re has no \G: emulate it by scanning from each match's end
    for kind, pattern in BASE.items():
        linear, at, found = PATTERNS[kind], 0, []
        starts = re.compile(linear.replace(r"\G|", ""))
        free = re.compile(re.sub(r"\(\?:\\G\|\(\?<!\[[^]]*\]\)\)", "", linear))
        while at <= len(text):
            here, later = free.match(text, at), starts.search(text, at)
            m = here or later
            if not m:
                break
            found.append(m.span())
            at = m.end()
        assert found == [m.span() for m in re.finditer(pattern, text)]


def test_bootstrap_finds_what_stands_where_seeds_stand(spark):
    rows = [(i, f"Some text. call me: +1 (555) 010-{1000 + i} thanks") for i in range(12)]
    rows += [(100, "Some text. call me: 555-010-7777 thanks"), (101, "Order number 555-010-8888 thanks"), (102, "Some text. call me: tomorrow 12")]
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[100].spans == "phone:20:32" and got[100].n_added == 1 and got[100].base_spans == ""
    assert got[101].spans == got[102].spans == ""
    assert all(got[i].n_phone == 1 and got[i].n_added == 0 for i in range(12))


def test_nulls_repeats_and_no_rows(spark):
    schema = "doc_id bigint, text string, name string, kind string, row_id int, start int"
    rows = [(1, None), (None, "x@y.zz"), (2, "x@y.zz 1.2.3.4"), (2, "x@y.zz 1.2.3.4"), (3, "")]
    docs = spark.createDataFrame([(*r, "n", "k", 1, 2) for r in rows], schema)
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.spans) for r in find_personal_data(docs).collect()), key=repr)
    both = "email:0:6,ip:7:14"
    assert got == sorted([(1, 0, 0, ""), (None, 1, 0, "email:0:6"), (2, 1, 1, both), (2, 1, 1, both), (3, 0, 0, "")], key=repr)
    assert find_personal_data(spark.createDataFrame([], schema)).count() == 0


def test_words_before_an_earlier_number_count(spark):
    """The context of a match is that of the whole text, and long words are whole."""
    text = "please call me: 555-010-7777 or 555-010-9999 and a" + "b" * 90 + " zip 12/34/56/78/90/12/34 now"
    rows = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = {r.match: r.before for r in matches(rows).filter("name = 'digits'").collect()}
    assert got["555-010-7777"].split()[-2:] == ["call", "me:"]
    assert got["555-010-9999"].split()[-2:] == ["555-010-7777", "or"]
    last = [r.before for r in matches(rows).filter("name = 'digits'").orderBy("place").collect()][-1]
    assert last.split()[-1].startswith("12/34") and last.split()[-2] == "zip"


def test_accepted_instances_bring_new_patterns(spark):
    """Seeds are behind 'call me:'; what is found there stands elsewhere behind 'ring up', which then finds more."""
    seeds = [(i, f"please call me: +1 555 010 {1000 + i} soon") for i in range(100)]
    bridge = [(100 + i, f"please call me: 555-010-{2000 + i} soon") for i in range(8)] + [(200 + i, f"or ring up 555-010-{2000 + i} then") for i in range(8)]
    last = [(300, "or ring up 555-010-9999 then"), (301, "order number 555-010-8888 then")]
    rows = find_personal_data(spark.createDataFrame(seeds + bridge + last, "doc_id bigint, text string"))
    got = {r.doc_id: r.n_added for r in rows.collect()}
    assert all(got[100 + i] == 1 and got[200 + i] == 1 for i in range(8))
    assert got[300] == 1 and got[301] == 0
