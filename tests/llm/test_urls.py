import re
from itertools import combinations

from pyspark.sql import functions as F

from sojourn.llm import queries
from sojourn.llm.urls import items_of, judge_urls, mine, parts, rule


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def plain_rule(host, path):
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com?x=/en/", "http://a://b.net/fr/", "x://com/", "x://com", "x://notcom/", "x://é.Net/es/É?q#f", "x://net/es/\ny", "x://www.example.com/en/",
       "http://user@net:80/fr/", "x://b.example.com/en/" + "a/" * 5000]


def test_parts_and_rules(spark, data):
    urls = [r.url for r in spark.read.parquet(f"{data}/pages.parquet").collect()] + ODD
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, host string, tokens string")
    got = {r.page_id: r for r in judge_urls(pages, queries.URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path = plain_parts(url)
        want = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, want and want.name)
        assert got[i].verdict == want.verdict if want else got[i].verdict in ("allow", "block")


def test_repeats_nulls_and_no_rows(spark):
    schema = "page_id bigint, url string"
    rows = [(1, "x://a.net/fr/"), (1, "x://a.net/fr/"), (1, "x://b.org"), (None, None)]
    got = sorted(((r.page_id, r.host, r.verdict) for r in judge_urls(spark.createDataFrame(rows, schema), queries.URL_RULES).collect()), key=repr)
    assert got == sorted([(1, "a.net", "block"), (1, "a.net", "block"), (1, "b.org", "allow"), (None, "", "allow")], key=repr)
    assert judge_urls(spark.createDataFrame([], schema), queries.URL_RULES).count() == 0
    assert judge_urls(spark.createDataFrame(rows, schema), []).filter("verdict = 'allow'").count() == 4


def test_mined_rules_against_counting(spark):
    baskets = [(["a", "b"], "block")] * 6 + [(["a"], "allow")] * 6 + [(["b", "c"], "block")] * 3 + [(["c"], "allow")] * 2 + [(["d"], "block")]
    got = {(tuple(r["items"]), r.verdict): r.confidence for r in mine(spark.createDataFrame(baskets, "tokens array<string>, verdict string"), 0.1, 0.7).collect()}
    sure = {}
    for verdict in ("allow", "block"):
        for size in (1, 2, 3):
            for items in combinations("abcd", size):
                having = [v for tokens, v in baskets if set(items) <= set(tokens)]
                hits = having.count(verdict)
                if hits >= 0.1 * len(baskets) and hits >= 0.7 * len(having):
                    sure[items, verdict] = hits / len(having)
    want = {k: c for k, c in sure.items() if not any(set(o) < set(k[0]) and v == k[1] and d >= c for (o, v), d in sure.items())}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_method_decides_where_no_rule_fits(spark):
    pages = [(i, f"http://h{i}.example.net/fr/{i}") for i in range(50)] + [(100 + i, f"http://h{i}.shop.com/de/{i}") for i in range(50)]
    pages += [(200, "http://x.example.org/fr/1"), (201, "http://x.shop.org/de/1"), (202, "http://zzz/")]
    got = {r.page_id: (r.rule, r.verdict, r.mined) for r in judge_urls(spark.createDataFrame(pages, "page_id bigint, url string"), queries.URL_RULES).collect()}
    assert got[200][:2] == (None, "block") and got[201][:2] == (None, "allow") and got[202] == (None, "allow", None)


def test_parts_need_no_slash(spark):
    row = spark.range(1).select(*[p.alias(n) for n, p in zip("abc", parts(F.lit("s://H.x?q=1#f")))]).first()
    assert tuple(row) == ("h.x", "", "?q=1#f")


def test_a_long_path_that_many_urls_share(spark):
    """Twenty segments that always come together are one item to mine, and any of them has it."""
    deep = "/".join(f"s{i}" for i in range(20))
    pages = [(i, f"http://h{i}.example.net/fr/{deep}/{i}") for i in range(200)] + [(1000 + i, f"http://h{i}.shop.com/{i}") for i in range(200)]
    pages += [(2000 + i, f"http://x{i}.org/{deep}") for i in range(3)] + [(3000, "http://x.org/a/b/c/s7/z")]
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(pages, "page_id bigint, url string"), queries.URL_RULES).collect()}
    assert {got[2000 + i] for i in range(3)} == {(None, "block")} and got[3000] == (None, "block")
    assert got[0] == ("net/fr/", "block") and got[1000] == ("com/", "allow")


def test_items_join_tokens_of_the_same_rows(spark):
    rows = [("u1", ["a", "b", "c"], 2), ("u2", ["a", "b"], 1), ("u3", ["d"], 1), ("u4", [], 5)]
    found = items_of(spark.createDataFrame(rows, "url string, tokens array<string>, n int"), 0.1)
    assert {(r.token, r.item) for r in found.collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}
