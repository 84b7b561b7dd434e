from pyspark.sql import functions as F

from sojourn.llm.urls import judge_urls, parts, rule, tokens

RULES = (rule("block", "bad.net/"), rule("allow", "good.net/"))


def verdicts(spark, bad, good, asked):
    urls = [bad.format("bad.net", i) for i in range(30)] + [good.format("good.net", i) for i in range(30)] + asked
    rows = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), RULES).collect()
    return [r.verdict for r in sorted(rows, key=lambda r: r.page_id)[60:]]


def test_fourth_segments_decide(spark):
    asked = ["http://x.org/a/b/c/ads/1", "http://x.org/a/b/c/news/1"]
    assert verdicts(spark, "http://{0}/a/b/c/ads/{1}", "http://{0}/a/b/c/news/{1}", asked) == ["block", "allow"]


def test_later_parameters_and_fifth_labels_decide(spark):
    assert verdicts(spark, "http://{0}/?id={1}&track=1", "http://{0}/?id={1}&page=1", ["http://x.org/?id=7&track=2", "http://x.org/?id=7&page=2"]) == ["block", "allow"]
    assert verdicts(spark, "http://ads.a.b.{0}/{1}", "http://www.a.b.{0}/{1}", ["http://ads.a.b.x.org/1", "http://www.a.b.x.org/1"]) == ["block", "allow"]


def test_tokens_name_everything_once(spark):
    host, path, rest = parts(F.lit("http://f.e.d.c.b.a/1/2/3/4/4/5?p=1&q&=&r=2#s&t"))
    got = spark.range(1).select(tokens(host, path, rest).alias("t")).first().t
    assert got == ["h0=a", "h1=b", "h2=c", "h3=d", "p0=1", "p1=2", "p2=3", "q=p", "query", "fragment", "h+=e", "h+=f", "p+=4", "p+=5", "q+=q", "q+=r"]
