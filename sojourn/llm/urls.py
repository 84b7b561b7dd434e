"""URL verdicts from host and path rules, and from association rules mined where no rule applies.

URLs that a rule judges are the labelled ones. FP-growth mines the combinations of URL tokens and label
that are frequent among them; combinations that imply a label with enough confidence become rules, and a
rule is dropped if a part of its tokens implies the same label as surely. Tokens that the same labelled URLs have
are one item, so a long path that many URLs share is no more to mine than one token; a URL has an item if it has any of its tokens.
Rules are indexed by their rarest item: a URL looks up its items and keeps the rules all of whose items it has.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.store import saved

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
LABEL = "label="


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


def rule(verdict: str, name: str) -> Rule:
    host, slash, path = name.partition("/")
    return Rule(verdict, host, slash + path)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Lower-cased host, path, and the rest; empty for null or where ``://`` is missing."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, PARTS, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(url, PARTS, 2), F.regexp_extract(url, PARTS, 3)


def _further(kind: str, names: Column, after: int) -> Column:
    """Tokens without place for the names after the first ones."""
    return F.transform(F.filter(names, lambda x, i: (i >= after) & (x != "")), lambda x: F.concat(F.lit(f"{kind}+="), x))


def tokens(host: Column, path: Column, rest: Column) -> Column:
    """The distinct tokens of a URL: every host label, path segment and query parameter name.

    The four host labels from the right, the first three path segments and the first parameter carry their place, further
    ones only their kind (``h+=``, ``p+=``, ``q+=``). Besides, the extension of the last segment, and the presence of a
    query, of a fragment, and of a final slash.
    """
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    names = F.transform(F.split(F.regexp_extract(rest, r"^\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1))
    found = [F.concat(F.lit(f"h{i}="), F.get(labels, F.lit(i))) for i in range(4)]
    found += [F.concat(F.lit(f"p{i}="), F.get(segments, F.lit(i))) for i in range(3)]
    extension, query = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1), F.get(names, F.lit(0))
    found += [F.when(extension != "", F.concat(F.lit("x="), extension)), F.when(query != "", F.concat(F.lit("q="), query))]
    found += [F.when(rest.startswith("?"), "query"), F.when(rest.contains("#"), "fragment"), F.when(path.endswith("/"), "slash")]
    further = [_further("h", labels, 4), _further("p", segments, 3), _further("q", names, 1)]
    return F.array_distinct(F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), *further))


def items_of(labelled: DataFrame, min_support: float) -> DataFrame:
    """``token, item`` of the frequent tokens of rows ``(url, tokens, n)``: tokens of the same rows share an item, the first of them.

    Rows are told apart by two sums of their hashes. There are at most (tokens of a row / min_support) frequent tokens.
    """
    hashes = [F.sum(F.xxhash64(F.lit(seed), "url").cast("decimal(38,0)")).alias(f"hash{seed}") for seed in (1, 2)]
    counted = labelled.select("url", "n", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("n").alias("freq"), *hashes)
    total = labelled.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = counted.filter(F.col("freq") >= min_support * total)
    same = F.min("token").over(Window.partitionBy("freq", "hash1", "hash2"))
    return frequent.select("token", same.alias("item"))


def with_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``rows(url, tokens)`` with the ``items`` that their tokens stand for."""
    own = rows.select("url", F.explode("tokens").alias("token")).join(items, "token").groupBy("url").agg(F.collect_set("item").alias("items"))
    return rows.join(own, "url", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """``items, verdict, confidence, support, token`` from rows ``(tokens, verdict)``; ``token`` is the rarest item."""
    baskets = labelled.select(F.array_union("tokens", F.array(F.concat(F.lit(LABEL), F.col("verdict")))).alias("items"))
    total = F.lit(float(max(baskets.count(), 1)))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = saved(model.freqItemsets.select(F.array_sort("items").alias("all"), "freq"), "url-itemsets")
    single = found.filter(F.size("all") == 1).select(F.element_at("all", 1).alias("token"), F.col("freq").alias("token_freq"))
    # a row has one label: the sets that hold one are the rules, their rest is as frequent as its own set
    marked = found.withColumns({"label": F.filter("all", lambda x: x.startswith(LABEL)), "rest": F.filter("all", lambda x: ~x.startswith(LABEL))})
    rest = found.select(F.col("all").alias("rest"), F.col("freq").alias("rest_freq"))
    rules = marked.filter((F.size("label") == 1) & (F.size("rest") > 0)).join(rest, "rest").select(
        F.col("rest").alias("items"),
        F.substring_index(F.element_at("label", 1), "=", -1).alias("verdict"),
        (F.col("freq") / F.col("rest_freq")).alias("confidence"),
        (F.col("freq") / total).alias("support"),
    ).filter(F.col("confidence") >= min_confidence)
    each = rules.withColumn("token", F.explode("items")).join(single, "token")
    keyed = each.groupBy("items", "verdict").agg(
        F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.min_by("token", F.struct("token_freq", "token")).alias("token")
    )
    keyed = saved(keyed, "url-rules")
    whole, part = keyed.withColumn("own", F.explode("items")).alias("w"), keyed.alias("p")
    needless = whole.join(part, (F.col("w.own") == F.col("p.token")) & (F.col("w.verdict") == F.col("p.verdict"))).filter(
        (F.size("p.items") < F.size("w.items"))
        & (F.col("p.confidence") >= F.col("w.confidence"))
        & (F.size(F.array_except("p.items", "w.items")) == 0)
    )
    needless = needless.select(F.col("w.items").alias("items"), F.col("w.verdict").alias("verdict")).distinct()
    return keyed.join(needless, ["items", "verdict"], "left_anti")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, min_support: float = 0.01, min_confidence: float = 0.8, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict, mined`` for every row of ``pages(page_id, url)``.

    Of the rules that fit, the one with the longest text wins (then the longest host). Elsewhere the
    matching mined rule with the highest confidence, then support, then most tokens decides (``mined``
    lists its items), and ``default`` where none matches. Null urls and those without ``://`` have empty
    parts and get the default. Equal urls are judged once; all rows are returned, repeated ones too; an empty
    table gives no rows; a very long url is one of many tokens; other columns are ignored.
    """
    urls = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    host, path, rest = parts(F.col("url"))
    distinct = urls.groupBy("url").agg(F.count(F.lit(1)).alias("n")).withColumns({"host": host, "path": path, "rest": rest})
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))
    fit = [F.when(r.fits(F.col("host"), F.col("path")), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    fit = F.coalesce(*fit) if fit else F.lit(None).cast("struct<rule:string,verdict:string>")
    judged = distinct.withColumns({"fit": fit, "tokens": tokens(F.col("host"), F.col("path"), F.col("rest"))})
    judged = saved(judged.select("url", "n", "host", "path", "fit.rule", "fit.verdict", "tokens"), "url-parts")

    labelled = judged.filter("verdict is not null")
    items = saved(items_of(labelled.select("url", "tokens", "n"), min_support), "url-items")
    judged = saved(with_items(judged, items).drop("tokens"), "url-items-of")
    repeated = judged.filter("verdict is not null").select(F.col("items").alias("tokens"), "verdict", F.explode(F.sequence(F.lit(1), F.col("n"))))
    mined = saved(mine(repeated, min_support, min_confidence), "url-mined")
    asked = judged.filter("verdict is null").select("url", F.col("items").alias("own"), F.explode("items").alias("token"))
    found = asked.join(mined, "token").filter(F.size(F.array_except("items", "own")) == 0)
    best = found.groupBy("url").agg(
        F.max(F.struct("confidence", "support", F.size("items").alias("size"), "verdict", "items")).alias("best")
    )
    verdicts = judged.join(best, "url", "left").select(
        "url", "host", "path", "rule", F.coalesce("verdict", "best.verdict", F.lit(default)).alias("verdict"), F.array_join("best.items", " ").alias("mined")
    )
    return urls.join(verdicts, "url").select("page_id", "host", "path", "rule", "verdict", "mined")
