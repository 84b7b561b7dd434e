"""Personal data: four base kinds, and more found by bootstrapped contextual extraction.

One scan cuts every text at the matches of each kind's pattern; only the matches, the lengths between
them and the words before each go on. Positions are running sums per row and kind. The base
matches that pass their checks are seeds. The words before a seed are a lexical pattern; other
identifier-like strings behind the same words are candidate instances. Spark scores the graph of patterns
and instances in rounds: a pattern is as good for a kind as the mean score of the distinct instances
behind it, an instance of a kind is as good as its best pattern. Candidates that are good enough join
as spans and count as instances of the next round, in which the phrases before them may become patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.store import saved

KINDS = ("email", "ip", "card", "phone")
SPACE = r"\x20\x09-\x0D"

# The base patterns. Quantifiers are possessive and matches begin at the start of a run, at the end of the
# match before, or at the start of the text: the same matches as without, in linear time.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What must be in a text for a pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

# Identifier-like strings that may turn out to be personal data: groups of digits, and words with an at sign.
CANDIDATES = {
    "digits": r"(?<![\p{L}0-9])[+(]?+[0-9](?:[\x20().-]{0,2}+[0-9])++(?![\p{L}0-9])",
    "at": rf"(?<![^{SPACE}])[^{SPACE}@]++@[^{SPACE}]++",
}

NEAR = 4  # earlier matches between which the words before a match mostly lie


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 6  # generations at most; it ends when one brings nothing new
    words: int = 2  # of a pattern
    min_seeds: int = 3  # distinct seeds of a kind behind a pattern
    min_pattern: float = 0.8  # a pattern's score
    min_instance: float = 0.8  # a candidate's score


def _last(text: Column, words: int) -> Column:
    """The last ``words`` words of a text and what is glued to what follows, with single spaces."""
    return F.substring_index(F.regexp_replace(text, rf"[{SPACE}]+", " "), " ", -(words + 1))


def _cut(text: Column, name: str, pattern: str, words: int) -> Column:
    """The matches of one kind with the length of the text before each and the words of the whole text before it."""
    hint = HINTS.get(name)
    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def listed(cut: Column) -> Column:
        pieces, found = cut["pieces"], cut["found"]

        def before(i: Column) -> Column:
            """The words before match i: between the matches next to it, or, where these hold too few, in all that precedes it."""
            own = [_last(F.get(pieces, i), words)]
            for k in range(1, NEAR + 1):
                own = [F.when(i >= k, F.concat(_last(F.get(pieces, i - k), words), F.get(found, i - k))).otherwise(F.lit("")), *own]
            near = _last(F.concat(*own), words)
            pairs = F.zip_with(F.slice(pieces, 1, i), F.slice(found, 1, i), lambda p, m: F.concat(p, m))
            whole = _last(F.concat(F.array_join(pairs, ""), F.get(pieces, i)), words)
            return F.when((i <= NEAR) | (F.size(F.split(near, " ")) > words), near).otherwise(whole)

        return F.transform(
            found,
            lambda m, i: F.struct(
                i.alias("place"), F.lit(name).alias("name"), F.length(F.get(pieces, i)).alias("gap"), m.alias("match"), before(i).alias("before")
            ),
        )

    tried = text.contains(hint) if hint else F.lit(True)
    digits = text.rlike("[0-9]") if name != "email" and name != "at" else text.contains("@")
    return F.when(tried & digits, F.element_at(F.transform(F.array(both), listed), 1))


def matches(docs: DataFrame, words: int = 2) -> DataFrame:
    """``row_id, doc_id, name, place, gap, match, before``: one row per match, one with nulls for a row without any.

    Written to the shared folder, so that ``row_id`` stands.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    empty = F.array().cast("array<struct<place:int,name:string,gap:int,match:string,before:string>>")
    cuts = [F.coalesce(_cut(F.col("text"), n, p, words), empty) for n, p in (PATTERNS | CANDIDATES).items()]
    found = rows.select("row_id", "doc_id", F.explode_outer(F.concat(*cuts)).alias("m")).select("row_id", "doc_id", "m.*")
    return saved(found, "pii-matches")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _placed(found: DataFrame) -> DataFrame:
    """Adds start and end in code points, the digits, and the words before."""
    order = Window.partitionBy("row_id", "name").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("match")
    end = F.sum(F.col("gap") + length).over(order)
    return found.filter("match is not null").select(
        "*", (end - length).cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.regexp_replace("match", "[^0-9]", "").alias("digits")
    )


def _valid() -> Column:
    """The checks of the base kinds."""
    n = F.length("digits")

    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+(?=.)", "")
        return F.when(F.length(plain) <= 3, plain.cast("int") <= 255).otherwise(False)

    parts = F.forall(F.split("match", r"\."), small)
    return (
        F.when(F.col("name") == "email", True)
        .when(F.col("name") == "ip", F.coalesce(parts, F.lit(False)))
        .when(F.col("name") == "card", F.when(n.between(13, 19), luhn(F.col("digits"))).otherwise(False))
        .when(F.col("name") == "phone", n.between(9, 15))
        .otherwise(False)
    )


def _shapes() -> Column:
    """The kinds that a candidate may be of."""
    n = F.length("digits")
    quads = F.col("match").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    number = F.col("name") == "digits"
    return F.filter(
        F.array(
            F.when(F.col("name") == "at", "email"),
            F.when(number & quads, "ip"),
            F.when(number & ~quads & n.between(12, 19), "card"),
            F.when(number & ~quads & n.between(7, 15), "phone"),
        ),
        lambda x: x.isNotNull(),
    )


def _context(words: int) -> Column:
    """The words before a match, lower-cased, with 0 for every digit; null if there are fewer."""
    found = F.split(F.trim(F.regexp_replace(F.lower("before"), rf"[{SPACE}]+", " ")), " ")
    known = F.filter(F.slice(found, -words, words), lambda w: w != "")
    context = F.regexp_replace(F.array_join(known, " "), "[0-9]", "0")
    return F.when((F.size(found) >= words) & (F.size(known) == words), context)


def _free(candidates: DataFrame, base: DataFrame) -> DataFrame:
    """Candidates that overlap no base span of their row."""
    both = base.select("row_id", "start", "end", F.lit(True).alias("is_base")).unionByName(
        candidates.withColumn("is_base", F.lit(False)), allowMissingColumns=True
    )
    order = Window.partitionBy("row_id").orderBy("start", F.col("is_base").desc())
    reach = F.max(F.when(F.col("is_base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(F.col("is_base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    both = both.withColumns({"reach": F.coalesce(reach, F.lit(0)), "following": following})
    return both.filter("not is_base and start >= reach and (following is null or end <= following)").drop("is_base", "reach", "following")


def discover(base: DataFrame, candidates: DataFrame, how: Bootstrap) -> DataFrame:
    """``kind, value`` of the candidates that the scored graph accepts.

    ``base(kind, value, pattern)`` are the seeds, ``candidates(kind, value, pattern)`` one row for each
    occurrence and possible kind. All tables hold distinct values and patterns, already counted together.
    """
    seeds = base.select("kind", "value", "pattern").distinct()
    asked = candidates.select("kind", "value", "pattern").distinct()
    edges = seeds.select("pattern", "kind", "value", F.lit(True).alias("seed")).unionByName(asked.select("pattern", "kind", "value", F.lit(False).alias("seed")))
    edges = saved(edges, "pii-graph")
    totals = saved(edges.groupBy("pattern").agg(F.count_distinct("value").alias("total")).filter(F.col("total") >= how.min_seeds), "pii-patterns")
    known = saved(edges.filter("seed").select("kind", "value", F.lit(1.0).alias("score")).distinct(), "pii-seeds")
    scores, accepted = known, 0
    for _ in range(how.rounds):
        # the patterns of this round: behind them lie seeds and accepted instances enough
        good = edges.join(scores, ["kind", "value"]).groupBy("kind", "pattern", "value").agg(F.first("score").alias("score"))
        good = good.groupBy("kind", "pattern").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("seeds"))
        good = good.filter(F.col("seeds") >= how.min_seeds).join(totals, "pattern").select("kind", "pattern", (F.col("mass") / F.col("total")).alias("quality"))
        good = good.filter(F.col("quality") >= how.min_pattern)
        best = edges.filter("not seed").join(good, ["kind", "pattern"]).groupBy("kind", "value").agg(F.max("quality").alias("score"))
        best = best.filter(F.col("score") >= how.min_instance)
        scores = saved(known.unionByName(best).groupBy("kind", "value").agg(F.max("score").alias("score")), "pii-scores")
        before, accepted = accepted, scores.count()
        if accepted == before:
            break
    accepted = edges.filter("not seed").select("kind", "value", "pattern").join(scores, ["kind", "value"])
    return accepted.groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))


def _listed(rows: Column) -> Column:
    return F.array_join(
        F.transform(F.array_sort(rows), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["end"])), ","
    )


def find_personal_data(docs: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_added, base_spans, spans`` for every row of ``docs(doc_id, text)``.

    The counts and ``base_spans`` are those of the base kinds; ``spans`` also has what the bootstrap
    found, which never overlaps a base span (of the rest the leftmost stays). Lists are ``kind:start:end`` in code
    points, by kind and start, comma-joined. Null and empty texts have no spans; repeated rows and rows
    with equal or null doc_id are rows of their own; an empty table gives no rows; a very long text is searched as a whole; other columns are ignored.
    """
    found = matches(docs, how.words)
    placed = saved(_placed(found).withColumns({"valid": _valid(), "pattern": _context(how.words)}), "pii-placed")
    base = placed.filter("valid").withColumnRenamed("name", "kind")
    seeds = base.filter("pattern is not null").select("kind", F.lower("match").alias("value"), "pattern")
    asked = placed.filter(F.col("name").isin(*CANDIDATES)).withColumn("kinds", _shapes()).filter(F.size("kinds") > 0)
    asked = saved(_free(asked.select("row_id", "start", "end", "kinds", F.lower("match").alias("value"), "pattern"), base), "pii-candidates")
    known = discover(seeds, asked.filter("pattern is not null").withColumn("kind", F.explode("kinds")), how)
    added = asked.join(known, "value").select("row_id", "start", "end", "kind")
    order = Window.partitionBy("row_id").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    added = added.withColumn("reach", F.max("end").over(order)).filter("reach is null or start >= reach")

    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct(number.alias("kind"), "start", "end").alias("span")
    spans = base.select("row_id", span, F.lit(True).alias("own")).unionByName(added.select("row_id", span, F.lit(False).alias("own")))
    own = F.col("own")
    listed = spans.groupBy("row_id").agg(
        *[F.count(F.when(own & (F.col("span.kind") == i + 1), 1)).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.count(F.when(~own, 1)).alias("n_added"),
        _listed(F.collect_list(F.when(own, F.col("span")))).alias("base_spans"),
        _listed(F.collect_list("span")).alias("spans"),
    )
    rows = found.filter("place is null or place = 0").groupBy("row_id").agg(F.first("doc_id").alias("doc_id"))
    counts = [f"n_{kind}" for kind in KINDS] + ["n_added"]
    return rows.join(listed, "row_id", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts], *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")]
    )
