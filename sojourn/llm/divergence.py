"""How far the term frequencies of sources lie apart, from run-length columns.

For every language the kept terms form the rows of a table with one column of counts per source. Terms are
dealt to blocks by their total count, so that equal counts meet, and inside a block they are reordered:
sorted by the counts of the columns with the fewest different values first. Each column is then a few runs. Two
columns are compared run by run: the boundaries of both are intersected, and the difference of a piece is
multiplied by its length. Blocks add up. All numbers are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.pretokens import slices
from sojourn.llm.store import saved, small_batches

LEAST_DOCS = 30
TOP = 50
EXTRA = 5  # added to every count
BREAKS = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # what lies between terms
BLOCK_CELLS = 1 << 22  # terms times sources of a block
COUNTED = "lang string, source string, term string, n bigint, docs bigint"
SUMS = "lang string, source string, other string, value bigint"


def _count_slice(lang: list[str], source: list[str], texts: pa.Array) -> pa.RecordBatch:
    """Occurrences and documents of each (lang, source, term) of some documents."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BREAKS)
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    terms = max(len(coded.dictionary), 1)
    inside, n = np.unique((doc * terms + code)[(pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[code]], return_counts=True)
    groups: dict[tuple[str, str], int] = {}
    group = np.array([groups.setdefault(pair, len(groups)) for pair in zip(lang, source)], np.int64)
    key = group[inside // terms] * terms + inside % terms
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n, docs = (np.add.reduceat(n, first), np.diff(np.r_[first, len(key)])) if len(first) else (n, n)
    names = list(groups)
    owner = (key[first] // terms).tolist()
    columns = [[names[g][0] for g in owner], [names[g][1] for g in owner]]
    term = coded.dictionary.take(pa.array(key[first] % terms))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
        [c.split()[0] for c in COUNTED.split(", ")],
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end in slices(batch.column(2)):
            rows = batch.slice(start, end - start)
            yield _count_slice(rows.column(0).to_pylist(), rows.column(1).to_pylist(), pa.array(rows.column(2)))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(count: Column, total: Column) -> Column:
    """``1 + floor(10 ** 9 * count / total)`` in whole numbers, three digits at a time."""
    q, r = _div(count, total), count % total
    for _ in range(3):
        q, r = q * 1000 + _div(r * 1000, total), (r * 1000) % total
    return q + 1


def whole_shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """``1 + floor(10 ** 9 * count / total)``; exact for totals below 9 * 10 ** 15."""
    q, r = np.divmod(count, total)
    for _ in range(3):
        digit, r = np.divmod(r * 1000, total)
        q = q * 1000 + digit
    return q + 1


def reordered(table: np.ndarray) -> np.ndarray:
    """The rows (terms) of a table of counts by source, sorted by the columns with the fewest different values first."""
    if not table.size:
        return table
    different = [len(np.unique(column)) for column in table.T]
    return table[np.lexsort([table[:, i] for i in np.argsort(different, kind="stable")[::-1]])]


def runs(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows and values of the runs of equal counts."""
    start = np.flatnonzero(np.r_[True, column[1:] != column[:-1]][: len(column)])
    return start, column[start]


def run_distance(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], rows: int) -> int:
    """The sum over all rows of the difference of two columns of runs (first rows, values)."""
    cuts = np.union1d(one[0], other[0])
    a = one[1][np.searchsorted(one[0], cuts, side="right") - 1]
    b = other[1][np.searchsorted(other[0], cuts, side="right") - 1]
    return int((np.abs(a - b) * np.diff(np.r_[cuts, rows])).sum())


def block_distances(term: np.ndarray, source: np.ndarray, n: np.ndarray, totals: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(a, b, sum)`` for sources a < b of one block, from counts n of (term, source); totals are N + 5 V by source."""
    rows = int(term.max()) + 1 if len(term) else 0
    table = np.zeros((rows, len(totals)), np.int64)
    table[term, source] = n
    table = reordered(table)
    columns = []
    for i, total in enumerate(totals.tolist()):
        start, count = runs(table[:, i])
        columns.append((start, whole_shares(count + EXTRA, total) if rows else count))
    for a in range(len(columns)):
        for b in range(a + 1, len(columns)):
            yield a, b, run_distance(columns[a], columns[b], rows) if rows else 0


def _compare(left: pa.Table, right: pa.Table) -> pa.Table:
    """All pairs of the sources of a language (right) over the terms of a block (left)."""
    names = right.column("source").to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    place = {names[i]: at for at, i in enumerate(order)}
    totals = right.column("total").to_numpy()[order]
    lists = left.column("counts").combine_chunks()
    pairs = lists.flatten()
    term = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)) if len(lists) else np.zeros(0, np.int64)
    source = np.array([place[s] for s in pairs.field("source").to_pylist()], np.int64)
    found = list(block_distances(term, source, pairs.field("n").to_numpy(zero_copy_only=False), totals))
    lang = right.column("lang")[0].as_py()
    names = [names[i] for i in order]
    return pa.table(
        [
            pa.array([lang] * len(found), pa.string()),
            pa.array([names[a] for a, _, _ in found], pa.string()),
            pa.array([names[b] for _, b, _ in found], pa.string()),
            pa.array([v for _, _, v in found], pa.int64()),
        ],
        ["lang", "source", "other", "value"],
    )


def vocabulary(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, total, counts array<struct<source, n>>`` of the terms in at least ``least_docs`` rows of their language."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = small_batches(rows).mapInArrow(_count, COUNTED)
    per_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (
        per_source.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts"))
        .filter(F.col("docs") >= least_docs)
        .drop("docs")
    )


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for the sources of each language.

    Part ``pair`` gives the distance to every other source of the language, part ``term`` the ``top`` terms that the source
    uses more than its language does. Null lang, source and text are ''. A row is a document, so repeated rows and
    ids count as often as they come; ties go by the item in UTF-8 order; groups without terms have all pairs and no
    term. A very long text is counted as a whole. Other columns play no part; an empty table gives no rows. A row of the vocabulary
    holds one count per source that has the term, and a block ``BLOCK_CELLS`` of terms times sources.
    """
    kept = saved(vocabulary(docs, least_docs), "divergence-terms")
    per_source = kept.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("all"))
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = per_source.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    groups = named.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    terms, words = F.coalesce("terms", F.lit(0)), F.coalesce("words", F.lit(0))
    groups = groups.select("lang", "source", terms.alias("terms"), F.coalesce("all", F.lit(0)).alias("all"), (words + EXTRA * terms).alias("total"))
    groups = saved(groups, "divergence-groups")

    # blocks of terms with totals of one size, cut by a hash where there are many
    band = F.floor(4 * F.log2("total")).cast("int")
    width = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    bands = kept.groupBy("lang", band.alias("band")).agg(F.count(F.lit(1)).alias("rows")).join(width, "lang")
    bands = saved(bands.select("lang", "band", F.ceil(F.col("rows") * F.col("sources") / BLOCK_CELLS).cast("int").alias("parts")), "divergence-bands")
    blocks = kept.withColumn("band", band).join(bands, ["lang", "band"])
    blocks = blocks.select("lang", "band", F.expr("pmod(xxhash64(term), parts)").cast("int").alias("part"), "counts")
    keys = bands.select("lang", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    keys = keys.unionByName(groups.select("lang").distinct().select("lang", F.lit(-1).alias("band"), F.lit(0).alias("part")))
    sides = groups.select("lang", "source", "total").join(keys, "lang")
    key = ["lang", "band", "part"]
    compared = blocks.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(_compare, SUMS)
    summed = compared.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    pairs = summed.select("lang", ways.alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    shares = _term_values(per_source, groups)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = shares.filter("value > 0").withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    terms_part = best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(terms_part)


def _term_values(per_source: DataFrame, groups: DataFrame) -> DataFrame:
    """What the share of each term in a source exceeds its share in the language by."""
    joined = per_source.withColumnRenamed("total", "in_lang").join(groups, ["lang", "source"])
    here = _share(F.col("n") + EXTRA, F.col("total"))
    there = _share(F.col("in_lang") + EXTRA, F.col("all") + EXTRA * F.col("terms"))
    return joined.select("lang", "source", F.col("term").alias("item"), (here - there).alias("value"))
