"""Ranked search for the best documents of each query, best-first over intervals of documents.

Documents lie in shards. A shard has a posting list for every term that a query asks for, with the impact of the
term on each document, and over the lists a range-maximum sparse table. The most that any document of an interval
can score is the sum of the maxima that the table answers for the query's terms. The open interval with the largest sum is
split at its document of maximum impact: that document is scored, the intervals on both sides go back.
A search ends when no open interval can reach the k-th score. Several intervals are split at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.pretokens import slices
from sojourn.llm.store import saved, small_batches

BREAKS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # what lies between terms
BEST = 10
BLOCK_TERMS = 100_000  # different terms of the queries that are searched for together, about
SHARD_POSTINGS, SHARD_DOCS = 500_000, 50_000
PANEL_CELLS = 1 << 22  # documents times terms of a query whose list positions are held at once
SPLITS_AT_ONCE = 256

QUERY_TERMS = "q bigint, item_id bigint, terms array<string>, times array<bigint>"
POSTINGS = "doc_id bigint, n bigint, ids array<int>, tfs array<bigint>"
FOUND = "q bigint, doc_id bigint, score bigint"


def split_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of every term, in order, and the different terms."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BREAKS)
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    real = (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[code]
    return row[real], code[real], coded.dictionary


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, code, terms = split_terms(pc.fill_null(batch.column(2), ""))
        names = terms.to_pylist()
        counts = [Counter() for _ in range(batch.num_rows)]
        for r, c in zip(row.tolist(), code.tolist()):
            counts[r][names[c]] += 1
        columns = [pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["q", "item_id", "terms", "times"])


def _postings(number: dict[str, int]):
    """Per document its length and, for the numbered terms, number and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(1)):
                rows = batch.slice(start, end - start)
                row, code, terms = split_terms(pa.array(rows.column(1)))
                n = np.bincount(row, minlength=rows.num_rows)
                ids = np.fromiter((number.get(t, -1) for t in terms.to_pylist()), np.int64, len(terms))[code]
                key, tf = np.unique((row << 32 | ids)[ids >= 0], return_counts=True)
                edges = np.searchsorted(key, np.arange(rows.num_rows + 1, dtype=np.int64) << 32)
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array((key & 0xFFFFFFFF).astype(np.int32)))
                times = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(tf.astype(np.int64)))
                out = pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), lists, times], ["doc_id", "n", "ids", "tfs"])
                yield out.filter(pa.array(n > 0))

    return run


@dataclass
class Corpus:
    """What a score needs to know of all documents: their number, their terms, and the weight of each numbered term."""

    docs: int
    length: int
    weights: np.ndarray

    def impact(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 75 + (75 * n * self.docs) // max(self.length, 1)
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class SparseTable:
    """Where the largest of any range of values lies, the first of equals: one row per power of two."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        self.values = values
        self.log = np.zeros(longest + 2, np.int64)
        for i in range(2, len(self.log)):
            self.log[i] = self.log[i >> 1] + 1
        self.rows = [np.arange(len(values), dtype=np.int32)]
        width = 1
        while 2 * width <= longest:
            a, b = self.rows[-1][:-width], self.rows[-1][width:]
            self.rows.append(np.where(values[a] >= values[b], a, b))
            width *= 2
        # rows below one another in one array, so that a matrix of ranges is one gather
        size = len(values)
        self.flat = np.zeros(len(self.rows) * size, np.int32)
        for k, row in enumerate(self.rows):
            self.flat[k * size : k * size + len(row)] = row

    def argmax(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of the largest value of each range; any place for empty ranges."""
        k = self.log[np.maximum(end - start, 1)]
        base = k * len(self.values)
        a = self.flat[base + np.minimum(start, len(self.values) - 1)]
        b = self.flat[base + np.maximum(end - (1 << k), 0)]
        return np.where(self.values[a] >= self.values[b], a, b)


class Shard:
    """Posting lists of some documents in doc_id order."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int) -> None:
        order = np.lexsort((doc, term))
        self.doc, self.docs = doc[order], docs
        self.terms, starts = np.unique(term[order], return_index=True)
        self.edges = np.r_[starts, len(order)].astype(np.int64)
        self.table = SparseTable(impact[order], int(np.diff(self.edges).max(initial=1)))
        self.impact = self.table.values

    def search(self, terms: np.ndarray, times: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``best`` documents (places) with scores above 0, largest first and then in order."""
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms) if len(self.terms) else np.zeros(len(terms), bool)
        at, times = at[here], times[here]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(at) or best < 1:
            return docs, scores
        panel = max(PANEL_CELLS // len(at), 1)
        for first in range(0, self.docs, panel):
            docs, scores = self._panel(at, times, best, first, min(first + panel, self.docs), docs, scores)
        return docs, scores

    def _panel(self, at, times, best, first, last, docs, scores):
        """Goes on with a search in the documents from first to last."""
        # before[d, t]: where the list of term t reaches document first + d
        begin = np.array([s + np.searchsorted(self.doc[s:e], first) for s, e in zip(self.edges[at], self.edges[at + 1])])
        stop = np.array([s + np.searchsorted(self.doc[s:e], last) for s, e in zip(self.edges[at], self.edges[at + 1])])
        before = np.zeros((last - first + 1, len(at)), np.int32)
        for t, (s, e) in enumerate(zip(begin.tolist(), stop.tolist())):
            before[self.doc[s:e] - first + 1, t] = 1
        before[0] = begin
        np.cumsum(before, axis=0, out=before)

        def bounded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The most a document of each interval can score, and where to split it."""
            start, end = before[low], before[high]
            place = self.table.argmax(start, end)
            most = np.where(end > start, self.impact[place] * times, 0)
            widest = most.argmax(axis=1)
            return most.sum(axis=1), self.doc[place[np.arange(len(low)), widest]] - first

        low, high = np.zeros(1, np.int64), np.full(1, last - first)
        bound, split = bounded(low, high)
        at_once = 4
        while True:
            least = max(int(scores[-1]), 1) if len(scores) == best else 1
            open_ = bound >= least
            low, high, bound, split = low[open_], high[open_], bound[open_], split[open_]
            if not len(low):
                return docs, scores
            some = np.arange(len(low)) if len(low) <= at_once else np.argpartition(-bound, at_once - 1)[:at_once]
            at_once = min(2 * at_once, SPLITS_AT_ONCE)
            d = split[some]
            start, end = before[d], before[d + 1]
            score = (np.where(end > start, self.impact[np.minimum(start, len(self.impact) - 1)], 0) * times).sum(axis=1)
            docs, scores = np.r_[docs, d + first], np.r_[scores, score]
            keep = np.lexsort((docs, -scores))[:best]
            keep = keep[scores[keep] > 0]
            docs, scores = docs[keep], scores[keep]
            rest = np.ones(len(low), bool)
            rest[some] = False
            new_low, new_high = np.r_[low[some], d + 1], np.r_[d, high[some]]
            wide = new_high > new_low
            new_low, new_high = new_low[wide], new_high[wide]
            new_bound, new_split = bounded(new_low, new_high)
            low, high = np.r_[low[rest], new_low], np.r_[high[rest], new_high]
            bound, split = np.r_[bound[rest], new_bound], np.r_[split[rest], new_split]


def _search(corpus: Corpus, asked: list[tuple[int, np.ndarray, np.ndarray]], best: int):
    """The best documents of every query in each shard."""

    def shard_rows(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending")], null_placement="at_end")).combine_chunks()
        ids, tfs = rows.column("ids").combine_chunks(), rows.column("tfs").combine_chunks()
        place = np.repeat(np.arange(len(rows)), ids.value_lengths().to_numpy(zero_copy_only=False))
        term, tf = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), tfs.flatten().to_numpy(zero_copy_only=False)
        shard = Shard(place, term, corpus.impact(term, tf, rows.column("n").to_numpy()[place]), len(rows))
        found = [(q, *shard.search(terms, times, best)) for q, terms, times in asked]
        q = np.repeat([q for q, _, _ in found], [len(d) for _, d, _ in found]).astype(np.int64)
        docs = np.concatenate([d for _, d, _ in found] or [np.zeros(0, np.int64)]).astype(np.int64)
        score = np.concatenate([s for _, _, s in found] or [np.zeros(0, np.int64)])
        doc_id = rows.column("doc_id").take(pa.array(docs)).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array(q), doc_id, pa.array(score)], ["q", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            postings += len(batch.column(2).flatten())
            if rows >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield shard_rows(pa.Table.from_batches(held))
                held, rows, postings = [], 0, 0
        if rows:
            yield shard_rows(pa.Table.from_batches(held))

    return run


def ranked_search(docs: DataFrame, queries: DataFrame, best: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``queries`` (item_id, text) the ``best`` documents with a score above 0.

    Every document and its whole text counts. A row is a document and a query is a row, so repeated rows and ids have
    results of their own; equal scores go by doc_id, null ids last. Null and empty texts have no terms: such
    documents are not counted, such queries find nothing. Other columns play no part; empty tables give no rows. Queries are dealt to blocks of
    about ``BLOCK_TERMS`` different terms; what a block broadcasts is its terms, weights and queries. A very long query is
    searched for in panels of documents.
    """
    spark = docs.sparkSession
    rows = queries.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    numbered = rows.select(F.monotonically_increasing_id().alias("q"), "item_id", "text")
    asked = saved(small_batches(numbered).mapInArrow(_query_terms, QUERY_TERMS).filter(F.size("terms") > 0), "search-queries")
    blocks = max(-(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS), 1)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = None
    for block in range(blocks):
        wanted = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).collect()
        number: dict[str, int] = {}
        for row in wanted:
            for term in row["terms"]:
                number.setdefault(term, len(number))
        held = saved(small_batches(texts).mapInArrow(_postings(number), POSTINGS), "search-postings")
        total = held.agg(F.count(F.lit(1)), F.sum("n")).first()
        holding = held.select(F.explode("ids").alias("id")).groupBy("id").count().collect()
        df = np.zeros(len(number), np.int64)
        for id_, count in holding:
            df[id_] = count
        weights = np.floor(1000 * np.log((2 * total[0] + 2) / (2 * df + 1))).astype(np.int64)
        corpus = Corpus(total[0], total[1] or 0, weights)
        terms = [(r["q"], np.array([number[t] for t in r["terms"]], np.int64), np.array(r["times"], np.int64)) for r in wanted]
        found = held.mapInArrow(_search(corpus, terms, best), FOUND)
        out = found if out is None else out.unionByName(found)
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = out.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= best)
    return top.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
