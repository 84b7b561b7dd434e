"""SimHash fingerprints and near-duplicate groups through a Gray-order hierarchical index.

Two fingerprints that differ in at most ``radius`` bits agree on at least two of ``radius + 2``
blocks of bits, so every fingerprint goes to one bucket per pair of blocks. All (bucket, fingerprint)
rows are range-sorted by bucket and Gray rank. Runs of a bucket become trees: neighbours in Gray order
share most bits, a node keeps the bits (mask and pattern) that all rows below it share, a child keeps
only what it adds to its parent. A search walks a whole level at a time, adds up the differences on
the way down, and leaves a group once they exceed the radius.

Only links that span what is linked leave a task, never all pairs. A bucket that is larger than a
piece is spread over pieces; pairs of pieces are joined by bucket, pruned by their root patterns, and
dealt out evenly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.llm.components import connected_components
from sojourn.llm.runs import blocks, joined, pieces
from sojourn.llm.store import document_rows, released, saved, small_batches

SEED = 42
FAN = 8
PIECE_ROWS = 4096
BLOCK_ROWS = 1 << 16
FRONTIER = 1 << 18  # comparisons of a search that are open at once: about 100 bytes each


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the 64-bit hashes."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    n, whole = len(bits), len(bits) // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def shingles(text: str | None, words: int) -> list[bytes]:
    """All runs of ``words`` words, A-Z lower-cased, joined by spaces; a shorter text is one; none without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return []
    whole = b" ".join(tokens)
    if len(tokens) <= words:
        return [whole]
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1)
    starts = np.r_[0, ends[:-words]].tolist()
    return [whole[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]


def fingerprint(text: str | None, words: int) -> int:
    """Majority bits of the XXH64 of all word shingles; no words give zero."""
    found = shingles(text, words)
    return _majority(_hashes(found)) if found else 0


def _hashes(found: Iterable[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(s, SEED) for s in found]), dtype=">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, words: int = 5, ties: Sequence[str] = ()) -> DataFrame:
    """``doc_id, fingerprint`` and the columns ``ties`` of every row; the 64 bits as a signed long. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], ["doc_id", "fingerprint", *ties])

    rows = document_rows(docs, "doc_id", "text", *ties)
    rows = rows.withColumns({"doc_id": F.col("doc_id").cast("bigint"), "text": F.col("text").cast("string")})
    kinds = dict(rows.dtypes)
    return small_batches(rows).mapInArrow(released(run), ", ".join(["doc_id bigint", "fingerprint bigint", *[f"`{c}` {kinds[c]}" for c in ties]]))


def gray_rank(code: Column) -> Column:
    """Position of a code in the reflected Gray sequence (as signed bits)."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def block_buckets(code: Column, radius: int) -> Column:
    """One bucket number for each pair of ``radius + 2`` bit blocks."""
    edges = [64 * i // (radius + 2) for i in range(radius + 3)]
    part = [
        F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])
    ]
    widest = max(b - a for a, b in zip(edges, edges[1:]))
    pairs = list(combinations(range(radius + 2), 2))
    return F.array(
        *[
            F.lit(k << (2 * widest)).bitwiseOR(F.shiftleft(part[i], widest)).bitwiseOR(part[j])
            for k, (i, j) in enumerate(pairs)
        ]
    )


class GrayTree:
    """Nodes over runs of Gray-sorted codes; several runs (buckets) may stand side by side."""

    def __init__(self, codes: np.ndarray, run: np.ndarray) -> None:
        self.codes = codes
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        low, high, owner = codes, codes, run
        while True:
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
            starts = np.flatnonzero(place % FAN == 0)
            low, high, owner = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts), owner[starts]
            mask = ~(low ^ high)
            self.levels.append((starts, np.r_[starts[1:], len(place)], low & mask, mask))
            if len(owner) == len(np.unique(owner)):
                break
        self.root_of = owner

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query position, row) within the radius, nearest first; with ``after`` only rows beyond that row."""
        spans = self._spans()
        q, node = np.arange(len(queries)), roots
        above = np.zeros(len(q), dtype=np.uint64)
        sums = np.zeros(len(q), dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            starts, ends, pattern, mask = self.levels[depth]
            own = mask[node]
            sums = sums + np.bitwise_count((queries[q] ^ pattern[node]) & own & ~above)
            keep = sums <= radius
            if after is not None:
                keep &= spans[depth][node] > after[q] + 1
            q, node, sums, own = q[keep], node[keep], sums[keep], own[keep]
            count = ends[node] - starts[node]
            begin = np.repeat(starts[node] - np.r_[0, np.cumsum(count)[:-1]] if len(node) else node, count)
            node = begin + np.arange(len(begin))
            q, sums, above = np.repeat(q, count), np.repeat(sums, count), np.repeat(own, count)
        sums = sums + np.bitwise_count((queries[q] ^ self.codes[node]) & ~above)
        keep = sums <= radius
        if after is not None:
            keep &= node > after[q]
        nearest = np.argsort(sums[keep], kind="stable")
        return q[keep][nearest], node[keep][nearest]

    def _spans(self) -> list[np.ndarray]:
        """Last row (exclusive) under each node, by level."""
        out: list[np.ndarray] = []
        for _, ends, _, _ in self.levels:
            out.append(ends if not out else out[-1][ends - 1])
        return out


def _chunks(weight: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts of the queries with about ``most`` comparisons each at worst."""
    total = np.cumsum(weight)
    start = 0
    while start < len(weight):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + most, side="right")))
        yield start, end
        start = end


def _links(codes: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is linked inside each run."""
    tree = GrayTree(codes, run)
    labels = np.arange(len(codes))
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[first, len(run)])
    roots = np.repeat(np.arange(len(first)), sizes)
    left, right = [], []
    for a, b in _chunks(np.repeat(sizes, sizes), FRONTIER):
        rows = np.arange(a, b)
        q, found = tree.search(codes[a:b], roots[a:b], radius, rows)
        used = joined(labels, rows[q], found)
        left.append(codes[rows[q[used]]])
        right.append(codes[found[used]])
    return np.concatenate(left), np.concatenate(right)


def _cross_links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is linked between two pieces of a bucket."""
    tree = GrayTree(right, np.zeros(len(right), dtype=np.int64))
    labels = np.arange(len(left) + len(right))
    one, other = [left[:0]], [right[:0]]
    for a, b in _chunks(np.full(len(left), len(right)), FRONTIER):
        q, found = tree.search(left[a:b], np.zeros(b - a, dtype=np.int64), radius)
        used = joined(labels, a + q, len(left) + found)
        one.append(left[a + q[used]])
        other.append(right[found[used]])
    return np.concatenate(one), np.concatenate(other)


EDGES = "a bigint, b bigint"
FOUND = f"{EDGES}, bucket bigint, piece bigint, mask bigint, pattern bigint, codes binary"


def _search_buckets(radius: int, piece_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for table, left, right in blocks(batches, BLOCK_ROWS):
            key = table.column("bucket").to_numpy()
            codes = table.column("code").to_numpy().view(np.uint64)
            cut = pieces(key, piece_rows, left, right)
            out: dict[str, list] = {name.split()[0]: [] for name in FOUND.split(", ")}
            if cut:
                rows = np.concatenate([np.arange(p.start, p.end) for p in cut])
                run_ = np.repeat(np.arange(len(cut)), [p.end - p.start for p in cut])
                a, b = _links(codes[rows], run_, radius)
                out["a"], out["b"] = a.view(np.int64).tolist(), b.view(np.int64).tolist()
            found = len(out["a"])
            for name in ("bucket", "piece", "mask", "pattern", "codes"):
                out[name] = [None] * found
            for p in cut:
                if p.shared:
                    part = codes[p.start : p.end]
                    low, high = np.bitwise_and.reduce(part), np.bitwise_or.reduce(part)
                    mask = ~(low ^ high)
                    row = (None, None, int(key[p.start]), number, int(mask.view(np.int64)), int((low & mask).view(np.int64)), part.tobytes())
                    for name, value in zip(out, row):
                        out[name].append(value)
                    number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[n], pa.binary() if n == "codes" else pa.int64()) for n in out], list(out)
            )

    return run


def _search_pairs(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                a, b = _cross_links(np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def hamming_links(codes: DataFrame, radius: int = 3, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Edges ``(a, b)`` that span every group of the distinct longs in ``code`` linked at ``radius`` or fewer bits."""
    rows = codes.select("code", F.explode(block_buckets(F.col("code"), radius)).alias("bucket"))
    # one row for each code and pair of blocks, in Gray order inside its bucket
    ordered = rows.withColumn("rank", gray_rank(F.col("code")))
    ordered = ordered.repartitionByRange("bucket", "rank").sortWithinPartitions("bucket", "rank").select("bucket", "code")
    found = saved(ordered.mapInArrow(released(_search_buckets(radius, piece_rows)), FOUND), "simhash-links")
    shared = found.filter("codes is not null")
    x, y = shared.alias("x"), shared.alias("y")
    differing = F.bit_count(
        F.col("x.pattern").bitwiseXOR(F.col("y.pattern")).bitwiseAND(F.col("x.mask")).bitwiseAND(F.col("y.mask"))
    )
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.piece") < F.col("y.piece")) & (differing <= radius))
    pairs = pairs.select(F.col("x.codes").alias("left"), F.col("y.codes").alias("right"))
    pairs = pairs.repartition(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    across = pairs.mapInArrow(released(_search_pairs(radius)), EDGES)
    return found.filter("codes is null").select("a", "b").unionByName(across)


def near_duplicates(
    docs: DataFrame, words: int = 5, radius: int = 3, piece_rows: int = PIECE_ROWS, ties: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, fingerprint, component_id, kept`` and the columns ``ties`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` differing
    bits, the row's own included. Equal fingerprints are one node, so copies cost nothing. A null text
    counts as empty; texts without words have fingerprint zero and link like any other. ``kept`` marks the row that
    names its component; rows that repeat a doc_id are told apart by ``ties`` and otherwise kept together.
    Null doc_ids come last, so they name a component only if it has no other member. An empty table gives no
    rows; other columns are ignored.
    """
    prints = saved(fingerprints(docs, words, ties), "simhash")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *ties)
    nodes = saved(prints.groupBy("fingerprint").agg(F.min(own).alias("first")), "simhash-nodes")
    labels = connected_components(hamming_links(nodes.select(F.col("fingerprint").alias("code")), radius, piece_rows))
    linked = nodes.join(labels, nodes["fingerprint"] == labels["node"]).select("fingerprint", "component", "first")
    linked = saved(linked, "simhash-linked")
    names = linked.groupBy("component").agg(F.min("first").alias("name"))
    named = linked.join(names, "component").select("fingerprint", "name")
    # every fingerprint has a row here: linked ones their component's name, others their own
    named = nodes.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("name", "first").alias("name"))
    return prints.join(named, "fingerprint").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.col("name.doc_id").alias("component_id"),
        own.eqNullSafe(F.col("name")).alias("kept"),
        *ties,
    )
