"""Groups of documents whose sets of word shingles overlap, for the pipeline.

The groups of the fingerprint operator (``simhash``: Gray-order trees) are the first buckets, so near copies are
found by it. For overlaps that fingerprints of 64 bits miss MinHash bands propose too: every document goes to one bucket per band, and two documents with Jaccard overlap J share a band
of ``DEPTH`` values with probability J ** DEPTH. Rows that share a bucket take the sorted hashes of all their shingles
with them, so that the task that holds the bucket decides each pair on the whole texts and returns verified links
only: a forest that spans the groups, at most a link per row. Pairs inside one group are not compared again. A bucket beyond
``PIECE_ROWS`` rows or ``PIECE_HASHES`` hashes is dealt to pieces; every piece meets the first one, and what is then still in different groups
meets piece by piece. The first bands unite most groups, so that the others have little to compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.components import connected_components
from sojourn.llm.exact import packed, unpacked, without
from sojourn.llm.simhash import EDGES, SEED, _hashes, near_duplicates, shingles
from sojourn.llm.store import released, saved, small_batches

BANDS, DEPTH = 25, 5
PRINT_WORDS, PRINT_RADIUS = 4, 4  # shingles of a fingerprint, and bits that linked ones differ in at most
# bands that are searched together; the first is the fingerprint groups
ROUNDS = (range(-1, 0), range(0, 2), range(2, 8), range(8, BANDS))
PIECE_ROWS, PIECE_HASHES = 2048, 1 << 19
WIDE = 4096  # shingles hashed at once
BROADCAST_ROWS = 500_000  # locators that are sent to all tasks at most, about 60 MB; more are joined by a shuffle of the texts
_RNG = np.random.default_rng(SEED)
TIMES = _RNG.integers(0, 1 << 31, BANDS * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
PLUS = _RNG.integers(0, 1 << 32, BANDS * DEPTH, dtype=np.uint32)

PLACED = "doc_id bigint, _file string, _row bigint, size int, buckets array<bigint>"
SETS = "n bigint, hashes binary"


def band_keys(text: str | None, words: int) -> tuple[int, np.ndarray]:
    """The number of distinct shingles, and a bucket for each band of their MinHash values."""
    found = set(shingles(text, words))
    least = np.full(BANDS * DEPTH, 0xFFFFFFFF, dtype=np.uint32)
    hashes = _hashes(found)
    hashes = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for a in range(0, len(hashes), WIDE):
        least = np.minimum(least, (hashes[None, a : a + WIDE] * TIMES[:, None] + PLUS[:, None]).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for values in least.reshape(BANDS, DEPTH).T.astype(np.uint64):
        key = (key ^ values) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return len(found), key.view(np.int64)


def _place(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [band_keys(t.as_py(), words) for t in batch.column(3)]
            sizes, keys = pa.array([s for s, _ in found], pa.int32()), pa.array([k for _, k in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sizes, keys], ["doc_id", "_file", "_row", "size", "buckets"])

    return run


def _sets(words: int):
    """The sorted 64-bit hashes of the distinct shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.sort(_hashes(set(shingles(t.as_py(), words)))).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["n", "hashes"])

    return run


def links(n: np.ndarray, label: np.ndarray, sets: list[np.ndarray], least: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of numbers, under different labels, whose sets overlap by ``least``: those that join two groups not yet joined.

    With ``side`` only rows of different sides are compared.
    """
    group = np.unique(label, return_inverse=True)[1]
    size = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    mark = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    out, open_ = [], int(group.max(initial=0)) + 1
    for j in range(1, len(n)):
        if open_ == 1:
            break
        fits = (group[:j] != group[j]) & (np.minimum(size[:j], size[j]) >= least * np.maximum(size[:j], size[j]))
        if side is not None:
            fits &= side[:j] != side[j]
        some = np.flatnonzero(fits)
        if not len(some):
            continue
        own = codes[starts[j] : ends[j]]
        mark[own] = True
        if len(some) < 4:
            both = np.array([mark[codes[starts[i] : ends[i]]].sum() for i in some])
        else:
            shared = np.r_[0, np.cumsum(mark[codes[: ends[some[-1]]]])]
            both = shared[ends[some]] - shared[starts[some]]
        mark[own] = False
        for i in some[both >= least * (size[some] + size[j] - both)].tolist():
            if group[i] != group[j]:
                group[group == group[i]] = group[j]
                out.append((int(n[i]), int(n[j])))
                open_ -= 1
    return out


def _search(least: float, crossing: bool):
    """Links inside each (bucket, piece), or between the two sides of it, of rows sorted by both."""

    def found(held: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        rows = pa.Table.from_batches(held)
        sets = [np.frombuffer(h, np.uint64) for h in rows.column("hashes").to_pylist()]
        side = rows.column("side").to_numpy() if crossing else None
        return links(rows.column("n").to_numpy(), rows.column("label").to_numpy(), sets, least, side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, piece = batch.column("bucket").to_numpy(), batch.column("piece").to_numpy()
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (piece[1:] != piece[:-1])) + 1
            out = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                key = (bucket[a], piece[a])
                if held and key != last:
                    out += found(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
            yield _edges(out)
            pa.default_memory_pool().release_unused()
        if held:
            yield _edges(found(held))

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def _mixed(rows: DataFrame, labels: DataFrame | None, *keys: str) -> DataFrame:
    """The rows with their groups' labels, of those keys that hold more than one label."""
    if labels is None:
        return rows.withColumn("label", F.col("n"))
    named = rows.join(labels, rows["n"] == labels["node"], "left").select(*rows.columns, F.coalesce("component", "n").alias("label"))
    open_ = named.groupBy(*keys).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return named.join(open_.select(*keys), list(keys), "left_semi")


def _verified(rows: DataFrame, sets: DataFrame, least: float, crossing: bool) -> DataFrame:
    names = ["bucket", "piece", "n", "label", "hashes", *(["side"] if crossing else [])]
    dealt = rows.join(sets, "n").select(*names).repartition("bucket", "piece").sortWithinPartitions("bucket", "piece", "n")
    return saved(small_batches(dealt).mapInArrow(released(_search(least, crossing)), EDGES), "overlap-links")


def _round(rows: DataFrame, sets: DataFrame, labels: DataFrame | None, edges: DataFrame | None, least: float, piece_rows: int):
    """Verified links so far and the labels they give, after all that share a bucket of ``rows(bucket, n, size)`` were compared."""

    def joined(more: DataFrame):
        nonlocal edges, labels
        edges = more if edges is None else edges.unionByName(more)
        labels = saved(connected_components(edges), "overlap-labels")

    mixed = _mixed(rows, labels, "bucket")
    parts = F.ceil(F.greatest(F.count("n") / F.lit(piece_rows), F.sum("size") / F.lit(PIECE_HASHES))).cast("int")
    counted = mixed.groupBy("bucket").agg(F.greatest(parts, F.lit(1)).alias("parts"))
    dealt = mixed.join(counted, "bucket").withColumn("own", F.pmod(F.xxhash64("n"), F.col("parts")).cast("int"))
    dealt = saved(dealt.select("bucket", "n", "own", "parts", "label"), "overlap-rows")
    joined(_verified(dealt.withColumn("piece", F.col("own").cast("bigint")), sets, least, False))
    large = dealt.filter("parts > 1").drop("label")
    if large.isEmpty():
        return edges, labels
    # every piece meets the first one
    first = F.when(F.col("own") == 0, F.sequence(F.lit(1), F.col("parts") - 1)).otherwise(F.array("own"))
    star = large.withColumn("piece", F.explode(first.cast("array<bigint>"))).withColumn("side", (F.col("own") > 0).cast("int"))
    joined(_verified(_mixed(star, labels, "bucket", "piece"), sets, least, True))
    # pieces that are still in different groups meet two by two: a piece is on the low side of pairs with later ones
    rest = _mixed(large.filter("own > 0"), labels, "bucket").drop("label")
    if not rest.isEmpty():
        others = F.filter(F.sequence(F.lit(1), F.col("parts") - 1), lambda o: o != F.col("own"))
        pairs = rest.withColumn("other", F.explode(others))
        low, high = F.least("own", "other").cast("bigint"), F.greatest("own", "other").cast("bigint")
        pairs = pairs.withColumn("piece", F.shiftleft(low, 31).bitwiseOR(high)).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
        joined(_verified(_mixed(pairs, labels, "bucket", "piece"), sets, least, True))
    return edges, labels


def similar_groups(rows: DataFrame, words: int = 5, least: float = 0.8, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Located rows with a number ``n``, and ``(node, component)`` of the numbers in verified groups of two or more."""
    placed = small_batches(rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "_file", "_row", F.col("text").cast("string").alias("text")))
    numbered = placed.mapInArrow(released(_place(words)), PLACED).withColumn("n", F.monotonically_increasing_id())
    numbered = saved(numbered, "overlap-prints")
    places = ["_file", "_row"]
    prints = near_duplicates(rows.select("doc_id", "text", *places), PRINT_WORDS, PRINT_RADIUS, ties=places)
    # rows that repeat a doc_id or have none may share a bucket: the whole texts decide
    grouped = prints.select(F.xxhash64(F.lit("print"), "component_id").alias("bucket"), *places).join(numbered, places)
    each = grouped.select(F.lit(-1).alias("band"), "bucket", "n", "size")
    each = each.unionByName(numbered.select(F.posexplode("buckets").alias("band", "bucket"), "n", "size"))
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("bucket")
    each = saved(each.join(shared, "bucket"), "overlap-buckets")
    asked = saved(numbered.join(each.select("n").distinct(), "n").select("n", "_file", "_row"), "overlap-asked")
    located = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    texts = rows.select("_file", "_row", F.col("text").cast("string").alias("text")).join(located, ["_file", "_row"]).select("n", "text")
    sets = saved(small_batches(texts).mapInArrow(released(_sets(words)), SETS), "overlap-sets")
    edges = labels = None
    for bands in ROUNDS:
        some = each.filter(F.col("band").between(bands[0], bands[-1])).select("bucket", "n", "size")
        edges, labels = _round(some, sets, labels, edges, least, piece_rows)
    return numbered.select("n", "doc_id", "_file", "_row"), labels


def distinct_documents(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one document of each group of similar texts, the one with the smallest doc_id.

    Groups are those of ``similar_groups``. Null and empty texts have no shingles and are all
    alike. Null doc_ids come last; rows that repeat a doc_id are told apart by their place. An empty table gives no
    rows; all columns come back.
    """
    rows = packed(docs)
    numbered, labels = similar_groups(rows, words, least)
    linked = numbered.join(labels, F.col("n") == F.col("node"))
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "n")
    linked = saved(linked.withColumn("own", own), "similar-linked")
    names = linked.groupBy("component").agg(F.min("own").alias("name"))
    gone = linked.join(names, "component").filter(F.col("own") != F.col("name")).select("_file", "_row")
    return unpacked(without(rows, gone), docs)
