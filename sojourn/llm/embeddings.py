"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated by three rounds of random signs and fast Hadamard transform; the axis it then lies
closest to, with its sign, is its hash. ``hashes`` of them make a bucket of a table, and every vector
also goes to the next-nearest buckets (``probes`` for each table). Equal vectors are one node. Buckets with a
single node are dropped before vectors are moved. Within a bucket all cosines are taken in double
precision; a pair that shares several buckets counts in the smallest only, so link counts add up without
listing pairs, and only a spanning forest of the links leaves a task. Large buckets are spread over pieces that
meet two by two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.components import connected_components
from sojourn.llm.runs import blocks, joined, pieces
from sojourn.llm.store import saved

PIECE_ROWS = 1024
BLOCK_ROWS = 1 << 15
SMALL = 32  # buckets up to this size are multiplied together in batches
ROOM = 1 << 22  # cosines held at once


@dataclass(frozen=True)
class Hashing:
    """With 6 tables of 3 hashes and 3 probes, a pair of 64-component vectors at cosine 0.95 meets with probability 0.997."""

    tables: int = 6
    hashes: int = 3
    probes: int = 3
    seed: int = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    rows, n = x.shape
    step = 1
    while step < n:
        pairs = x.reshape(rows, n // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, n)
        step *= 2
    return x / np.sqrt(n)


def buckets_of(x: np.ndarray, how: Hashing) -> np.ndarray:
    """Bucket numbers of unit vectors, shape (rows, tables, probes), distinct for each dimension and table."""
    rows, dim = x.shape
    width = max(2, 1 << (dim - 1).bit_length())
    padded = np.zeros((rows, width))
    padded[:, :dim] = x
    options = min(3, width)
    out = np.empty((rows, how.tables, how.probes), dtype=np.int64)
    for table in range(how.tables):
        code, loss = np.zeros((rows, 1), dtype=np.int64), np.zeros((rows, 1))
        for h in range(how.hashes):
            signs = np.random.default_rng((how.seed, table, h)).integers(0, 2, (3, width)) * 2.0 - 1.0
            y = padded
            for s in signs:
                y = hadamard(y * s)
            size = np.abs(y)
            best = np.argsort(-size, axis=1, kind="stable")[:, :options]
            height = np.take_along_axis(size, best, 1)
            axis = best * 2 + (np.take_along_axis(y, best, 1) < 0)
            code = (code[:, :, None] * (2 * width) + axis[:, None, :]).reshape(rows, -1)
            loss = (loss[:, :, None] + (height[:, :1] - height)[:, None, :]).reshape(rows, -1)
        nearest = np.argsort(loss, axis=1, kind="stable")[:, : how.probes]
        out[:, table, :] = np.take_along_axis(code, nearest, 1) | ((dim * how.tables + table) << 44)
    return out


def _hash(how: Hashing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                raw = [np.frombuffer(v.as_buffer(), dtype="<f8") for v in part.column(1)]
                dims = np.array([len(v) for v in raw])
                found = np.zeros((len(raw), how.tables * how.probes), dtype="<i8")
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    x = unit(np.stack([raw[i] for i in at]))
                    found[at] = buckets_of(x, how).reshape(len(at), -1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([f.tobytes() for f in found], pa.binary()), pa.array(list(found), pa.list_(pa.int64()))],
                    ["node", "vector", "n", "codes", "buckets"],
                )

    return run


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so that tiny and huge ones keep their digits."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _first_meeting(a: np.ndarray, b: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether ``bucket`` is the smallest that the pairs with these codes (pairs, tables, probes) share."""
    same = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3)
    shared = np.where(same, a, np.iinfo(np.int64).max)
    return shared.reshape(len(a), -1).min(axis=1) == bucket


class _Found:
    """Link counts and a spanning forest over the rows of a block."""

    def __init__(self, nodes: np.ndarray, weights: np.ndarray, codes: np.ndarray) -> None:
        self.nodes, self.weights, self.codes = nodes, weights, codes
        self.links = np.zeros(len(nodes), dtype=np.int64)
        self.labels = np.arange(len(nodes))

    def add(self, i: np.ndarray, j: np.ndarray, bucket: np.ndarray) -> None:
        for s in range(0, len(i), 1 << 16):
            a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            joined(self.labels, a, b)
            new = _first_meeting(self.codes[a], self.codes[b], bucket[s : s + (1 << 16)])
            np.add.at(self.links, a[new], self.weights[b[new]])
            np.add.at(self.links, b[new], self.weights[a[new]])

    def batch(self) -> pa.RecordBatch:
        moved, linked = np.flatnonzero(self.labels != np.arange(len(self.labels))), np.flatnonzero(self.links)
        pad = [None] * len(linked)
        return _record(
            a=self.nodes[moved].tolist() + self.nodes[linked].tolist(),
            b=self.nodes[self.labels[moved]].tolist() + pad,
            links=[None] * len(moved) + self.links[linked].tolist(),
        )


FOUND = "a bigint, b bigint, links bigint, bucket bigint, piece bigint, nodes binary, weights binary, vectors binary, codes binary"
_COLUMNS = [(c.split()[0], pa.int64() if c.endswith("bigint") else pa.binary()) for c in FOUND.split(", ")]


def _record(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(name) or [None] * n, kind) for name, kind in _COLUMNS], [name for name, _ in _COLUMNS]
    )


def _in_buckets(how: Hashing, least: float, piece_rows: int):
    shape = (-1, how.tables, how.probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for table, left, right in blocks(batches, BLOCK_ROWS):
            key = table.column("bucket").to_numpy()
            cut = pieces(key, piece_rows, left, right)
            if not cut:
                continue
            raw = [np.frombuffer(v.as_buffer(), dtype="<f8") for v in table.column("vector")]
            codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), dtype="<i8").reshape(shape)
            found = _Found(table.column("node").to_numpy(), table.column("n").to_numpy(), codes)
            by_size: dict[tuple[int, int], list[int]] = {}
            for p in cut:  # all rows of a bucket have one dimension
                by_size.setdefault((p.end - p.start, len(raw[p.start])), []).append(p.start)
            for (size, _), starts in by_size.items():
                many = max(1, ROOM // (size * size)) if size <= SMALL else 1
                for s in range(0, len(starts), many):
                    first = np.array(starts[s : s + many])
                    rows = first[:, None] + np.arange(size)
                    x = unit(np.stack([raw[i] for i in rows.ravel()])).reshape(len(first), size, -1)
                    cosine = x @ x.transpose(0, 2, 1)
                    g, i, j = np.nonzero(np.triu(np.ones((size, size), bool), 1) & (cosine >= least))
                    found.add(first[g] + i, first[g] + j, key[first[g]])
            yield found.batch()
            for p in cut:
                if p.shared:
                    span = slice(p.start, p.end)
                    yield _record(
                        bucket=[int(key[p.start])],
                        piece=[number],
                        nodes=[found.nodes[span].tobytes()],
                        weights=[found.weights[span].tobytes()],
                        vectors=[b"".join(v.tobytes() for v in raw[span])],
                        codes=[codes[span].tobytes()],
                    )
                    number += 1

    return run


def _across(how: Hashing, least: float):
    shape = (-1, how.tables, how.probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes, weights = (np.frombuffer(row[f"x_{c}"] + row[f"y_{c}"], "<i8") for c in ("nodes", "weights"))
                found = _Found(nodes, weights, np.frombuffer(row["x_codes"] + row["y_codes"], "<i8").reshape(shape))
                size = len(row["x_nodes"]) // 8
                x, y = (unit(np.frombuffer(row[f"{s}_vectors"], "<f8").reshape(len(row[f"{s}_nodes"]) // 8, -1)) for s in "xy")
                i, j = np.nonzero(x @ y.T >= least)
                found.add(i, size + j, np.full(len(i), row["bucket"]))
                yield found.batch()

    return run


def near_vectors(rows: DataFrame, least: float = 0.95, how: Hashing = Hashing(), piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``rows(vec_id, embedding)``.

    Links join rows with cosine >= ``least``; equal vectors are linked whatever their number. Rows whose
    vector is null, empty, zero, or holds a null or non-finite component have no links. Vectors of different
    length are never linked. Rows that repeat a vec_id are rows of their own; a null vec_id names a
    component only if it has no other member, and is kept if so. An empty table gives no rows; other columns
    are ignored.
    """
    spark = rows.sparkSession
    vector = F.col("embedding").cast("array<double>")
    plain = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("vector").isNotNull() & plain & F.exists("vector", lambda x: x != 0)
    own = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("vector")).withColumn("vector", F.when(sound, F.col("vector")))
    classes = own.filter("vector is not null").groupBy("vector").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    # the binary form is what numpy reads; -0.0 and 0.0 are one value to the grouping above
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")

    hashed = classes.select("node", "vector", "n").mapInArrow(_to_binary, "node bigint, vector binary, n bigint")
    hashed = hashed.mapInArrow(_hash(how), "node bigint, vector binary, n bigint, codes binary, buckets array<bigint>")
    hashed = saved(hashed, "vector-hashes")
    slots = hashed.select("node", F.explode("buckets").alias("bucket"))
    common = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("bucket")
    met = slots.join(common, "bucket", "left_semi").join(hashed.drop("buckets"), "node")
    met = met.repartitionByRange("bucket", "node").sortWithinPartitions("bucket", "node").select("bucket", "node", "n", "vector", "codes")
    found = saved(met.mapInArrow(_in_buckets(how, least, piece_rows), FOUND), "vector-links")

    shared = found.filter("nodes is not null").select("bucket", "piece", "nodes", "weights", "vectors", "codes")
    sides = [shared.select("bucket", *[F.col(c).alias(f"{s}_{c}") for c in shared.columns if c != "bucket"]) for s in "xy"]
    pairs = sides[0].join(sides[1], "bucket").filter("x_piece < y_piece")
    pairs = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = found.filter("a is not null").select("a", "b", "links").unionByName(pairs.mapInArrow(_across(how, least), FOUND).select("a", "b", "links"))
    found = saved(found, "vector-edges")

    links = found.filter("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = connected_components(found.filter("b is not null").select("a", "b"))
    nodes = classes.join(links, "node", "left").join(labels, "node", "left")
    nodes = nodes.select("vector", "first", F.coalesce("links", F.lit(0)).alias("links"), "n", F.coalesce("component", "node").alias("component"))
    nodes = saved(nodes, "vector-nodes")
    names = nodes.groupBy("component").agg(F.min("first").alias("name"))
    named = nodes.join(names, "component").select("vector", "name", (F.col("links") + F.col("n") - 1).alias("links"))
    out = own.join(named, "vector", "left")
    alone = F.col("vector").isNull()
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("name")).alias("component_id"),
        F.col("vec_id").eqNullSafe(F.when(alone, F.col("vec_id")).otherwise(F.col("name"))).alias("kept"),
    )


def _to_binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten().to_numpy(zero_copy_only=False) + 0.0
        ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        data = [flat[a:b].astype("<f8").tobytes() for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), batch.column(2)], ["node", "vector", "n"])
