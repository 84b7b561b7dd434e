"""Byte-level BPE with a hierarchical-bitmap rank queue.

The distinct pre-tokens of a slice lie side by side as one linked list of bytes. Adjacent pairs wait in
buckets by merge rank, each with list positions. A bitmap marks the ranks whose bucket is not empty, a bitmap
above it marks its words that are not zero; find-first-set from the top gives the lowest rank in two steps
however much waits. The whole bucket is merged at once: no pre-token in it has a lower rank waiting. A merge
changes the pairs on both sides; entries that no longer describe their position are skipped when they come
up. The work is a few steps per merge, so a pre-token of a million bytes is no different from many short ones.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.pretokens import CACHE_BYTES, PieceIds, encoded
from sojourn.llm.store import released, small_batches

SHIFT = 8
WORD = 1 << SHIFT  # ranks in a word of the lower bitmap
LOW = WORD - 1
BITS = [1 << i for i in range(WORD)]
FEW = 12  # a bucket of fewer positions is merged one by one
BYTES_AT_ONCE = 1 << 20  # pre-tokens in one list


class RankQueue:
    """List positions by merge rank, lowest rank first and then leftmost.

    ``buckets[rank]`` is a heap of positions or None; ``words`` has a bit for every bucket that is not
    empty, ``top`` a bit for every word that is not zero.
    """

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list[int] | None] = [None] * ranks
        self.words = [0] * (-(-ranks // WORD))
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        at = rank >> SHIFT
        self.words[at] |= BITS[rank & LOW]
        self.top |= 1 << at

    def pop(self) -> tuple[int, int]:
        """The lowest waiting rank and its leftmost position; (-1, -1) if nothing waits."""
        top = self.top
        if not top:
            return -1, -1
        at = (top & -top).bit_length() - 1
        word = self.words[at]
        low = word & -word
        rank = (at << SHIFT) + low.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        self.buckets[rank] = None
        self.words[at] = word = word ^ low
        if not word:
            self.top = top ^ (1 << at)
        return rank, bucket[0]

    def drain(self) -> tuple[int, list[int]]:
        """The lowest waiting rank and all its positions, in no order; (-1, []) if nothing waits."""
        top = self.top
        if not top:
            return -1, []
        at = (top & -top).bit_length() - 1
        word = self.words[at]
        low = word & -word
        rank = (at << SHIFT) + low.bit_length() - 1
        bucket, self.buckets[rank] = self.buckets[rank], None
        self.words[at] = word = word ^ low
        if not word:
            self.top = top ^ (1 << at)
        return rank, bucket


class Merger:
    """Applies the merges of a rank table to pre-tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.byte_id = np.array([ranks[bytes((b,))] for b in range(256)], np.int64)
        # every way to cut a token into two tokens is a merge
        self.by_pair = {}
        # ranks whose merge may bring a pair of lower rank next to it, as a part of a token that comes earlier
        self.unsafe = set()
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i], -1), ranks.get(token[i:], -1)
                if a >= 0 and b >= 0:
                    self.by_pair[a << 32 | b] = rank
                self.unsafe.update(part for part in (a, b) if part > rank)
        keys = np.fromiter(self.by_pair, np.int64, len(self.by_pair))
        found = np.fromiter(self.by_pair.values(), np.int64, len(self.by_pair))
        order = np.argsort(keys)
        self.keys, self.found = np.r_[keys[order], np.iinfo(np.int64).max], np.r_[found[order], -1]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of a with b; -1 where there is none or one of them is no symbol (-1)."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.found[at], -1)

    def _merge_few(self, rank: int, positions: list[int], symbol, after, before, waiting) -> None:
        push, find = self.queue.push, self.by_pair.get
        for i in positions:
            if waiting[i] != rank:
                continue  # stale
            gone = after[i]
            right = after[gone]
            after[i] = right
            before[right] = i
            symbol[i], symbol[gone] = rank, -1
            waiting[gone] = -1
            left = before[i]
            waiting[i] = new = find(rank << 32 | symbol[right], -1) if symbol[right] >= 0 else -1
            waiting[left] = other = find(symbol[left] << 32 | rank, -1) if symbol[left] >= 0 else -1
            if new >= 0:
                push(new, i)
            if other >= 0:
                push(other, left)
            if -1 < new < rank or -1 < other < rank:  # what is left of the bucket comes after the lower rank
                for j in positions:
                    if waiting[j] == rank:
                        push(rank, j)
                return

    def _merge_many(self, rank: int, positions: np.ndarray, symbol, after, before, waiting) -> None:
        # of pairs that overlap in a chain the first, third, ... are merged
        chained = np.r_[False, after[positions[:-1]] == positions[1:]]
        first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(positions))))
        i = positions[(np.arange(len(positions)) - first) % 2 == 0]
        gone = after[i]
        right = after[gone]
        after[i] = right
        before[right] = i
        symbol[i], symbol[gone] = rank, -1
        waiting[gone] = -1
        left = before[i]
        new, other = self._ranks(symbol[i], symbol[right]), self._ranks(symbol[left], symbol[i])
        waiting[i], waiting[left] = new, other
        place, rank_there = np.r_[i, left], np.r_[new, other]
        some = rank_there >= 0
        for r, p in zip(rank_there[some].tolist(), place[some].tolist()):
            self.queue.push(r, p)

    def _merge(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Merges pre-tokens that lie in one list, with a symbol that is none (-1) before, between and after them."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        gaps = np.r_[0, np.cumsum(size + 1)]
        symbol = np.full(gaps[-1] + 1, -1, np.int64)
        inside = np.ones(len(symbol), bool)
        inside[gaps] = False
        symbol[inside] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, len(symbol) + 1), np.arange(-1, len(symbol) - 1)
        waiting = np.r_[self._ranks(symbol[:-1], symbol[1:]), -1]
        order = np.argsort(waiting, kind="stable")
        order = order[np.searchsorted(waiting[order], 0) :]
        queue = self.queue
        starts = np.flatnonzero(np.diff(waiting[order], prepend=-1))
        for rank, a, b in zip(waiting[order[starts]].tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
            positions = order[a:b].tolist()
            queue.push(rank, positions[0])
            queue.buckets[rank] = positions
        views = [memoryview(x) for x in (symbol, after, before, waiting)]  # the same memory, quick to read one by one
        while queue.top:
            rank, positions = queue.drain()
            if len(positions) < FEW or rank in self.unsafe:
                self._merge_few(rank, sorted(set(positions)), *views)
            else:
                found = np.unique(np.array(positions))
                self._merge_many(rank, found[waiting[found] == rank], symbol, after, before, waiting)
        left = symbol >= 0
        flat = symbol[left].astype("<i4").tobytes()
        ends = (np.r_[0, np.cumsum(left)][gaps] * 4).tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def merge_all(self, pieces: Sequence[bytes]) -> list[bytes]:
        """The ids of each pre-token as little-endian 32-bit integers."""
        out, find, open_ = [b""] * len(pieces), self.ranks.get, []
        for i, piece in enumerate(pieces):
            whole = find(piece)
            if whole is None:
                open_.append(i)
            else:
                out[i] = whole.to_bytes(4, "little")
        held = 0
        start = 0
        for n, i in enumerate(open_):
            held += len(pieces[i])
            if held >= BYTES_AT_ONCE or n + 1 == len(open_):
                some = open_[start : n + 1]
                for j, ids in zip(some, self._merge([pieces[j] for j in some])):
                    out[j] = ids
                held, start = 0, n + 1
        return out

    def __call__(self, piece: bytes) -> list[int]:
        return np.frombuffer(self.merge_all([piece])[0], "<i4").tolist()


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder(PieceIds):
    """Ids of texts as little-endian 32-bit integers."""

    def __init__(self, path: str, pattern: str, cache_bytes: int = CACHE_BYTES) -> None:
        merger = Merger(load_ranks(path))
        super().__init__(pattern, lambda pieces: merger.merge_all([p.encode("utf-8", "surrogatepass") for p in pieces]), None, cache_bytes)

    def __call__(self, text: str) -> bytes:
        return self.text(text)


@lru_cache(maxsize=1)
def _encoder(path: str, pattern: str, cache_bytes: int) -> Encoder:
    return Encoder(path, pattern, cache_bytes)


@lru_cache(maxsize=1)
def _tokens(path: str) -> pa.Array:
    ranks = load_ranks(path)
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """``docs`` with its columns and ``ids array<int>``: the whole ``text`` by the rank file at ``path``.

    ``path`` must be readable on the executors; ``pattern`` cuts the text into pre-tokens that are merged
    separately. A null or empty text has no ids. Every row is returned as it came, so repeated rows,
    ties and null ids need no rule; an empty table gives no rows; a very long text is laid out by itself. A column
    named ``ids``, in any case, is replaced. A worker remembers about ``cache_bytes`` of pre-tokens, also after its task.
    """
    rows = docs.withColumn("ids", F.lit(None).cast("array<int>"))
    place = [c.lower() for c in rows.columns].index("text")
    ids = [c.lower() for c in rows.columns].index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(batches, place, ids, _encoder(path, pattern, cache_bytes))

    return small_batches(rows).mapInArrow(released(run), rows.schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``bytes``: the text that the column ``ids`` stands for. Null ids give null."""
    out = rows.withColumn("bytes", F.lit(None).cast("binary"))
    place, target = out.columns.index("ids"), out.columns.index("bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _tokens(path)
        for batch in batches:
            lists = batch.column(place)
            taken = table.take(lists.flatten())
            ends = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
            edges = np.frombuffer(taken.buffers()[1], dtype=np.int32)[taken.offset : taken.offset + len(taken) + 1]
            edges = (edges if len(edges) else np.zeros(1, np.int32))[ends]
            data = memoryview(taken.buffers()[2] or b"")
            known = lists.is_valid().to_pylist()
            texts = [bytes(data[a:b]) if ok else None for a, b, ok in zip(edges[:-1].tolist(), edges[1:].tolist(), known)]
            columns = list(batch.columns)
            columns[target] = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return out.mapInArrow(run, out.schema)
