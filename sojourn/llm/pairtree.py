"""Byte-level BPE with a segment tree over the ranks of adjacent pairs.

A pre-token is a row of symbols. The leaf of a position holds the rank of the merge of its symbol with the
next one, packed with the position, and an inner node the least of its children, so the root gives the
leftmost merge of lowest rank. A merge changes three leaves (the pair that goes, the pairs on both
sides), each mended on the way to the root; the pre-token is done when the root holds no merge.

Trees of the distinct pre-tokens of a slice are kept side by side, those of one height in one array, and
take their next merge together. A long pre-token has a tree of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.pretokens import PieceIds, encoded
from sojourn.llm.store import small_batches

# The fixed pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int64).max
LONG = 512  # bytes; longer pre-tokens have a tree of their own
SIDE_BY_SIDE = 1 << 19  # leaves of one array


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it can be seen, else one of the letters from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class Merges:
    """Ranks and results of the merges, by the two ids that meet."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model = rules["model"]
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}
        strange = [k for k, v in plain.items() if (model.get(k) or None) != v]
        before = rules.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or rules.get("normalizer") or strange or model.get("ignore_merges"):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in rules["added_tokens"]):
            raise ValueError(f"added tokens that take their surroundings: {path}")
        vocab = model["vocab"]
        letters = byte_letters()
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        # of a pair listed twice the later rank holds
        self.by_pair = {(a, b): (rank, new) for rank, (a, b, new) in enumerate(ids.tolist())}
        keys = np.array([a << 32 | b for a, b in self.by_pair], np.int64)
        ranks = np.array([rank for rank, _ in self.by_pair.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.result = np.r_[keys[order], NONE], np.r_[ranks[order], 0], ids[:, 2]
        self.added = {t["content"]: t["id"] for t in rules["added_tokens"]}
        to_byte = {c: b for b, c in enumerate(letters)}
        self.bytes: list[bytes | None] = [None] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(to_byte.__getitem__, token))
        for token, i in self.added.items():
            self.bytes[i] = token.encode()

    def rank(self, a: np.ndarray, b: np.ndarray, position: np.ndarray, shift: int) -> np.ndarray:
        """Rank and position of the merge of a with b, packed; NONE where there is none or b is no symbol (-1)."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where((b >= 0) & (self.keys[at] == key), self.ranks[at] << shift | position, NONE)


class PairTree:
    """The merges of one pre-token, of any length."""

    def __init__(self, merges: Merges, piece: bytes) -> None:
        self.merges = merges
        self.symbol = merges.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(self.symbol)
        self.after, self.before = [*range(1, n), -1], [*range(-1, n - 1)]
        self.shift = max(n - 1, 1).bit_length()
        self.leaves = 1 << self.shift
        self.tree = [NONE] * (2 * self.leaves)
        for i in range(n - 1):
            self.tree[self.leaves + i] = self._packed(i)
        for node in range(self.leaves - 1, 0, -1):
            self.tree[node] = min(self.tree[2 * node], self.tree[2 * node + 1])

    def _packed(self, i: int) -> int:
        other = self.after[i]
        found = self.merges.by_pair.get((self.symbol[i], self.symbol[other])) if other >= 0 else None
        return NONE if found is None else found[0] << self.shift | i

    def _update(self, i: int, value: int) -> None:
        tree, node = self.tree, self.leaves + i
        if tree[node] == value:
            return
        tree[node] = value
        while node > 1:
            least = min(tree[node], tree[node ^ 1])
            node >>= 1
            if tree[node] == least:
                return
            tree[node] = least

    def ids(self) -> list[int]:
        """Merges until the root holds none; the ids that are left."""
        while self.tree[1] != NONE:
            i = self.tree[1] & (self.leaves - 1)
            gone = self.after[i]
            self.symbol[i] = self.merges.by_pair[self.symbol[i], self.symbol[gone]][1]
            self.symbol[gone] = -1
            self.after[i] = after = self.after[gone]
            if after >= 0:
                self.before[after] = i
            self._update(gone, NONE)
            self._update(i, self._packed(i))
            if self.before[i] >= 0:
                self._update(self.before[i], self._packed(self.before[i]))
        return [s for s in self.symbol if s >= 0]


def merge_side_by_side(merges: Merges, symbol: np.ndarray) -> np.ndarray:
    """Merges every column of ``symbol`` (positions x pre-tokens, -1 below the last) to its end; merged-away symbols are -1.

    Positions must be a power of two. Arrays are flat with one stride, so a tree's nodes are gathered by number.
    """
    leaves, width = symbol.shape
    shift = leaves.bit_length() - 1
    position = np.arange(leaves)[:, None]
    following = np.vstack([symbol[1:], np.full((1, width), -1)])
    tree = np.full((2 * leaves, width), NONE)
    tree[leaves:] = np.where(symbol >= 0, merges.rank(symbol, following, position, shift), NONE)
    for node in range(leaves - 1, 0, -1):
        np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
    length = (symbol >= 0).sum(axis=0)
    after = np.where(position + 1 < length, position + 1, -1) * np.ones(width, np.int64)
    before = (position - 1) * np.ones(width, np.int64)
    symbol, tree, after, before = symbol.ravel(), tree.ravel(), after.ravel(), before.ravel()
    live = np.arange(width)
    while True:
        root = tree[width + live]
        live, root = live[root != NONE], root[root != NONE]
        if not len(live):
            return symbol.reshape(leaves, width)
        i = root & (leaves - 1)
        at = i * width + live
        gone = after[at]
        end = after[gone * width + live]
        new = merges.result[root >> shift]
        symbol[at] = new
        symbol[gone * width + live] = -1
        after[at] = end
        has = end >= 0
        before[end[has] * width + live[has]] = i[has]
        left = before[at]
        has_left = left >= 0
        l, at_left = left[has_left], left[has_left] * width + live[has_left]
        right_symbol = np.where(has, symbol[end * width + live], -1)
        node = np.concatenate([gone, i, l]) + leaves
        column = np.concatenate([live, live, live[has_left]])
        tree[node * width + column] = np.concatenate(
            [np.full(len(live), NONE), merges.rank(new, right_symbol, i, shift), merges.rank(symbol[at_left], new[has_left], l, shift)]
        )
        for _ in range(shift):
            node >>= 1
            child = node * (2 * width) + column
            tree[node * width + column] = np.minimum(tree[child], tree[child + width])


def merge_pieces(merges: Merges, pieces: Sequence[str]) -> list[bytes]:
    """The ids of each pre-token as little-endian 32-bit integers."""
    raw = pa.array([p.encode("utf-8", "surrogatepass") for p in pieces], pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[: len(pieces) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    out = [b""] * len(pieces)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.array(PairTree(merges, data[offsets[i] : offsets[i + 1]].tobytes()).ids(), "<i4").tobytes()
    leaves = 2
    while leaves <= LONG:
        rows = np.flatnonzero((size <= leaves) & (size > (leaves // 2 if leaves > 2 else 0)))
        for first in range(0, len(rows), max(SIDE_BY_SIDE // leaves, 1)):
            some = rows[first : first + max(SIDE_BY_SIDE // leaves, 1)]
            place = np.arange(leaves)[:, None]
            inside = place < size[some]
            symbol = np.where(inside, merges.byte_id[data[np.where(inside, offsets[some] + place, 0)]], -1)
            left = merge_side_by_side(merges, symbol).T
            kept = left >= 0
            flat = left[kept].astype("<i4").tobytes()
            ends = (np.cumsum(kept.sum(axis=1)) * 4).tolist()
            for i, a, b in zip(some.tolist(), [0, *ends], ends):
                out[i] = flat[a:b]
        leaves *= 2
    return out


@lru_cache(maxsize=1)
def _merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=1)
def _encoder(path: str) -> PieceIds:
    merges = _merges(path)
    return PieceIds(PATTERN, lambda pieces: merge_pieces(merges, pieces), merges.added)


def tree_encode(docs: DataFrame, path: str, binary: bool = False) -> DataFrame:
    """``docs`` with its columns and ``ids``: the whole ``text`` by the tokenizer file at ``path``.

    ``ids`` is an ``array<int>``, or with ``binary`` the ids as little-endian unsigned 32-bit integers. The file must be
    readable on the executors and hold a plain byte-level BPE; its added tokens are found in texts, none is put
    around them. A null or empty text has no ids. Every row is returned as it came, so repeated rows, ties and
    null ids need no rule; an empty table gives no rows; a very long text is a slice of its own, and a very long
    pre-token takes time with its length times a logarithm. A column named ``ids``, in any case, is replaced.
    """
    rows = docs.withColumns({"text": F.col("text").cast("string"), "ids": F.lit(None).cast("binary" if binary else "array<int>")})
    names = [c.lower() for c in rows.columns]
    place, target = names.index("text"), names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(batches, place, target, _encoder(path), binary)

    return small_batches(rows).mapInArrow(run, rows.schema)


def tree_decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``decoded``: the text that the column ``ids`` (either form) stands for, special tokens included.

    Bytes that are no UTF-8 become U+FFFD; null ids give null; an id that the file lacks is an error. All rows and columns come back; a
    column named ``decoded`` is replaced.
    """
    out = rows.withColumn("decoded", F.lit(None).cast("string"))
    names = [c.lower() for c in out.columns]
    place, target = names.index("ids"), names.index("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _merges(path).bytes
        size = np.array([-1 if t is None else len(t) for t in table], np.int64)
        base = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        data = np.frombuffer(b"".join(t or b"" for t in table), np.uint8)

        def text(ids: np.ndarray) -> str:
            if not len(ids):
                return ""
            if ids.min() < 0 or ids.max() >= len(size) or (size[ids] < 0).any():
                raise ValueError("an id that the vocabulary lacks")
            n = size[ids]
            ends = np.cumsum(n)
            return data[np.repeat(base[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes().decode("utf-8", "replace")

        for batch in batches:
            column = batch.column(place)
            if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
                lists = [None if v is None else np.frombuffer(v, "<u4") for v in column.to_pylist()]
            else:
                lists = [v.values.to_numpy(zero_copy_only=False) if v.is_valid else None for v in column]
            columns = list(batch.columns)
            columns[target] = pa.array([None if v is None else text(v) for v in lists], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return out.mapInArrow(run, out.schema)
