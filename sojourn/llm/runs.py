"""Blocks of rows that share a bucket, from partitions sorted by bucket.

A bucket that holds a large share of all rows is spread over many range partitions. Inside a
partition its rows come in *pieces* of bounded length; buckets that may lie in more than one piece
are marked, so that a second step can bring their pieces together two by two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Piece:
    start: int
    end: int
    shared: bool  # the bucket may have rows elsewhere


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Tables of about ``rows`` rows cut between buckets where possible.

    The two flags say whether the first and the last bucket may go on outside the table.
    """
    held: list[pa.RecordBatch] = []
    size, open_left = 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column("bucket").to_numpy()
        cut = int(np.searchsorted(key, key[-1], side="left"))
        if cut:
            yield table.slice(0, cut), open_left, False
            held, size, open_left = table.slice(cut).to_batches(), size - cut, False
        else:
            yield table, open_left, True
            held, size, open_left = [], 0, True
    if size:
        yield pa.Table.from_batches(held).combine_chunks(), open_left, True


def pieces(key: np.ndarray, most: int, open_left: bool, open_right: bool) -> list[Piece]:
    """The runs of equal keys, cut into pieces of at most ``most`` rows; lone rows that are not shared are left out."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    shared = ends - starts > most
    shared[0] |= open_left
    shared[-1] |= open_right
    wanted = shared | (ends - starts > 1)
    out = []
    for s, e, open_ in zip(starts[wanted].tolist(), ends[wanted].tolist(), shared[wanted].tolist()):
        out += [Piece(a, min(a + most, e), open_) for a in range(s, e, most)]
    return out


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of a[i] and b[i] in place; labels point to the smallest member.

    Returns the positions i of a spanning forest: the pairs, earlier ones first, that joined two classes.
    """
    used, at = [], np.arange(len(a))
    while True:
        x, y = labels[a[at]], labels[b[at]]
        open_ = x != y
        at, x, y = at[open_], x[open_], y[open_]
        if not len(at):
            return np.concatenate(used) if used else at
        # every larger root hooks to the smaller one of its first pair
        high, first = np.unique(np.maximum(x, y), return_index=True)
        labels[high] = np.minimum(x, y)[first]
        used.append(at[first])
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up
