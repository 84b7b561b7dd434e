"""Ids of texts from the ids of their distinct words, a slice of a batch at a time.

A single space between characters that are not white space starts a pre-token of the byte-level patterns,
so a text may be cut at such spaces and every distinct piece of a slice has to be merged only once. The cut,
the count of distinct pieces and the layout of the ids are Arrow and numpy steps over the slice; texts in
which white space meets, or that hold an added token, are cut by the pattern itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

SLICE_BYTES = 8 << 20  # text that is laid out at once; one longer text makes a slice of its own
CACHE_BYTES = 48 << 20  # what a worker remembers, about; up to twice as much
ENTRY_BYTES = 200  # a remembered piece beside its own bytes
KEPT_CHARS = 64  # longer pieces are not remembered

LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"  # after a space surely one pre-token

Merge = Callable[[Sequence[str]], list[bytes]]


class PieceIds:
    """Ids, as little-endian 32-bit integers, of texts by a pattern and a function that merges pre-tokens.

    ``added`` maps strings that are tokens of their own, wherever they occur, to their ids.
    """

    def __init__(self, pattern: str, merge: Merge, added: dict[str, int] | None = None, cache_bytes: int = CACHE_BYTES) -> None:
        self.find = regex.compile(pattern).findall
        self.merge, self.cache_bytes = merge, cache_bytes
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.added = {text: np.array([i], "<i4").tobytes() for text, i in (added or {}).items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None

    def _remember(self, pieces: list[str], ids: list[bytes]) -> None:
        kept = {p: i for p, i in zip(pieces, ids) if len(p) <= KEPT_CHARS}
        if self.held > self.cache_bytes:
            self.older, self.recent, self.held = self.recent, {}, 0
        self.recent.update(kept)
        self.held += ENTRY_BYTES * len(kept)

    def pieces(self, wanted: list[str], single: Sequence[bool]) -> list[bytes]:
        """The ids of every piece; a piece is one or, if not ``single``, perhaps several whole pre-tokens."""
        out = list(map(self.recent.get, wanted))
        if None not in out:
            return out
        open_ = [i for i, ids in enumerate(out) if ids is None]
        for i in open_:
            out[i] = self.older.get(wanted[i])
        plain = [i for i in open_ if out[i] is None and single[i]]
        mixed = [i for i in open_ if out[i] is None and not single[i]]
        if mixed:
            tokens = [self.find(wanted[i]) for i in mixed]
            plain += [i for i, found in zip(mixed, tokens) if len(found) == 1]
            tokens = [(i, found) for i, found in zip(mixed, tokens) if len(found) != 1]
            parts = list(dict.fromkeys(t for _, found in tokens for t in found))
            ids_of = dict(zip(parts, self.pieces(parts, [True] * len(parts))))
            for i, found in tokens:
                out[i] = b"".join([ids_of[t] for t in found])
        for i, ids in zip(plain, self.merge([wanted[i] for i in plain])):
            out[i] = ids
        self._remember([wanted[i] for i in open_], [out[i] for i in open_])
        return out

    def text(self, text: str) -> bytes:
        """The ids of one text by the pattern over the whole of it."""
        if self.cut is not None and self.cut.search(text):
            parts = self.cut.split(text)
            return b"".join(self.added[p] if i % 2 else self.text(p) for i, p in enumerate(parts))
        found = self.find(text)
        places = {t: i for i, t in enumerate(dict.fromkeys(found))}
        ids = self.pieces(list(places), [True] * len(places))
        return b"".join([ids[places[t]] for t in found])

    def _cut_by_pattern(self, texts: pa.Array, words: pa.Array, code: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which texts cannot be cut at spaces: white space meets at a space, or an added token occurs."""
        trimmed = pc.utf8_trim_whitespace(words)
        edged = pc.or_(pc.not_equal(trimmed, words), pc.equal(words, "")).to_numpy(zero_copy_only=False)
        meets = np.zeros(len(code) + 1, np.int64)
        np.cumsum(edged[code], out=meets[1:])
        ends = np.r_[starts[1:], len(code)]
        # an edge of a text's only word meets no space
        slow = (meets[ends] > meets[starts]) & (ends - starts > 1)
        for text in self.added:
            slow |= pc.match_substring(texts, text).to_numpy(zero_copy_only=False)
        return slow

    def lay_out(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids end."""
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary.to_pylist()
        parts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(parts) - parts
        slow = self._cut_by_pattern(texts, coded.dictionary, code, starts)
        # The first word of a text has no space before it. A text that the pattern cuts is all in its first place.
        first = [self.text(texts[int(i)].as_py()) if s else words[code[starts[i]]] for i, s in enumerate(slow)]
        plain = np.flatnonzero(~slow)
        for i, ids in zip(plain.tolist(), self.pieces([first[i] for i in plain], [False] * len(plain))):
            first[i] = ids
        code[starts] = len(words) + np.arange(len(first))
        fast = np.repeat(~slow, np.diff(np.r_[starts, len(code)]))
        used = np.flatnonzero(np.bincount(code[fast], minlength=len(words) + 1)[: len(words)])
        single = pc.match_substring_regex(coded.dictionary, LETTERS).to_numpy(zero_copy_only=False)[used].tolist()
        ids = [b""] * len(words)
        for i, found in zip(used.tolist(), self.pieces([" " + words[i] for i in used.tolist()], single)):
            ids[i] = found
        ids += first
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<i4")
        base = np.cumsum(size) - size
        taken = np.where(fast, size[code], 0)
        taken[starts] = size[code[starts]]
        ends = np.cumsum(taken)
        out = flat[np.repeat(base[code] - (ends - taken), taken) + np.arange(ends[-1] if len(ends) else 0)]
        return out, ends[starts + parts - 1]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text, one row at least."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, len(size)
    while start < n:
        before = size[start - 1] if start else 0
        end = max(int(np.searchsorted(size, before + most, side="right")), start + 1)
        yield start, end
        start = end


def encoded(batches: Iterator[pa.RecordBatch], place: int, target: int, encoder: PieceIds, binary: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches with the ids of the text in column ``place`` as column ``target``: a list, or their bytes."""
    for batch in batches:
        texts = pc.fill_null(batch.column(place).cast(pa.string()), "")
        for start, end in slices(texts):
            rows = batch.slice(start, end - start)
            flat, ends = encoder.lay_out(pa.array(texts.slice(start, end - start)))
            edges = np.r_[0, ends].astype(np.int64)
            columns = list(rows.columns)
            if binary:
                raw = pa.py_buffer(flat.tobytes())
                columns[target] = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(edges * 4), raw]).cast(pa.binary())
            else:
                columns[target] = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
