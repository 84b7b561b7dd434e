"""Token ids as flat binary files with 64-bit document offsets.

Documents are range-sorted by doc_id. Each partition writes ``.ids`` (unsigned 16- or 32-bit integers,
one document after the other), ``.offsets`` (64-bit, one more than documents, counted from the start of
the file) and ``.docs`` (64-bit doc_ids). File names carry the attempt, and only the files of attempts
that finished are in the manifest, so a lost executor leaves at most files that nobody reads. Prefix sums
over the manifest, one row per file, give each file the position of its first id among all.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sojourn.llm.cache import Recent
from sojourn.llm.store import new_path, saved, small_batches

CACHED = 400_000  # words that a worker remembers (up to twice as many)
READ_IDS = 1 << 20  # ids in one batch when reading back

MANIFEST = "part int, name string, n_docs bigint, n_tokens bigint, null_docs bigint"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones themselves, others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Ids of whole texts from a tokenizer whose tokens never cross a space.

    The library encodes every word that the cache does not hold. Words of plain letters with punctuation
    behind them share the ids of their letters in lower case, for which the library's model is asked directly;
    the tokenizer lower-cases itself, and nothing in such a word combines with a letter. With ``special`` the strings
    of added tokens in a text are those tokens, as the library has it by default; otherwise they are ordinary text.
    """

    def __init__(self, path: str, cached: int = CACHED, special: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.simple = regex.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([^\s\p{L}\p{N}\p{M}']*)").fullmatch
        self.words = Recent(self._word, cached)

    def _stem(self, stem: str) -> bytes:
        """Ids of lower-case Latin letters without marks: one pre-token in normal form."""
        written = stem.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        parts = self.simple(word)
        if not parts:
            return self._encode(word)
        lower = parts[1].lower()
        if lower == word:
            return self._stem(word)
        return self.words[lower] + (self.words[parts[2]] if parts[2] else b"")

    def once(self, word: str) -> bytes:
        """Ids of a text without spaces that will not come again: it is not remembered."""
        return self.words.get(word) or self._word(word)

    def __call__(self, text: str) -> bytes:
        words = self.words
        return b"".join([words[w] for w in text.split(" ")])


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=1)
def library_encoder(path: str) -> WordEncoder:
    """The ids of the library's call with ``add_special_tokens=False`` and nothing else."""
    return WordEncoder(path, special=True)


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+|^/+", "file:///", folder))


def _array(store: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The file as an array: memory-mapped where it is local."""
    if not store.get_file_info(path).size:
        return np.zeros(0, dtype=kind)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), dtype=kind)


def _writer(folder: str, path: str, end_id: int, kind: str, encoder_of: Callable[[str], Callable[[str], bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = _place(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid4().hex}"
        encoder, end = encoder_of(path), np.array([end_id], dtype=kind).tobytes()
        width = len(end)
        lengths, ids, nulls = [np.zeros(1, dtype=np.int64)], [], 0
        with store.open_output_stream(f"{root}/{name}.ids") as out:
            for batch in batches:
                here = []
                for text in batch.column(1):
                    tokens = np.frombuffer(encoder(text.as_py() or ""), dtype="<u4").astype(kind).tobytes() + end
                    out.write(tokens)
                    here.append(len(tokens) // width)
                lengths.append(np.array(here, dtype=np.int64))
                nulls += batch.column(0).null_count
                ids.append(batch.column(0).fill_null(0).to_numpy())
        offsets = np.cumsum(np.concatenate(lengths))
        with store.open_output_stream(f"{root}/{name}.offsets") as out:
            out.write(offsets.astype("<i8").tobytes())
        with store.open_output_stream(f"{root}/{name}.docs") as out:
            out.write(np.concatenate([*ids, np.zeros(0, np.int64)]).astype("<i8").tobytes())
        rows = [part], [name], [len(offsets) - 1], [int(offsets[-1])], [nulls]
        kinds = pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], [c.split()[0] for c in MANIFEST.split(", ")])

    return run


def write_token_files(docs: DataFrame, folder: str, path: str, *, end_id: int, vocabulary: int, encoder_of=library_encoder) -> DataFrame:
    """Write the ids of all texts of ``docs(doc_id, text)`` and return the manifest.

    ``folder`` must be reachable from all executors. Rows lie in ascending order of doc_id, nulls first,
    rows with equal doc_id by a hash of their text and then by the text, so that equal input gives equal
    files. A null text is empty and still has its end id. An empty table gives a manifest without
    rows; other columns are ignored.
    """
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = small_batches(rows)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    manifest = saved(rows.mapInArrow(_writer(folder, path, end_id, kind, encoder_of), MANIFEST).filter("n_docs > 0"), "token-parts")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = manifest.withColumns(
        {
            "base": F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).cast("bigint"),
            "folder": F.lit(folder),
            "kind": F.lit(kind),
        }
    )
    return saved(manifest, "token-manifest")


READ = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, root = _place(row["folder"])
            ids, offsets, docs = (
                _array(store, f"{root}/{row['name']}.{end}", kind)
                for end, kind in (("ids", row["kind"]), ("offsets", "<i8"), ("docs", "<i8"))
            )
            first = 0
            while first < len(docs):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + READ_IDS, side="right")) - 1)
                cuts = np.asarray(offsets[first : last + 1])
                doc_ids = pa.array(docs[first:last], pa.int64(), mask=np.arange(first, last) < row["null_docs"])
                texts = [ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(cuts[:-1] + row["base"]), pa.array(np.diff(cuts)), pa.array(texts, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )
                first = last


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document; ids as little-endian unsigned 32-bit integers."""
    files = manifest.select("folder", "name", "kind", "base", "null_docs")
    return files.repartition(max(1, manifest.count())).mapInArrow(_read, READ)


def token_folder(spark: SparkSession) -> str:
    return new_path(spark, "token-files")
