"""Language identification by nearest centroids of character n-grams.

A text is the TF-IDF vector of its hashed n-grams of one to three letters, of length 1. Document
frequencies come from all labelled texts. Each language has several centroids, found by spherical
k-means over a bounded sample of its texts (``sample`` documents for each language, by a hash of the
doc_id). A text gets the language of the centroid with the highest cosine, and is rejected if the
distance 1 - cosine is larger than ``farthest``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.store import released, small_batches

FEATURES = 1 << 13
SAMPLE = 1000
CENTROIDS = 4
FARTHEST = 0.88
BLOCK = 1 << 20  # characters taken at once; n-grams do not cross blocks
ROWS = 256
MOST_LANGUAGES = 2000  # bounds the model: languages x centroids x features


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams; None for null and for texts without a letter."""
    letter, total, any_ = _letters(), np.zeros(FEATURES, dtype=np.int64), False
    lowered = (text or "").lower()
    for start in range(0, len(lowered), BLOCK):
        codes = np.frombuffer(f" {lowered[start : start + BLOCK]} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        known = letter[codes]
        if not known.any():
            continue
        any_ = True
        kept = known.copy()
        kept[:-1] |= known[1:]  # of a run without letters only the last place before a letter stays
        kept[-1] = True
        codes = np.where(known, codes, np.uint32(32))[kept]
        one = codes * np.uint32(0x9E3779B1)
        two = one[1:] ^ (codes[:-1] * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F))
        three = two[1:] ^ (codes[:-2] * np.uint32(0xC2B2AE35) + np.uint32(0x165667B1))
        mixed = np.concatenate([one[codes != 32], two, three])
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        total += np.bincount(mixed >> np.uint32(32 - 13), minlength=FEATURES)
    return total if any_ else None


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log-scaled TF times IDF, of length 1."""
    out = np.log1p(counts).astype(np.float32) * idf
    return out / np.linalg.norm(out)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, n = np.zeros(FEATURES, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            counts = ngram_counts(text.as_py())
            if counts is not None:
                found += counts > 0
                n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, FEATURES)), pa.array(np.r_[n, found])], ["feature", "n"])


def cluster(rows: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means; starts from the row nearest the mean and then the farthest rows in turn."""
    centres = [rows[np.argmax(rows @ rows.mean(axis=0))]]
    nearest = rows @ centres[0]
    while len(centres) < min(k, len(rows)):
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-6:
            break
        centres.append(rows[far])
        nearest = np.maximum(nearest, rows @ rows[far])
    centres = np.stack(centres)
    owner = None
    for _ in range(rounds):
        now = np.argmax(rows @ centres.T, axis=1)
        if owner is not None and np.array_equal(now, owner):
            break
        owner = now
        for c in range(len(centres)):
            mean = rows[owner == c].sum(axis=0)
            if np.linalg.norm(mean) > 0:
                centres[c] = mean / np.linalg.norm(mean)
    return centres


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from all rows of ``docs(doc_id, text, lang)`` with a language.

    The driver gets one number per feature and ``centroids`` vectors per language. Texts without
    letters teach nothing. No labelled rows give a model without languages. The sample for the centroids is drawn by a hash of
    doc_id and text, so null and repeated ids are drawn like others; equal rows are drawn once. A very long text
    is counted as a whole; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("lang is not null").withColumn("draw", F.xxhash64("doc_id", "text"))
    counted = small_batches(rows).select("text").mapInArrow(released(_frequencies), "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    found = {r.feature: r.n for r in counted.collect()}
    n = found.get(-1, 0)
    idf = np.array([np.log((1 + n) / (1 + found.get(f, 0))) + 1 for f in range(FEATURES)], dtype=np.float32)

    # different draws of each language, about
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model([], np.zeros((0, FEATURES), np.float32), idf)
    # draws are even over 64 bits: below this bound lie a little more than ``sample`` draws of a language
    share = {r.lang: min(1.0, 1.1 * (sample + 8 * sample**0.5 + 8) / max(r.n, 1)) for r in sizes}
    limit = F.create_map(*[x for lang, s in share.items() for x in (F.lit(lang), F.lit(min(2**63 - 1, int(s * 2**64) - 2**63)))])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    drawn = rows.filter(F.col("draw") <= limit[F.col("lang")]).groupBy("lang", "draw").agg(F.min("text").alias("text")).withColumn("place", place).filter(F.col("place") <= sample)

    def centres(frame: pd.DataFrame) -> pd.DataFrame:
        counts = [c for c in map(ngram_counts, frame["text"]) if c is not None]
        found = cluster(np.stack([vector(c, idf) for c in counts]), centroids) if counts else np.zeros((0, FEATURES))
        return pd.DataFrame({"lang": frame["lang"].iloc[:1].repeat(len(found)), "centre": [c.astype("<f4").tobytes() for c in found]})

    out = drawn.select("lang", "text").groupBy("lang").applyInPandas(centres, "lang string, centre binary").collect()
    out.sort(key=lambda r: (r.lang, bytes(r.centre)))
    vectors = np.array([np.frombuffer(r.centre, "<f4") for r in out], dtype=np.float32).reshape(-1, FEATURES)
    return Model([r.lang for r in out], vectors, idf)


PREDICTED = "lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, model: Model, farthest: float = FARTHEST) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    ``lang_pred`` is the nearest language even where it is rejected for its distance; ``und`` with score 0,
    rejected, where the text is null or has no letter, or no language is known. Ties go to the first language
    in code-point order. All rows come back, with all other columns; columns of these three names are replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    rows = docs.select(*[docs[f"`{c}`"] for c in kept])
    place = [c.lower() for c in kept].index("text")
    schema = rows.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in PREDICTED.split(", ")]).schema
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                counts = [ngram_counts(t.as_py()) for t in part.column(place)]
                some = [i for i, c in enumerate(counts) if c is not None and own.languages]
                languages, scores = ["und"] * len(counts), np.zeros(len(counts))
                if some:
                    cosine = np.stack([vector(counts[i], own.idf) for i in some]) @ own.centroids.T
                    best = np.argmax(cosine, axis=1)
                    scores[some] = np.clip(cosine[np.arange(len(some)), best], 0, 1)
                    for i, b in zip(some, best.tolist()):
                        languages[i] = own.languages[b]
                rejected = [lang == "und" or score < 1 - farthest for lang, score in zip(languages, scores.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(languages), pa.array(scores), pa.array(rejected)], [f.name for f in schema]
                )

    return small_batches(rows).mapInArrow(released(run), schema)


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the doc_id as text, modulo; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of
