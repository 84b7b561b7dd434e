"""A training corpus from ``documents``, stage by stage.

Each stage takes the rows that the one before kept. All but the last return the columns of the documents;
the last has the token ids. SQL cannot state the hashing and tokenizing stages, so there is no ORACLE_SQL;
``tests/llm/test_pipeline.py`` holds every stage against a plain version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm.bpe import encode
from sojourn.llm.exact import distinct_texts
from sojourn.llm.langid import fit, identify
from sojourn.llm.mixing import mix
from sojourn.llm.overlap import distinct_documents
from sojourn.llm.store import documents, saved

REMEMBERED = 16 << 20  # bytes of pre-tokens in a worker, which the stages of the next run find in memory
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is found; those without letters or far from every language go."""
    inner = [c if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)]  # no name meets the operator's
    found = identify(docs.toDF(*inner), fit(docs)).filter("not rejected")
    return found.select(*inner).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return distinct_texts(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles overlap by 0.8 or more the one with the smallest doc_id stays.

    The fingerprint operator proposes, then MinHash bands; whole texts decide.
    """
    return distinct_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its source's target asks for."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` of every row."""
    rows = encode(docs, RANKS, public_tokenizers.PATTERN, REMEMBERED)
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and reread."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
