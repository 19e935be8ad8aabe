"""From raw documents to tokens: the stages of a corpus, each written as Parquet before the next reads it.

Every stage works on all that the one before kept and returns the columns of ``documents``; the last returns
the encoded rows. The order puts cheap and strong reductions first: documents without a known language go, then
exact copies, near copies and documents with benchmark passages; only the rest is tokenised.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import bpe, decontaminate, exact_dedup, language_id, near_copies
from lexmill.llm.common import shared_dir, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or with under a fifth of their n-grams in the best language go."""
    return language_id.accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the largest identifier stays."""
    return exact_dedup.exact_dedup(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles connect (similarity of 0.8 or fingerprints within two bits) the smallest identifier stays."""
    return near_copies.near_dedup(docs, width=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage within a fifth of its length in edits go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", tokenise),
]

#: Language filters, near copies and edit distance have no SQL; tests compare ``run`` with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is a table in the shared folder."""
    base = shared_dir(spark)
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = written(stage(spark, out, sf_dir), f"{base}/{name}")
    return out
