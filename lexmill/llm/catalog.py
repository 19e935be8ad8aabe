"""The corpus queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bloom_lm, bpe, decontaminate, exact_dedup, language_id, line_dedup, secrets, simhash, sstable, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier stays; null texts are empty, repeated rows are told apart by row number."""
    docs = table(spark, sf_dir, "documents").withColumn("_row", F.monotonically_increasing_id())
    return exact_dedup.marked(docs, "_row", keep="largest").drop("row")


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents in identifier order, read back; null texts are empty, null identifiers come first."""
    shards = sstable.write_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return sstable.read_shards(spark, shards)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document; null texts are empty."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact unigram score and the model's score of every document; null texts are one end token, null identifiers train."""
    return bloom_lm.score(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; texts without words have fingerprint zero, null identifiers lose."""
    docs = table(spark, sf_dir, "documents").withColumn("_row", F.monotonically_increasing_id())
    return simhash.grouped(docs, "_row").select("doc_id", "fingerprint", "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; null texts and those without letters are ``und``, ties go to the first name."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with their edit distance; null and empty texts hold none, repeated rows are each reported."""
    docs = table(spark, sf_dir, "documents").withColumn("_row", F.monotonically_increasing_id())
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"), "_row").select("doc_id", "item_id", "item_chars", "edits")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a page, read back from the archives; null html is empty, of equal payloads the largest page is the response."""
    return warc.archive(table(spark, sf_dir, "pages")).drop("target")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and dropped lines of every document; null and empty texts have none, repeated rows get a row each."""
    docs = table(spark, sf_dir, "documents").withColumn("_row", F.monotonically_increasing_id())
    return line_dedup.report(docs, "_row")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets of every document; null texts have none, repeated rows get a row each."""
    return secrets.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_sstable, op3_bpe, op4_bloom_lm, op5_simhash, op6_language_id, op7_line_dedup, op8_warc, op9_decontaminate, op10_secrets)}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM d""",
}
