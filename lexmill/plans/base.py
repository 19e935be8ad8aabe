"""The register of queries: a function of (spark, sf_dir) and, where there is one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_fold(column: str) -> str:
    return f"translate({column}, {quoted(X.FOLD_FROM)}, {quoted(X.FOLD_TO)})"


def sql_spoken(column: str, digits: str = "0-9") -> str:
    return f"regexp_replace(lower({sql_fold(column)}), '[^a-z{digits}ɛɔ'' ]', '', 'g')"


def sql_words(column: str) -> str:
    return f"list_filter(regexp_split_to_array(trim({column}), '\\s+'), lambda w: w <> '')"


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a manifest: a stand-in duration from the identifier."""
    return read(spark, sf_dir, "documents").withColumn("seconds", ((F.col("doc_id") * 7919) % 3000).cast("double") / 100.0)


UTTERANCES = "(SELECT *, ((doc_id * 7919) % 3000)::DOUBLE / 100.0 AS seconds FROM documents)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as speaker turns in microseconds: recording, speaker, start and end."""
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("rec_id"), F.col("event_type").alias("speaker"), start.alias("s"), (start + F.floor(F.col("value") * 1e6)).cast("long").alias("e"), "value")


TURNS = "(SELECT event_id, user_id AS rec_id, event_type AS speaker, epoch_us(ts) AS s, epoch_us(ts) + floor(value * 1e6)::BIGINT AS e, value FROM events)"
