"""Character n-grams with stupid backoff, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.ordering import lookup

BOS = "\x02"
BACKOFF = 0.4
UNSEEN = -20.0


def positions(lines: DataFrame, line: str, order: int, *keep: str) -> DataFrame:
    """``history`` (the order - 1 characters before, from the padded line) and ``ch`` of each position [T10]."""
    n = order - 1
    chars = F.filter(F.split(F.col(line), ""), lambda c: c != "")
    padded = F.concat(F.array_repeat(F.lit(BOS), n), chars)
    rows = lines.select(*keep, chars.alias("c"), padded.alias("p"))
    each = F.transform("c", lambda ch, i: F.struct(i.alias("i"), ch.alias("ch"), F.array_join(F.slice("p", i + 1, n), "").alias("history")))
    return rows.select(*keep, F.explode(each).alias("x")).select(*keep, "x.i", "x.ch", "x.history")


def counts(lines: DataFrame, line: str = "line", order: int = 6) -> DataFrame:
    """``context, ch, n`` for contexts of 0 to order - 1 characters [A8]."""
    at = positions(lines, line, order)
    top = at.groupBy("history", "ch").agg(F.count("*").alias("n"))  # combined once before the suffixes fan out
    context = F.explode(F.transform(F.sequence(F.lit(0), F.lit(order - 1)), lambda k: F.substring(F.col("history"), F.lit(order) - k, k)))
    return top.select(context.alias("context"), "ch", "n").groupBy("context", "ch").agg(F.sum("n").alias("n"))


def pruned(ngrams: DataFrame, least: int = 2) -> DataFrame:
    """N-grams seen at least ``least`` times; unigrams all stay [A10]."""
    return ngrams.filter((F.col("context") == "") | (F.col("n") >= least))


def with_totals(ngrams: DataFrame) -> DataFrame:
    """Adds each context's total [A9]."""
    return ngrams.join(ngrams.groupBy("context").agg(F.sum("n").alias("total")), "context")


def describe(ngrams: DataFrame) -> DataFrame:
    """One row: contexts, vocabulary, counted characters [A11, A13]."""
    unigram = F.col("context") == ""
    return ngrams.agg(F.count_distinct("context").alias("contexts"), F.count(F.when(unigram, 1)).alias("vocabulary"), F.sum(F.when(unigram, F.col("n"))).alias("total_counts"))


def answers(asked: DataFrame, ngrams: DataFrame, order: int) -> DataFrame:
    """``history, ch, n, log_prob`` of asked rows (history, ch, n), by the longest context known; null if the character was never seen."""
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.lit(order - 1)), lambda k: F.struct(k.alias("k"), F.substring(F.col("history"), F.lit(order) - k, k).alias("context"))))
    tried = asked.filter(F.length("history") == order - 1).select("history", "ch", "n", steps.alias("x")).select("history", "ch", F.col("n").alias("rows"), "x.k", "x.context")
    found = tried.join(with_totals(ngrams), ["context", "ch"])
    best = found.groupBy("history", "ch").agg(F.max(F.struct("k", F.log(F.col("n") / F.col("total")).alias("lp"))).alias("b"), F.max("rows").alias("rows"))
    return best.select("history", "ch", "rows", (F.col("b.lp") + (F.lit(order - 1) - F.col("b.k")) * F.log(F.lit(BACKOFF))).alias("log_prob"))


def log_probs(at: DataFrame, ngrams: DataFrame, order: int, *keep: str) -> DataFrame:
    """Natural log P(ch | history) of rows with ``history`` and ``ch``, by the longest context known [J15, X18].

    Distinct (history, ch) are looked up, one equi-join over all suffixes; a character never seen gets UNSEEN, and
    every step of backoff costs ln 0.4 (T11). Frequent n-grams come back by broadcast, all others by shuffle.
    """
    asked = at.groupBy("history", "ch").agg(F.count("*").alias("n"))
    penalty = F.log(F.lit(BACKOFF))
    known = answers(asked, ngrams, order)
    return lookup(at, known, ["history", "ch"], "rows", at.count()).drop("rows").withColumn("log_prob", F.coalesce("log_prob", F.lit(UNSEEN) + (order - 1) * penalty))


def scores(lines: DataFrame, ngrams: DataFrame, key: str, line: str = "line", order: int = 6) -> DataFrame:
    """``key, score, chars`` of each line that isn't empty [X19]; a line's equal n-grams are counted before they are looked up."""
    at = positions(lines, line, order, key).groupBy(key, "history", "ch").agg(F.count("*").alias("times"))
    scored = log_probs(at, ngrams, order)
    return scored.groupBy(key).agg(F.sum(F.col("log_prob") * F.col("times")).alias("score"), F.sum("times").alias("chars"))


def perplexity(scored: DataFrame) -> DataFrame:
    """One row: exp(-sum of scores / characters); infinite for no characters [A12]."""
    return scored.agg(F.coalesce(F.exp(-F.sum("score") / F.sum("chars")), F.lit(float("inf"))).alias("perplexity"))
