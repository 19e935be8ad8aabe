"""Gold sheets: which clips to transcribe by hand, with which draft, and how drafts score [C3]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import sampling
from lexmill.operators.ordering import shuffle_key


def select(clips: DataFrame, group: str, index: str, key: str, n: int, gap: int = 3, scratch: int = 0, seed: int = 0) -> DataFrame:
    """``n`` clips at most, with a ``treatment``: quotas by the square root of group sizes [A20], clips of a group at least ``gap`` apart [W18],
    ``scratch`` of them without a draft and the rest by halves with either [W20].

    A group is a recording, so it fits in a task.
    """
    sizes = clips.groupBy(group).agg(F.count("*").alias("_count"))
    quota = sampling.square_root_quota(sizes, group, "_count", n).select(group, "quota")
    rows = clips.join(quota, group).withColumn("_k", shuffle_key(key, seed))
    form = rows.schema

    def run(pdf):
        return sampling.spaced(pdf, index, "_k", int(pdf["quota"].iloc[0]), gap)

    chosen = rows.groupBy(group).applyInPandas(run, form).drop("quota", "_k")
    return sampling.treatments(chosen, key, scratch, seed)


def drafted(chosen: DataFrame, drafts: dict[str, DataFrame], key: str) -> DataFrame:
    """Adds ``draft``: the text of the clip's treatment if it is usable [F6], else null; "none" has no draft.

    ``drafts``: for each treatment a table of ``key, text``.
    """
    out = chosen.withColumn("draft", F.lit(None).cast("string"))
    for name, table in drafts.items():
        given = table.select(F.col(key).alias("_key"), F.when(X.usable_draft(F.col("text")), F.col("text")).alias("_text"))
        out = out.join(given, F.col(key) == F.col("_key"), "left").withColumn("draft", F.when(F.col("treatment") == name, F.col("_text")).otherwise(F.col("draft"))).drop("_key", "_text")
    return out


def sheet(chosen: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Chosen clips with both hypotheses, ``first`` and ``second`` [J3]; an error if a clip lacks one."""
    out = chosen
    for name, table in (("first", first), ("second", second)):
        out = out.join(table.select(key, F.col("text").alias(name)), key, "left")
    return sampling.complete(out, ["first", "second"], "gold sheet")


def score(rows: DataFrame, subsets: dict[str, Column], reference: str = "reference", hypothesis: str = "hypothesis", least: int = 5) -> DataFrame:
    """``subset, n_rows, wer, cer`` over words and characters of each subset [A16]; rates are null for under ``least`` rows.

    Subsets may overlap; a row counts in each it belongs to.
    """
    r, h = X.words(F.col(reference)), X.words(F.col(hypothesis))
    counted = rows.withColumn("_we", X.levenshtein_words(r, h)).withColumn("_w", F.size(r)).withColumn("_ce", F.levenshtein(F.trim(reference), F.trim(hypothesis))).withColumn("_c", F.length(F.trim(reference)))
    names = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in subsets.items())), lambda x: x.isNotNull())
    out = counted.select(F.explode(names).alias("subset"), "_we", "_w", "_ce", "_c").groupBy("subset")
    rate = lambda e, n: F.when((F.count("*") >= least) & (F.sum(n) > 0), F.sum(e) / F.sum(n))
    return out.agg(F.count("*").alias("n_rows"), rate("_we", "_w").alias("wer"), rate("_ce", "_c").alias("cer"))
