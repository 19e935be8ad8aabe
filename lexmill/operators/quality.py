"""Corpus gates: feasibility, probes, reasons, index percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.ordering import running_total

#: The median length in frames from which memory is at risk, and the share of characters to keep.
LONG_CLIP_FRAMES, LEAST_COVERAGE = 1200, 0.97


class EmptyCorpus(ValueError):
    """A gate left no row [G5, F25]."""


def index_percentile(df: DataFrame, value: str, fractions: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """``sorted[min(n - 1, int(n * f))]`` of each group, without interpolation; 0 of none [A2].

    A value's copies are counted first and the counts are ranked, so a group's size is its distinct values.
    The upper of two middles is the median (T1), unlike ``percentile``.
    """
    by = by or []
    # a null value counts nothing, but its group is there
    counts = df.groupBy(*by, value).agg(F.count(value).alias("_c"))
    run = with_total(running_total(counts, "_c", value, name="_upto", partition=by), by)
    place = lambda f: F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(f)))
    picks = [F.coalesce(F.min(F.when(F.col("_upto") > place(f), F.col(value))), F.lit(0)).alias(name) for name, f in fractions.items()]
    return run.groupBy(*by).agg(*picks)


def with_total(counts: DataFrame, by: list[str]) -> DataFrame:
    """Adds the sum ``_n`` of ``_c`` over each group."""
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    if not by:
        return counts.crossJoin(F.broadcast(sizes))  # one row
    same = reduce(lambda x, y: x & y, [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in by])
    return counts.alias("l").join(sizes.alias("r"), same).select("l.*", "r._n")


def exact_median(df: DataFrame, value: str, name: str) -> DataFrame:
    """One row: the median, the mean of two middles; null of none. Distinct values are ranked in ranges."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    run = with_total(running_total(counts, "_c", value, name="_upto"), [])
    middle = lambda k: F.min(F.when(F.col("_upto") > F.floor((F.col("_n") - k) / 2), F.col(value)))
    return run.agg(((middle(1) + middle(0)) / 2).alias(name))


def with_feasibility(df: DataFrame, text: str = "text", seconds: str = "seconds", subsampling: int = 4) -> DataFrame:
    """Adds ``frames``, ``needed`` and ``headroom`` of each utterance [X11, W11, D7]."""
    needed = X.minimum_frames_of(X.spoken(F.col(text)))
    out = df.withColumn("needed", needed).withColumn("frames", X.encoder_frames(F.col(seconds), subsampling=subsampling))
    return out.withColumn("headroom", F.when(F.col("needed") > 0, F.col("frames") / F.col("needed")))


def feasible(df: DataFrame, least: float | None = 1.0, **columns) -> DataFrame:
    """Rows with headroom of at least ``least``; empty targets go; None or 0 turns the filter off [F1, F2]."""
    if not least:
        return df
    out = with_feasibility(df, **columns)
    return out.filter((F.col("needed") > 0) & (F.col("headroom") >= least)).select(*df.columns)


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it has no row [F2]."""
    if df.isEmpty():
        raise EmptyCorpus(f"{what}: no row is left")
    return df


def feasibility_report(df: DataFrame, by: list[str] | None = None, **columns) -> DataFrame:
    """total, infeasible, tight (headroom under 2), empty, median and 5th percentile of headroom [A1, D17].

    Infeasible rows count in the headroom figures but not in ``tight``; empty targets count in neither (T2).
    """
    by = by or []
    # one pass over the texts: rows are counted by headroom, and all figures come from the counts
    counts = with_feasibility(df, **columns).groupBy(*by, "headroom").agg(F.count("*").alias("_rows"))
    counts = counts.withColumn("_c", F.when(F.col("headroom").isNotNull(), F.col("_rows")).otherwise(0))
    run = with_total(running_total(counts, "_c", "headroom", name="_upto", partition=by), by)
    tally = lambda c: F.coalesce(F.sum(F.when(c, F.col("_rows"))), F.lit(0)).alias
    at = lambda f: F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(f)))
    pick = lambda f: F.coalesce(F.min(F.when(F.col("headroom").isNotNull() & (F.col("_upto") > at(f)), F.col("headroom"))), F.lit(0.0)).alias
    headroom = F.col("headroom")
    return run.groupBy(*by).agg(
        tally(F.lit(True))("total"), tally(headroom < 1)("infeasible"), tally((headroom >= 1) & (headroom < 2))("tight"), tally(headroom.isNull())("empty"),
        pick(0.5)("median_headroom"), pick(0.05)("p05_headroom"),
    )


def probe(df: DataFrame, text: str = "text", seconds: str = "seconds", digits: bool = True, audio_missing: str | None = None) -> DataFrame:
    """One row: rows, texts that encode to nothing, characters kept and all, dropped digits and letters, shortest and longest, hours [A5, A7].

    Coverage lowers but doesn't fold, so typographic marks count as dropped (T7). ``audio_missing`` names a
    boolean column, if files were looked for.
    """
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    alphabet = f"[^a-z{'0-9' if digits else ''}ɛɔ' ]"
    kept, gone = F.length(F.regexp_replace(t, alphabet, "")), F.regexp_replace(t, alphabet.replace("[^", "["), "")
    only = lambda keep: F.sum(F.length(F.regexp_replace(gone, f"[^{keep}]", "")))
    missing = F.count(F.when(F.col(audio_missing), 1)) if audio_missing else F.lit(None).cast("long")
    figures = df.agg(
        F.count("*").alias("rows"), missing.alias("audio_missing"), F.count(F.when(X.folded(F.coalesce(F.col(text), F.lit("")), digits) == "", 1)).alias("empty"), F.sum(kept).alias("kept"), F.sum(F.length(t)).alias("chars"),
        only("0-9").alias("digits_dropped"), only(r"\p{L}\p{N}").alias("letters_dropped"), F.min(F.length(t)).alias("shortest"), F.max(F.length(t)).alias("longest"),
        (F.avg(seconds) * F.count("*") / 3600).alias("hours"),
    )
    both = figures.crossJoin(F.broadcast(exact_median(df, seconds, "median_seconds")))  # one row each
    return both.select(*figures.columns[:-1], "median_seconds", "hours")


def dropped_characters(df: DataFrame, text: str = "text", top: int = 10) -> DataFrame:
    """The most frequent characters beyond the vocabulary; ties by character [A6, T-4]."""
    gone = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[a-z0-9ɛɔ' ]", "")
    return df.select(F.explode(X.characters(gone)).alias("ch")).groupBy("ch").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ch").limit(top)


def gates(report: DataFrame, frames_per_second: float = 100.0, long_frames: int = LONG_CLIP_FRAMES, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """``gate, severity`` of each rule that a probe breaks: "fail" ends a run, "warn" and "info" don't [F23, F25]."""
    rows, missing, empty = F.col("rows"), F.col("audio_missing"), F.col("empty")
    low = F.col("kept") < least_coverage * F.col("chars")
    rules = [
        ("no rows", "fail", rows == 0), ("all audio missing", "fail", (rows > 0) & (missing == rows)), ("audio missing", "warn", (missing > 0) & (missing < rows)),
        ("all labels empty", "fail", (rows > 0) & (empty == rows)), ("empty labels", "warn", (empty > 0) & (empty < rows)), ("long clips", "warn", F.col("median_seconds") * frames_per_second > long_frames),
        ("digits dropped", "warn", F.col("digits_dropped") > 0), ("letters dropped", "warn", F.col("letters_dropped") > 0), ("low coverage", "info", (F.col("letters_dropped") == 0) & low),
    ]
    found = F.filter(F.array(*(F.when(c, F.struct(F.lit(g).alias("gate"), F.lit(s).alias("severity"))) for g, s, c in rules)), lambda x: x.isNotNull())
    return report.select(F.explode(found).alias("x")).select("x.gate", "x.severity")


def enforce(report: DataFrame, role: str) -> list[str]:
    """The warnings of a probe; a failed gate is an error [F23]."""
    rows = [tuple(r) for r in gates(report).collect()]  # a row a rule
    failed = [g for g, s in rows if s == "fail"]
    if failed:
        raise EmptyCorpus(f"{role}: {', '.join(failed)}")
    return [g for g, s in rows if s == "warn"]


def first_reason(rules: list[tuple[str, Column]], otherwise: str = "kept") -> Column:
    """The first rule that holds names the reason [F8, F10, F11, F12, T29]."""
    return reduce(lambda rest, r: F.when(r[1], F.lit(r[0])).otherwise(rest), reversed(rules), F.lit(otherwise))


def padding_efficiency(df: DataFrame, length: str, batch: str) -> DataFrame:
    """One row: sum of lengths over the sum of batch maximum times batch size [A4]."""
    sizes = df.groupBy(batch).agg(F.sum(length).alias("s"), F.max(length).alias("m"), F.count("*").alias("n"))
    return sizes.agg(F.sum("s").alias("used"), F.sum(F.col("m") * F.col("n")).alias("padded"))


def segment_summary(df: DataFrame, seconds: str = "seconds", score: str = "score") -> DataFrame:
    """One row: segments, upper median, shortest, longest and total seconds, upper median and 5th percentile of scores [A3]."""
    totals = df.agg(F.count("*").alias("segments"), F.bround(F.min(seconds), 2).alias("duration_min"), F.bround(F.max(seconds), 2).alias("duration_max"), F.bround(F.sum(seconds), 1).alias("total_seconds"))
    lengths, scores = index_percentile(df, seconds, {"duration_median": 0.5}), index_percentile(df, score, {"score_median": 0.5, "score_p05": 0.05})
    rounded = scores.select(F.bround("score_median", 3).alias("score_median"), F.bround("score_p05", 3).alias("score_p05"))
    return totals.crossJoin(F.broadcast(lengths.select(F.bround("duration_median", 2).alias("duration_median")))).crossJoin(F.broadcast(rounded))  # one row each
