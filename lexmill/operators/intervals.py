"""Turns, regions and frames: gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, starts: Column, by: list[str], order: list[str], name: str = "island") -> DataFrame:
    """Numbers runs: a row where ``starts`` holds begins one."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))


def merge_turns(turns: DataFrame, max_gap: int | float, rec: str = "rec_id", speaker: str | None = "speaker", start: str = "s", end: str = "e", tie: str | None = None, strict: bool = False) -> DataFrame:
    """Joins consecutive turns of one speaker whose gap to the running end is at most ``max_gap`` [W1].

    ``strict``: less than it, and no speaker, as between regions of speech [W2]. One sort serves all windows (T14).
    """
    order = [start, end, *([tie] if tie else [])]
    w = W.partitionBy(rec).orderBy(*order)
    # the running end restarts where the speaker changes
    rows = turns
    if speaker:
        rows = islands(rows, ~F.coalesce(F.lag(speaker).over(w) == F.col(speaker), F.lit(False)), [rec], order, "_run")
    else:
        rows = rows.withColumn("_run", F.lit(0))
    run = W.partitionBy(rec, "_run").orderBy(*order)
    before = F.max(end).over(run.rowsBetween(W.unboundedPreceding, -1))
    gap = F.col(start) - before
    cut = rows.withColumn("_new", F.coalesce(gap >= max_gap if strict else gap > max_gap, F.lit(True)))
    cut = islands(cut, F.col("_new"), [rec, "_run"], order, "_i")
    keys = [rec, *([speaker] if speaker else []), "_run", "_i"]
    return cut.groupBy(*keys).agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("pieces")).drop("_run", "_i")


def active_runs(frames: DataFrame, rec: str, frame: str, active: str) -> DataFrame:
    """Half-open runs of consecutive active frames [W3]."""
    on = frames.filter(F.col(active))
    grouped = on.withColumn("_g", F.col(frame) - F.row_number().over(W.partitionBy(rec).orderBy(frame)))
    return grouped.groupBy(rec, "_g").agg(F.min(frame).alias("first"), (F.max(frame) + 1).alias("stop")).drop("_g")


def relabel(turns: DataFrame, rec: str = "rec_id", speaker: str = "speaker", start: str = "s") -> DataFrame:
    """SPEAKER_00, 01, ... in order of first speaking [W6]; ties by name."""
    first = turns.groupBy(rec, speaker).agg(F.min(start).alias("_first"))
    named = first.withColumn("label", F.format_string("SPEAKER_%02d", F.row_number().over(W.partitionBy(rec).orderBy("_first", speaker)) - 1))
    return turns.join(named.drop("_first"), [rec, speaker])


def drop_short(turns: DataFrame, least: int | float, start: str = "s", end: str = "e") -> DataFrame:
    """[F14, F15]"""
    return turns.filter(F.greatest(F.col(end) - F.col(start), F.lit(0)) >= least)


def padded(regions: DataFrame, pad: int | float, duration: Column, start: str = "s", end: str = "e") -> DataFrame:
    """Regions with a margin, clamped to the recording [F15]."""
    return regions.withColumn(start, F.greatest(F.lit(0), F.col(start) - pad)).withColumn(end, F.least(duration, F.col(end) + pad))


def windows(regions: DataFrame, window: int, hop: int, least: int, start: str = "s", end: str = "e") -> DataFrame:
    """Windows of each region from its start, up to the first that reaches the end [W7, Z4].

    A region no longer than a window is one window if it is long enough. Integer units.
    """
    size = F.col(end) - F.col(start)
    last = F.when(size <= window, 0).otherwise(F.ceil((size - window) / hop)).cast("long")
    at = regions.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("w"))
    begin = F.col(start) + F.col("w") * hop
    out = at.withColumn("w_start", begin).withColumn("w_end", F.least(begin + window, F.col(end)))
    return out.filter(F.col("w_end") - F.col("w_start") >= least)


def frame_means(samples: DataFrame, rec: str, order: str, value: str, frame: int, hop: int) -> DataFrame:
    """Mean square of ``frame`` samples at each ``hop``-th sample; only whole frames [W8]."""
    w = W.partitionBy(rec).orderBy(order)
    ahead = w.rowsBetween(0, frame - 1)
    rows = samples.select(rec, (F.row_number().over(w) - 1).alias("i"), F.avg(F.col(value) * F.col(value)).over(ahead).alias("ms"), F.count("*").over(ahead).alias("n"))
    return rows.filter((F.col("n") == frame) & (F.col("i") % hop == 0)).select(rec, (F.col("i") / hop).cast("long").alias("frame"), "ms")


def speech_threshold(frames: DataFrame, rec: str, db: str, margin: float = 8.0, span: float = 35.0) -> DataFrame:
    """The greater of floor + margin and peak - span, of interpolated quantiles 0.10 and 0.95 [A25, A26]."""
    q = frames.groupBy(rec).agg(F.percentile(db, 0.10).alias("floor"), F.percentile(db, 0.95).alias("peak"))
    return q.select(rec, F.greatest(F.col("floor") + margin, F.col("peak") - span).alias("threshold"))


def path_spans(path: DataFrame, utt: str, frame: str, state: str) -> DataFrame:
    """Runs of states as spans; even states are blanks [W13, D11]."""
    w = W.partitionBy(utt).orderBy(frame)
    runs = islands(path, ~F.coalesce(F.lag(state).over(w) == F.col(state), F.lit(False)), [utt], [frame], "_r")
    out = runs.groupBy(utt, "_r", state).agg(F.min(frame).alias("first"), (F.max(frame) + 1).alias("stop"))
    return out.filter(F.col(state) % 2 == 1).select(utt, F.expr(f"({state} - 1) div 2").alias("idx"), "first", "stop")


def streak(rows: DataFrame, run: str, order: list[str], bad: Column) -> DataFrame:
    """Longest run of consecutive bad rows of each run [F26]."""
    marked = islands(rows.withColumn("_bad", bad), ~F.col("_bad"), [run], order, "_i")
    sizes = marked.groupBy(run, "_i").agg(F.sum(F.col("_bad").cast("int")).alias("n"))
    return sizes.groupBy(run).agg(F.max("n").alias("longest"))


def slice_samples(samples: DataFrame, turns: DataFrame, rate: int, rec: str = "rec_id", index: str = "i") -> DataFrame:
    """Samples within each turn: int(start * rate) to int(end * rate), clamped by what there is [J16].

    A range join by blocks: each turn meets only the blocks of samples it touches.
    """
    block = rate
    a = samples.withColumn("_b", F.floor(F.col(index) / block))
    b = turns.withColumn("_from", F.floor(F.col("start_s") * rate)).withColumn("_to", F.floor(F.col("end_s") * rate))
    b = b.filter("_to > _from").withColumn("_b", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
    return b.join(a, [rec, "_b"]).filter((F.col(index) >= F.col("_from")) & (F.col(index) < F.col("_to"))).drop("_b", "_from", "_to")
