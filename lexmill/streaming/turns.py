"""Streaming forms: session-like turns, streak alarms, appended labels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, rec: str, time: str, gap: str = "500 milliseconds", late: str = "10 seconds", *extra: str) -> DataFrame:
    """Turns of a recording by gaps in event time [Z3].

    An event exactly ``gap`` after the one before joins it, as in W1. Events later than ``late`` are dropped by
    the watermark; a turn is complete when the watermark has passed its end.
    """
    return events.withWatermark(time, late).groupBy(rec, *extra, F.session_window(time, gap)).agg(F.count("*").alias("pieces")).select(rec, *extra, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "pieces")


def streaks(rows: DataFrame, run: str, order: str, bad: str, alarm: int = 100) -> DataFrame:
    """``run, streak, alarm`` after each batch of a run's rows [Z5]; the state is one number a run."""
    kind = dict(rows.dtypes)[run]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (now,) = state.get if state.exists else (0,)
        longest = now
        for value in pd.concat(list(batches)).sort_values(order)[bad]:
            now = now + 1 if value else 0
            longest = max(longest, now)
        state.update((int(now),))
        yield pd.DataFrame({run: [key[0]], "streak": [longest], "alarm": [longest >= alarm]})

    return rows.select(run, order, bad).groupBy(run).applyInPandasWithState(step, f"`{run}` {kind}, streak long, alarm boolean", "now long", "update", GroupStateTimeout.NoTimeout)


def promotions(publications: DataFrame, arch: str, order: str, score: str, version: str) -> DataFrame:
    """``arch, version`` whenever a publication is promoted [Z6]; the state is the current best a architecture."""
    kinds = dict(publications.dtypes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, any_ = state.get if state.exists else (None, False)
        out = []
        for s, v in pd.concat(list(batches)).sort_values(order)[[score, version]].itertuples(index=False):
            scored = s is not None and s == s
            if not any_ or scored and (best is None or s < best):
                out.append(v)
                best, any_ = (float(s) if scored else None), True
        state.update((best, any_))
        yield pd.DataFrame({arch: [key[0]] * len(out), version: out})

    return publications.select(arch, order, score, version).groupBy(arch).applyInPandasWithState(step, f"`{arch}` {kinds[arch]}, `{version}` {kinds[version]}", "best double, seen boolean", "append", GroupStateTimeout.NoTimeout)


def append_json(rows: DataFrame, folder: str, checkpoint: str):
    """Writes a stream as JSON lines, each row once [Z1, Z2]."""
    return rows.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
