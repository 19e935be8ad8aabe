"""Queries whose algorithm is sequential within a recording: rows only, held against plain versions by tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lexmill.operators import clusters, kernels, sampling
from lexmill.operators import language_model as lm
from lexmill.operators.ordering import shuffle_key
from lexmill.plans.base import query, read, turns

_LABELS = 6  # the last is the blank


def _posteriors(pdf: pd.DataFrame) -> np.ndarray:
    """Stand-in posteriors of a recording: peaked at a label that follows from the value."""
    v = pdf.sort_values("event_id")["value"].to_numpy()
    out = np.full((len(v), _LABELS), np.log(0.02))
    out[np.arange(len(v)), (v * 100).astype(int) % _LABELS] = np.log(0.9)
    return out


@query()
def clean_turns(spark, d):
    """W4, W5, F14"""
    t = turns(spark, d).select("rec_id", "speaker", (F.col("s") / 1e6).alias("start_s"), (F.col("e") / 1e6).alias("end_s"))
    return kernels.cleaned(t)


@query()
def alignments(spark, d):
    """Targets are every third best label"""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        logp = _posteriors(pdf)
        best = [int(x) for x in logp.argmax(axis=1) if x != _LABELS - 1][::3]
        spans = kernels.forced_align(logp, best, _LABELS - 1)
        segments = kernels.split_on_pauses(spans, "".join("abcde"[i] for i in best), 0.04, max_s=1.0, min_gap=0.04, min_s=0.1)
        score = kernels.ctc_log_prob(logp, best, _LABELS - 1) if best else 0.0
        return pd.DataFrame({"utt": [pdf["user_id"].iloc[0]], "targets": [len(best)], "spans": [len(spans)], "segments": [len(segments)], "log_prob": [score]})

    return read(spark, d, "events").select("user_id", "event_id", "value").groupBy("user_id").applyInPandas(run, "utt long, targets long, spans long, segments long, log_prob double")


@query()
def beam_decoding(spark, d):
    """K1, K2, K3, T-3, X17, X20"""
    symbols = dict(enumerate("abcde"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        logp = _posteriors(pdf)
        decode = kernels.decoder("beam", symbols, _LABELS - 1, width=5, beta=0.0)
        return pd.DataFrame({"utt": [pdf["user_id"].iloc[0]], "text": [decode(logp)], "greedy": [kernels.greedy(logp, symbols, _LABELS - 1)]})

    return read(spark, d, "events").select("user_id", "event_id", "value").groupBy("user_id").applyInPandas(run, "utt long, text string, greedy string")


@query()
def fused_decoding(spark, d):
    """Width 25 and an LM of order 3 over the names of nations, which are few"""
    lines = read(spark, d, "nation").select(F.lower("n_name").alias("line"))
    rows = [tuple(r) for r in lm.pruned(lm.counts(lines, order=3), 1).select("context", "ch", "n").collect()]
    model, symbols = kernels.Backoff(rows, 3), dict(enumerate("abcde"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        decode = kernels.decoder("beam+lm", symbols, _LABELS - 1, model, width=25, alpha=0.5, beta=0.5)
        return pd.DataFrame({"utt": [pdf["user_id"].iloc[0]], "text": [decode(_posteriors(pdf))]})

    return read(spark, d, "events").select("user_id", "event_id", "value").groupBy("user_id").applyInPandas(run, "utt long, text string")


@query()
def embedding_clusters(spark, d):
    """K7: a recording is 50 neighbouring vectors"""
    e = read(spark, d, "embeddings").withColumn("rec_id", F.floor(F.col("vec_id") / 50))
    return clusters.cluster_by(e, "rec_id", "vec_id", "embedding")


@query()
def spaced_selection(spark, d):
    """Chosen rows of a group are at least three apart"""
    e = read(spark, d, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("idx"), shuffle_key("event_id", 2).alias("k"))
    return e.groupBy("grp").applyInPandas(lambda pdf: sampling.spaced(pdf, "idx", "k", 10, 3), "grp long, idx long, k string").drop("k")


@query()
def diarized_recordings(spark, d):
    """Two tones a recording, made from its key"""

    def wave(frames):
        for pdf in frames:
            rows = []
            for r in pdf["rec_id"]:
                t = np.arange(16000 * 3) / 16000
                tone = lambda f, t=t: 0.3 * np.sin(2 * np.pi * f * t) * (1 + 0.3 * np.sin(2 * np.pi * 7 * t))
                quiet = np.full(8000, 1e-4)
                rows.append((r, 16000, np.concatenate([tone(150 + r % 40), quiet, tone(1500 + r % 300), quiet]).astype(np.float32)))
            yield pd.DataFrame(rows, columns=["rec_id", "sample_rate", "samples"])

    recs = read(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("rec_id")).distinct()
    return kernels.diarized(recs.mapInPandas(wave, "rec_id long, sample_rate int, samples array<float>"), speakers=2)
