import math
import random

import numpy as np
import pytest

from lexmill.operators import clusters, intervals, kernels

A, B, C = "A", "B", "C"


def test_merge_turns(spark):
    rows = [(1, "A", 0.0, 1.0), (1, "A", 1.5, 2.0), (1, "A", 2.6, 3.0), (1, "B", 3.0, 4.0), (2, "A", 0.0, 5.0), (2, "A", 1.0, 2.0), (2, "A", 5.2, 6.0)]
    df = spark.createDataFrame(rows, "rec_id int, speaker string, s double, e double")
    got = sorted((r.rec_id, r.speaker, r.s, r.e) for r in intervals.merge_turns(df, 0.5).collect())
    assert got == [(1, "A", 0.0, 2.0), (1, "A", 2.6, 3.0), (1, "B", 3.0, 4.0), (2, "A", 0.0, 6.0)]
    strict = sorted((r.s, r.e) for r in intervals.merge_turns(df.filter("rec_id = 1"), 0.5, speaker=None, strict=True).collect())
    assert strict == [(0.0, 1.0), (1.5, 2.0), (2.6, 4.0)]  # equal gaps stay apart, longer ones too


def test_merge_equals_the_list_form(spark):
    rng = random.Random(3)
    rows = [(r, rng.choice("AB"), s, s + rng.randrange(1, 30)) for r in range(20) for s in sorted(rng.sample(range(300), 20))]
    got = sorted((r.rec_id, r.speaker, r.s, r.e) for r in intervals.merge_turns(spark.createDataFrame(rows, "rec_id int, speaker string, s long, e long"), 3).collect())
    want = sorted((r, *t) for r in range(20) for t in kernels.merge_adjacent([x[1:] for x in rows if x[0] == r], 3))
    assert got == want


def test_relabel_and_short(spark):
    df = spark.createDataFrame([(1, "cluster_7", 5.0, 6.0), (1, "cluster_2", 0.0, 1.0), (1, "x", 2.0, 2.2)], "rec_id int, speaker string, s double, e double")
    assert {r.speaker: r.label for r in intervals.relabel(df).collect()} == {"cluster_2": "SPEAKER_00", "x": "SPEAKER_01", "cluster_7": "SPEAKER_02"}
    assert intervals.drop_short(df, 0.35).count() == 2


def test_windows_equal_the_list_form(spark):
    regions = [(0, 1000), (1000, 2000), (0, 200), (0, 5200), (300, 1800), (0, 1501), (0, 4000)]
    got = sorted((r.s, r.e, r.w_start, r.w_end) for r in intervals.windows(spark.createDataFrame(regions, "s long, e long"), 1500, 750, 500).collect())
    want = sorted((a, b, *w) for a, b in regions for w in kernels.window_regions([(a, b)], 1500, 750, 500))
    assert got == want


def test_overlaps():
    assert kernels.resolve_overlaps([(A, 0, 2), (B, 1, 3)]) == [(A, 0, 1.5), (B, 1.5, 3)]
    assert kernels.resolve_overlaps([(A, 0, 10), (B, 2, 4)]) == [(A, 0, 2), (B, 2, 4), (A, 4, 10)]
    assert kernels.resolve_overlaps([(A, 0, 10), (B, 2, 5), (C, 3, 4)]) == [(A, 0, 2), (B, 2, 5), (C, 3, 4), (A, 4, 10)]
    assert kernels.resolve_overlaps([(A, 0, 2), (A, 1, 5), (A, 7, 7)]) == [(A, 0, 5)]
    assert kernels.clean_turns([(A, 0, 0.2), (B, 1, 3)]) == [(B, 1, 3)]
    rng = random.Random(4)
    for _ in range(100):
        turns = [(rng.choice("ABC"), s := rng.randrange(50), s + rng.randrange(20)) for _ in range(8)]
        out = kernels.resolve_overlaps(turns, strict=True)
        assert all(a[2] <= b[1] for a, b in zip(out, out[1:]))
        inside = {x for _, a, b in turns for x in range(a, b)}
        assert {x for _, a, b in out for x in range(a, b)} == inside


def test_cleaned_frame(spark):
    df = spark.createDataFrame([(1, "A", 0.0, 2.0), (1, "B", 1.0, 3.0), (2, "A", 0.0, 0.1)], "rec_id long, speaker string, start_s double, end_s double")
    assert sorted(map(tuple, kernels.cleaned(df).collect())) == [(1, "A", 0.0, 1.5), (1, "B", 1.5, 3.0)]


def peaked(labels, classes, p=0.9):
    out = np.full((len(labels), classes), np.log((1 - p) / (classes - 1)))
    out[np.arange(len(labels)), labels] = np.log(p)
    return out


def test_forced_alignment_against_all_paths():
    assert [(s.start, s.end) for s in kernels.forced_align(peaked([1, 1, 0, 2, 2], 3), [1, 2], 0)] == [(0, 2), (3, 5)]
    assert kernels.forced_align(peaked([1, 1], 3), [1, 1], 0) == [] and kernels.forced_align(peaked([1], 3), [], 0) == []
    rng = np.random.default_rng(1)
    from itertools import product

    for _ in range(30):
        logp = np.log(rng.dirichlet(np.ones(3), 5))
        target = rng.integers(1, 3, rng.integers(1, 4)).tolist()

        def collapse(path):
            return [x for i, x in enumerate(path) if x and (not i or x != path[i - 1])]

        scores = [sum(logp[t, x] for t, x in enumerate(p)) for p in product(range(3), repeat=5) if collapse(p) == target]
        spans = kernels.forced_align(logp, target, 0)
        if not scores:
            assert spans == [] and kernels.ctc_log_prob(logp, target, 0) == -math.inf
            continue
        assert kernels.ctc_log_prob(logp, target, 0) == pytest.approx(float(np.logaddexp.reduce(scores)))
        assert [s.token for s in spans] == target and all(a.end <= b.start for a, b in zip(spans, spans[1:]))
        path = np.zeros(5, int)
        for s in spans:
            path[s.start : s.end] = s.token
        assert sum(logp[t, x] for t, x in enumerate(path)) == pytest.approx(max(scores))


def test_beam_search():
    symbols = {0: "a", 1: "b"}
    logp = peaked([0, 0, 2, 0, 1], 3)
    assert kernels.beam_search(logp, symbols, 2, alpha=0, beta=0) == kernels.greedy(logp, symbols, 2) == "aab"
    assert kernels.beam_search(np.zeros((0, 3)), symbols, 2) == "" == kernels.greedy(np.zeros((0, 3)), symbols, 2)
    unsure = np.log(np.array([[0.5, 0.499, 0.001]]))
    like_b = lambda ch, prefix: 0.0 if ch == "b" else -5.0
    assert kernels.beam_search(unsure, symbols, 2, like_b) == "b" and kernels.beam_search(unsure, symbols, 2, like_b, alpha=0) == "a"
    rng = np.random.default_rng(5)
    from itertools import product

    for _ in range(20):
        logp = np.log(rng.dirichlet(np.ones(3), 4))
        mass = {}
        for p in product(range(3), repeat=4):
            s = "".join(symbols[x] for i, x in enumerate(p) if x != 2 and (not i or x != p[i - 1]))
            mass[s] = np.logaddexp(mass.get(s, -np.inf), sum(logp[t, x] for t, x in enumerate(p)))
        assert kernels.beam_search(logp, symbols, 2, alpha=0, beta=0, width=100, prune=-1e9) == max(mass, key=mass.get)
    assert kernels.decoder("beam+lm", symbols, 2)(peaked([0], 3)) == "a"
    with pytest.raises(ValueError):
        kernels.decoder("x", symbols, 2)


def test_segments():
    spans = [kernels.Span(i, 0 if c == " " else 1, a, a + 2, -0.1) for i, (c, a) in enumerate(zip("ab cd", (0, 2, 30, 60, 62)))]
    got = kernels.split_on_pauses(spans, "ab cd", 0.04, space=0, max_s=1.0, min_s=0.1)
    assert [g["text"] for g in got] == ["ab", "cd"]
    assert kernels.split_on_pauses([], "", 0.04) == [] and len(kernels.split_on_pauses(spans, "ab cd", 0.04, max_s=60)) == 1
    whole = kernels.split_on_pauses([kernels.Span(i, 1, i * 100, (i + 1) * 100, 0.0) for i in range(3)], "abc", 0.04, max_s=1.0)
    assert len(whole) == 1  # no pause, no cut


def test_clustering(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (10, 8)) for c in np.eye(8)[:3]])
    labels = clusters.agglomerate(x, 0.5)
    assert len(set(labels)) == 3 and all(len(set(labels[i : i + 10])) == 1 for i in (0, 10, 20))
    assert len(set(clusters.agglomerate(x, clusters=2))) == 2 and set(clusters.agglomerate(x, clusters=1)) == {0}
    assert len(set(clusters.agglomerate(np.eye(8), 0.1, most=3))) == 3


def tone(f, seconds, rate=16000):
    t = np.arange(int(seconds * rate)) / rate
    return 0.4 * np.sin(2 * np.pi * f * t) * (1 + 0.3 * np.sin(2 * np.pi * 6 * t))


def test_speech_detection_and_diarization(spark):
    quiet = np.random.default_rng(1).normal(0, 1e-4, 16000)
    wave = np.concatenate([quiet, tone(200, 3), quiet, tone(1800, 3), quiet])
    regions = kernels.detect_speech(wave, 16000)
    assert len(regions) == 2 and all(abs(a - b) <= 0.15 for r, w in zip(regions, [(1, 4), (5, 8)]) for a, b in zip(r, w))
    assert kernels.detect_speech(np.zeros(0), 16000) == [] and kernels.detect_speech(np.zeros(16000), 16000) == [(0.0, 1.0)]
    turns = kernels.diarize(wave, 16000, speakers=2)
    assert [t[0] for t in turns] == ["SPEAKER_00", "SPEAKER_01"]
    df = spark.createDataFrame([(1, 16000, wave.astype(float).tolist())], "rec_id long, sample_rate int, samples array<double>")
    assert kernels.diarized(df, speakers=2).count() == 2
    loud, soft = kernels.log_mel(wave * 100), kernels.log_mel(wave)
    assert loud.shape[0] == 80 and np.abs(kernels.log_mel(tone(300, 1) * 100) - kernels.log_mel(tone(300, 1) * 10)).mean() < 0.05 and soft.shape == loud.shape


def test_streak_and_runs(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([1, 0, 0, 0, 1, 0])], "run string, i int, v int")
    assert intervals.streak(df, "run", ["i"], df["v"] == 0).first().longest == 3
    f = spark.createDataFrame([(1, i, a) for i, a in enumerate([True, True, False, True])], "rec int, frame int, active boolean")
    assert sorted((r.first, r.stop) for r in intervals.active_runs(f, "rec", "frame", "active").collect()) == [(0, 2), (3, 4)]
