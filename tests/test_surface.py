import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill import __main__ as cli
from lexmill.functions import udfs
from lexmill.functions.text import symbols
from lexmill.operators import gold, ordering, quality, registry, sampling, search
from lexmill.sources import audio, manifests


def test_sql_names(spark):
    udfs.register(spark)
    n = len(symbols())
    frames = np.full((5, n + 1), -9.0)
    frames[[0, 1, 2, 3, 4], [4, 4, n, 5, 5]] = 0.0
    df = spark.createDataFrame([(frames.tolist(), [4, 5], [[1.0, 0.0], [0.0, 1.0], [1.0, 0.1]])], "logp array<array<double>>, targets array<int>, v array<array<double>>")
    r = df.selectExpr("ctc_greedy(logp) g", "ctc_beam(logp) b", "ctc_align(logp, targets) a", "agglomerate(v) c").first()
    assert (r.g, r.b, r.c) == ("ab", "ab", [0, 1, 0]) and [(s.start, s.end) for s in r.a] == [(0, 2), (3, 5)]


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "m.csv").write_text("path,text,seconds\na,hello there,3.5\nb,yes,0.01\n")
    assert cli.main(["feasibility", "--csv", str(tmp_path / "m.csv")]) == 0
    assert json.loads(capsys.readouterr().out)["infeasible"] == 1
    assert cli.main(["probe", "--csv", str(tmp_path / "m.csv"), "--out", str(tmp_path / "p.json")]) == 0 and (tmp_path / "p.json").exists()
    assert cli.main(["lm", "--csv", str(tmp_path / "m.csv"), "--order", "3", "--out", str(tmp_path / "lm")]) == 0
    assert spark.read.parquet(str(tmp_path / "lm")).count() > 0
    spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.4), ("b", 1, 0.9)], "arch string, published int, score double").write.parquet(str(tmp_path / "pub"))
    capsys.readouterr()
    assert cli.main(["models", "list", str(tmp_path / "pub"), "--architecture", "a"]) == 0
    assert json.loads(capsys.readouterr().out) == {"arch": "a", "current": "v002", "promotions": 2, "previous": "v001", "best": "v002"}
    for action, more in (("publish", ["--score", "0.5"]), ("publish", ["--score", "0.3"]), ("rollback", []), ("promote", ["--version", "v002"])):
        assert cli.main(["models", action, str(tmp_path / "reg"), "--architecture", "m", *more]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["current"] == "v002"
    spark.createDataFrame([("u", i, [-0.1, -9.0, -3.0]) for i in range(3)], "utt string, frame int, logp array<double>").write.parquet(str(tmp_path / "post"))
    assert cli.main(["transcribe", str(tmp_path / "post"), "--symbols", "ab"]) == 0
    assert json.loads(capsys.readouterr().out) == {"utt": "u", "text": "a"}
    spark.createDataFrame([("a b", "a c"), ("x", "x")], "reference string, hypothesis string").write.parquet(str(tmp_path / "ev"))
    assert cli.main(["evaluate", str(tmp_path / "ev")]) == 0
    assert json.loads(capsys.readouterr().out)["wer"] == 0.25
    at = np.arange(48000) / 16000
    tone = lambda f: 0.3 * np.sin(2 * np.pi * f * at) * (1 + 0.3 * np.sin(2 * np.pi * 7 * at))
    (tmp_path / "wav").mkdir()
    (tmp_path / "wav" / "x.wav").write_bytes(audio.encode(np.concatenate([tone(180), np.zeros(8000), tone(1700), np.zeros(8000)]), 16000))
    assert cli.main(["diarize", str(tmp_path / "wav"), "--speakers", "2"]) == 0
    assert {json.loads(x)["speaker"] for x in capsys.readouterr().out.splitlines()} == {"SPEAKER_00", "SPEAKER_01"}
    spark.createDataFrame([("r", i, f"c{i}") for i in range(40)], "rec string, idx long, clip string").write.parquet(str(tmp_path / "clips"))
    assert cli.main(["gold", "select", str(tmp_path / "clips"), "--n", "5"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 5
    assert cli.main(["gold", "score", str(tmp_path / "ev")]) == 0


def test_conll_lines_end_in_any_way(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a X\r\nb X\r\n\r\nc X\r\n")
    (tmp_path / "b.txt").write_bytes(b"d X\ne X\n \nf X\n\n\t\n\ng X")
    assert sorted(r.line for r in manifests.conll(spark, str(tmp_path)).collect()) == ["a b", "c", "d e", "f", "g"]
    many = "\n".join(f"w{i} T\nx{i} T\n" for i in range(3000))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "big.txt").write_text(many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert sorted(r.line for r in manifests.conll(spark, str(tmp_path / "c")).collect()) == sorted(f"w{i} x{i}" for i in range(3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_preview_and_sheet(spark):
    df = spark.createDataFrame([(1, "a", b"x"), (2, "b", None)], "i long, transcript string, content binary")
    assert [(r.i, r.error) for r in manifests.rows_at(df, "i", [2, 9, 1]).orderBy("i").collect()] == [(1, None), (2, "no audio"), (9, "no such row")]
    assert [tuple(r) for r in manifests.preview(df, "i", 1).collect()] == [(1, "transcript", "a")]
    cells = spark.createDataFrame([(0, ["x"]), (1, ["B", " a "]), (2, ["1", "2"]), (3, [None, " "]), (4, ["3"])], "row_no int, cells array<string>")
    assert [tuple(r) for r in manifests.sheet(cells, ["a", "b"]).orderBy("row_no").collect()] == [(2, "2", "1"), (4, None, "3")]
    with pytest.raises(manifests.SourceError):
        manifests.sheet(cells, ["c"])


def test_registry_events(spark, tmp_path):
    folder = str(tmp_path / "reg")
    assert [registry.publish(spark, folder, "m", x) for x in (0.5, 0.6, 0.4, None)] == ["v001", "v002", "v003", "v004"]
    assert registry.shown(spark, folder, "m")["current"] == "v003"
    assert registry.rollback(spark, folder, "m") == "v001" and registry.shown(spark, folder, "m")["current"] == "v001"
    registry.promote(spark, folder, "m", "v002")
    assert registry.shown(spark, folder, "m") == {"arch": "m", "current": "v002", "history": ["v001", "v002"], "versions": {"v001": 0.5, "v002": 0.6, "v003": 0.4, "v004": None}}
    with pytest.raises(LookupError):
        registry.promote(spark, folder, "m", "v009")
    with pytest.raises(LookupError):
        registry.rollback(spark, folder, "other")


def test_gold_sheet(spark):
    clips = spark.createDataFrame([(f"r{k % 3}", k // 3, f"c{k}") for k in range(90)], "rec string, idx long, clip string")
    out = gold.select(clips, "rec", "idx", "clip", 12, gap=3, scratch=4).collect()
    assert len(out) == 12 and sorted(r.treatment for r in out) == ["conformer"] * 4 + ["none"] * 4 + ["whisper"] * 4
    by = {}
    for r in out:
        by.setdefault(r.rec, []).append(r.idx)
    assert all(b - a >= 3 for v in by.values() for a, b in zip(sorted(v), sorted(v)[1:]))
    chosen = spark.createDataFrame([("a", "none"), ("b", "whisper"), ("c", "conformer"), ("d", "whisper")], "clip string, treatment string")
    text = spark.createDataFrame([(x, f"three words {x}") for x in "abc"] + [("d", "two words")], "clip string, text string")
    drafts = {r.clip: r.draft for r in gold.drafted(chosen, {"whisper": text, "conformer": text}, "clip").collect()}
    assert drafts == {"a": None, "b": "three words b", "c": "three words c", "d": None}
    assert gold.sheet(chosen, text, text, "clip").count() == 4
    with pytest.raises(ValueError):
        gold.sheet(chosen, text.filter("clip <> 'a'"), text, "clip").count()
    rows = spark.createDataFrame([("a b c", "a x c")] * 6 + [("a b", "a b")] * 2, "reference string, hypothesis string")
    got = {r.subset: (r.n_rows, r.wer and round(r.wer, 4), r.cer and round(r.cer, 4)) for r in gold.score(rows, {"ALL": F.lit(True), "short": F.length("reference") < 4}).collect()}
    assert got == {"ALL": (8, round(6 / 22, 4), round(6 / 36, 4)), "short": (2, None, None)}


def test_contained_strings(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "hello world xyz 12345"), (1, "hello world"), (2, None), (3, "日本語")], "k long, t string")
    items = spark.createDataFrame([("hello world",), ("lo wor",), ("本",), ("",), (None,), ("absent",)], "x string")
    want = [(1, ""), (1, ""), (1, "hello world"), (1, "hello world"), (1, "lo wor"), (1, "lo wor"), (3, ""), (3, "本")]
    for most in (1 << 20, 5):
        monkeypatch.setattr(search, "MOST_CHARS", most)
        assert sorted(tuple(r) for r in search.contained(docs, items, "k", "t", "x").collect()) == want


def test_speaker_split_equals_the_fold(spark):
    rng = random.Random(4)
    for dev, test in ((0.1, 0.2), (0.3, 0.05), (0.0, 0.5)):
        sizes = {f"s{i}": rng.choice((1, 2, 3, 9, 60)) for i in range(40)}
        rows = [(s, i) for s, n in sizes.items() for i in range(n)]
        total, taken, want = len(rows), {"test": 0, "dev": 0}, {}
        quota = {"test": test * total, "dev": dev * total}
        for s in sorted(sizes, key=lambda s: (hashlib.md5(f"3:{s}".encode()).hexdigest(), s)):
            want[s] = next((k for k in ("test", "dev") if taken[k] + sizes[s] <= quota[k] * 1.25 and taken[k] < quota[k]), "train")
            if want[s] != "train":
                taken[want[s]] += sizes[s]
        out = sampling.speaker_split(spark.createDataFrame(rows, "speaker string, i int"), "speaker", dev, test, seed=3)
        assert {(r.speaker, r.split) for r in out.collect()} == set(want.items())


def test_ranks_and_percentiles_with_ties(spark):
    rng = random.Random(6)
    rows = [(rng.choice((None, 1.0, 1.0, 1.0, rng.random())), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "x double, i long").repartition(5)
    want = {i: k for k, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    assert {r.i: r.rn for r in ordering.ranked(df, "x", "i").collect()} == want
    none = df.filter("x is null")
    assert quality.index_percentile(none, "x", {"m": 0.5}).first().m == 0 and quality.index_percentile(df.limit(0), "x", {"m": 0.5}).first().m == 0
    values = sorted(x for x, _ in rows if x is not None)
    assert quality.exact_median(df, "x", "m").first().m == pytest.approx((values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2)
    assert quality.exact_median(none, "x", "m").first().m is None
