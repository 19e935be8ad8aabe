import json
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import quality, registry, sampling
from lexmill.sources import audio, manifests
from lexmill.streaming import turns


def test_batches(spark):
    df = spark.createDataFrame([(i, float(i * 37 % 101)) for i in range(600)], "k long, len double")
    b = sampling.bucketed_batches(df, "k", "len", 16, 64)
    rows = b.collect()
    assert len({r.k for r in rows}) == 600 and max(sum(1 for r in rows if r.batch == x) for x in {r.batch for r in rows}) == 16
    used = quality.padding_efficiency(b, "len", "batch").first()
    flat = quality.padding_efficiency(sampling.sequential_batches(df, "k", 16), "len", "batch").first()
    assert used.used / used.padded > 0.9 > flat.used / flat.padded
    assert sampling.bucketed_batches(df, "k", "len", 16, 64, drop_last=True).count() == 592
    assert {r.k: r.batch for r in rows} != {r.k: r.batch for r in sampling.bucketed_batches(df, "k", "len", 16, 64, epoch=1).collect()}
    pair = quality.padding_efficiency(spark.createDataFrame([(1.0, 0), (3.0, 0)], "len double, batch int"), "len", "batch").first()
    assert pair.used / pair.padded == pytest.approx(4 / 6)


def test_caps_and_quotas(spark):
    df = spark.createDataFrame([("hot", i) for i in range(500)] + [("b", 1000 + i) for i in range(3)], "g string, k long")
    sizes = {r.g: r.n for r in sampling.capped(df, "g", "k", 5).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"hot": 5, "b": 3} and sampling.shuffled_head(df, "k", 7).count() == 7
    q = {r.g: r.quota for r in sampling.square_root_quota(spark.createDataFrame([("a", 100), ("b", 25), ("c", 1)], "g string, n long"), "g", "n", 10).collect()}
    assert q == {"a": 6, "b": 3, "c": 1}
    t = sampling.treatments(spark.range(21).withColumnRenamed("id", "k"), "k", 5).groupBy("treatment").count().collect()
    assert {r.treatment: r["count"] for r in t} == {"none": 5, "whisper": 8, "conformer": 8}
    assert sampling.top_fraction(df, "k", "k", 0.01).count() == 5


def test_splits_and_exclusions(spark):
    df = spark.createDataFrame([(f"s{i % 20}", i) for i in range(400)] + [("big", 1000 + i) for i in range(300)], "speaker string, clip long")
    s = sampling.speaker_split(df, "speaker", 0.1, 0.1)
    assert s.groupBy("speaker").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    share = {r.split: r.n for r in s.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert 70 <= share["test"] <= 87 and 70 <= share["dev"] <= 87
    old = spark.createDataFrame([(0, "s0", "test"), (1, "s1", "train"), (2, "s2", "dev")], "clip long, speaker string, split string")
    f = {r.clip: r.split for r in sampling.frozen_split(df, "clip", "speaker", old).collect()}
    assert f[0] == "test" and f[20] == "excluded" and f[1] == "train" and f[2] == "dev" and f[3] == "train"
    with pytest.raises(sampling.LeakError):
        sampling.frozen_split(df, "clip", "speaker", old.union(spark.createDataFrame([(99999, "zz", "dev")], old.schema)))
    held = spark.createDataFrame([("s1",)], "speaker string")
    assert sampling.excluded(df, held, ["speaker"], must_remove=True).count() == 680
    with pytest.raises(sampling.LeakError):
        sampling.excluded(df, spark.createDataFrame([("none",)], "speaker string"), ["speaker"], must_remove=True)
    with pytest.raises(sampling.LeakError):
        sampling.disjoint(df, held, ["speaker"])
    with pytest.raises(sampling.LeakError):
        sampling.complete(df.join(held.withColumn("x", F.lit(1)), "speaker", "left"), ["x"], "sheet")


def test_registry(spark):
    rows = [("a", 1, 0.50), ("a", 2, 0.40), ("a", 3, 1.00), ("a", 4, 0.40), ("b", 1, None), ("b", 2, 0.9), ("b", 3, None)]
    p = registry.auto_promoted(registry.numbered(spark.createDataFrame(rows, "arch string, k int, score double"), "arch", "k"), "arch", "score", "k")
    assert {(r.arch, r.k): r.promoted for r in p.collect()} == {("a", 1): True, ("a", 2): True, ("a", 3): False, ("a", 4): False, ("b", 1): True, ("b", 2): True, ("b", 3): False}
    s = {r.arch: (r.current, r.previous) for r in registry.state(p, "arch", "version", "k").collect()}
    assert s == {"a": ("v002", "v001"), "b": ("v002", "v001")}
    assert {r.arch: r.next_version for r in registry.next_version(p, "arch").collect()} == {"a": "v005", "b": "v004"}
    assert registry.resolve(registry.state(p, "arch", "version", "k"), p, "arch", "score", "version").first().served == "v002"
    fold = registry.fold_history
    assert fold([("promote", "v001"), ("promote", "v002"), ("rollback", None)], {"v001", "v002"}) == ("v001", ["v001"])
    assert fold([("promote", "v001"), ("promote", "v001")], {"v001"}) == ("v001", ["v001"])
    assert fold([("promote", "v001"), ("promote", "v002"), ("promote", "v003"), ("rollback", None)], {"v001", "v003"}) == ("v001", ["v001", "v002"])
    with pytest.raises(LookupError):
        fold([("promote", "v001"), ("rollback", None)], {"v001"})
    a = spark.createDataFrame([("rate", 16000), ("mels", None), ("fft", 400)], "k string, v int")
    b = spark.createDataFrame([("rate", 8000), ("mels", 80), ("fft", 400)], "k string, v int")
    assert [r.k for r in registry.incompatible(a, b, "k", "v").collect()] == ["rate"]
    files = spark.createDataFrame([("r1", "best.pt", "d1"), ("r1", "last.pt", "d2"), ("r2", "best.pt", "d1")], "run_id string, file string, digest string")
    dup = registry.duplicate_files(files, spark.createDataFrame([("d1", "v001")], "digest string, version string"), spark.createDataFrame([("r1",)], "run_id string"))
    assert [(r.run_id, r.file) for r in dup.collect()] == [("r1", "best.pt")]


def test_best_epochs_sum_in_file_order(spark, tmp_path):
    import random

    import duckdb

    from lexmill.plans import QUERIES, SQL

    r = random.Random(4)
    rows = [(run, epoch, r.randrange(90_000, 10_000_000) / 100) for run in range(6000) for epoch in (1, 2, 3, 4, 5, 6)] + [(6000, 1, None), (6000, 2, 5.0), (6001, 1, None), (6002, None, 1.0), (6002, 2, 5.0)]
    r.shuffle(rows)
    path = f"{tmp_path}/lineitem.parquet"
    for i in range(0, len(rows), 6000):
        part = spark.createDataFrame(rows[i : i + 6000], "l_orderkey long, l_linenumber int, l_extendedprice double")
        part.coalesce(1).write.parquet(f"{tmp_path}/some/part={i:06d}")
    c = duckdb.connect()
    c.sql("set threads = 1")
    c.sql(f"copy (select l_orderkey, l_linenumber, l_extendedprice from '{tmp_path}/some/*/*.parquet') to '{path}' (row_group_size 4096)")
    c.sql(f"create view lineitem as select * from '{path}'")
    want = sorted(map(repr, c.sql(SQL["best_epochs"]).fetchall()))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        got = [tuple(x) for x in QUERIES["best_epochs"](spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted(map(repr, got)) == want


def test_manifests(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Path, Sentence ,other\na.wav,hello,1\nb.wav,,2\n")
    m = manifests.manifest(spark, str(tmp_path / "a.csv"))
    assert m.columns == ["audio_path", "text", "other"] and [r.text for r in m.orderBy("audio_path").collect()] == ["hello", ""]
    with pytest.raises(manifests.SourceError):
        manifests.named(spark.createDataFrame([("x", "y")], "`English` string, `Akuapem Twi` string"))
    with pytest.raises(manifests.SourceError):
        manifests.column_for(m, "text", ["text"], "nope")
    assert manifests.parse_spec("a/b:c:test") == ("a/b:c", "test") and manifests.parse_spec("a/b:") == ("a/b", "train")
    df = spark.createDataFrame([("x", "train"), ("y", "test")], "text string, split string")
    manifests.save_split(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        manifests.save_split(df, str(tmp_path / "out"))
    df.select("text").write.parquet(str(tmp_path / "org__name" / "train"))
    assert manifests.corpus(spark, "org/name", str(tmp_path)).count() == 2
    with pytest.raises(manifests.SourceError):
        manifests.corpus(spark, "org/name:dev", str(tmp_path))
    with pytest.raises(manifests.SourceError):
        manifests.dataset(spark, str(tmp_path))
    assert manifests.dataset(spark, str(tmp_path), ["org/name"], limit=1).count() == 1
    assert {r.corpus_ord for r in manifests.combined([df, df.select("text")]).collect()} == {0, 1}
    (tmp_path / "c.conll").write_text("Ama B\nko V\n\nfie N\n\n\nna X\n")
    assert sorted(r.line for r in manifests.conll(spark, str(tmp_path / "c.conll")).collect()) == ["Ama ko", "fie", "na"]
    (tmp_path / "t.csv").write_text("x,English\n1, hi \n2,\n")
    assert manifests.translations(spark, str(tmp_path / "t.csv"), ["english"], label="l").collect()[0][:] == ("hi", "l")


def test_labels_and_logs(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"index":1,"path":"a","teacher":"t","text":"x","score":-0.5}\n{"index":2,"path":"b","skipped":"too long"}\nnot json\n')
    done, skipped = manifests.labels(spark, str(tmp_path / "l.jsonl"))
    assert [r.path for r in done.collect()] == ["a"] and [r.path for r in skipped.collect()] == ["b"]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int")
    folder = str(tmp_path / "labels")
    assert manifests.append_labels(df, folder) == 2 and manifests.append_labels(df.union(spark.createDataFrame([("c", 3)], df.schema)), folder) == 1
    assert spark.read.json(folder).count() == 3 and manifests.append_labels(df, folder) == 0
    with pytest.raises(RuntimeError), manifests.RunLog(str(tmp_path / "runs"), "r1", token="x", lr=0.1) as run:
        run.log(epoch=1, loss=2.0)
        run.log(epoch=2, loss=1.0, wer=0.5)
        raise RuntimeError
    assert json.loads((tmp_path / "runs/r1/params.json").read_text()) == {"token": "[REDACTED]", "lr": 0.1}
    assert set(manifests.metrics(spark, str(tmp_path / "runs/r1/metrics.jsonl")).columns) == {"epoch", "loss", "wer"}
    with open(tmp_path / "runs/runs.jsonl", "a") as f:
        f.write("broken {\n")
    assert [r.status for r in manifests.run_index(spark, str(tmp_path / "runs/runs.jsonl")).collect()] == ["failed"]
    grams = spark.createDataFrame([("", "a", 2), ("a", "b", 1)], "context string, ch string, n long")
    assert {json.loads(r.value)["context"] for r in manifests.ngrams_json(grams).collect()} == {"", "a"}
    manifests.report(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())[0] == {"path": "a", "v": 1}
    assert [len(b) for b in manifests.blocks(spark.range(5), 2)] == [2, 2, 1]


def test_audio(spark, tmp_path):
    x = np.sin(np.arange(8000) / 20) * 0.5
    data = audio.encode(x, 8000)
    assert audio.duration(data) == 1.0
    y, rate = audio.decode(data)
    assert rate == 8000 and np.abs(x - y).max() < 1e-3
    up, rate = audio.decode(data, 16000)
    assert rate == 16000 and len(up) == 16000
    stereo = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"LIST" + struct.pack("<I", 3) + b"abc\0data" + struct.pack("<I", 8) + struct.pack("<4h", 100, 300, -100, -300)
    assert np.allclose(audio.decode(stereo)[0] * 32768, [200, -200]) and audio.duration(stereo) == 2 / 8000
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.wav").write_bytes(data)
    (tmp_path / "d/b.wav").write_bytes(b"junk")
    (tmp_path / "d/c.txt").write_bytes(b"no")
    files = manifests.files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.seconds for r in audio.durations(files).collect()}
    assert got == {"a.wav": 1.0, "b.wav": 0.0}
    clips = {r.path.rsplit("/", 1)[1]: r.clip for r in audio.decoded(files).collect()}
    assert clips["a.wav"].seconds == 1.0 and clips["a.wav"].error is None and clips["b.wav"].samples is None and "RIFF" in clips["b.wav"].error
    df = spark.createDataFrame([((bytearray(data), "x"),), ((None, str(tmp_path / "d/a.wav")),)], "audio struct<bytes:binary,path:string>")
    by = files.withColumn("path", F.regexp_replace("path", "^file:", ""))
    assert manifests.audio_bytes(df, by_path=by).filter("content is not null").count() == 2


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    t = lambda ms: f"2024-01-01 00:00:{ms // 1000:02d}.{ms % 1000:03d}"
    rows = [(1, t(0), 1, 0.9, "v1"), (1, t(400), 0, 0.5, "v2"), (1, t(900), 0, 0.7, "v3"), (1, t(2000), 0, 0.4, "v4"), (1, t(40000), 1, None, "v5")]
    spark.createDataFrame(rows, "rec long, at string, bad int, score double, v string").withColumn("at", F.to_timestamp("at")).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)

    def ran(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name).collect()

    got = ran(turns.sessions(stream, "rec", "at"), "append", "sess")
    assert sorted(r.pieces for r in got) == [1, 3]  # a gap of exactly half a second joins; the last turn isn't complete
    assert [(r.streak, r.alarm) for r in ran(turns.streaks(stream.withColumn("zero", F.col("bad") == 0), "rec", "at", "zero", 3), "update", "strk")] == [(3, True)]
    assert [r.v for r in ran(turns.promotions(stream, "rec", "at", "score", "v"), "append", "prom")] == ["v1", "v2", "v4"]
    q = turns.append_json(stream.select("rec", "v"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 5 and time.time() > 0


def test_summaries_and_plans(spark):
    s = quality.segment_summary(spark.createDataFrame([(1.0, -0.1), (2.0, -0.2), (3.004, -0.3), (4.0, -0.4)], "seconds double, score double")).first()
    assert (s.segments, s.duration_median, s.duration_min, s.duration_max, s.total_seconds, s.score_median, s.score_p05) == (4, 3.0, 1.0, 4.0, 10.0, -0.2, -0.4)
    runs = spark.createDataFrame([("a/last.pt", 2, False), ("a/best.pt", 2, True), ("b/best.pt", 1, True)], "path string, modified int, is_best boolean")
    r = registry.resolve_checkpoint
    assert (r("x", "y", runs), r(None, "y", runs), r(None, None, runs), r(None, None, runs.filter("false"), "d")) == ("x", "y", "a/best.pt", "d")
    all_runs = spark.createDataFrame([("smoke-1", "finished", 5), ("smoke-2", "finished", 6), ("r1", "failed", 7), ("r2", "finished", 8), ("r3", "failed", 9)], "run_id string, status string, bytes long")
    one = lambda x: spark.createDataFrame([(x,)], "run_id string")
    plan = registry.removal_plan(all_runs, one("smoke-2"), one("r3"))
    assert {(p.run_id, p.reason, p.bytes) for p in plan.collect()} == {("smoke-1", "disposable", 5), ("r1", "unfinished", 7)}


def test_reference_leaks_of_short_items(spark, tmp_path):
    from lexmill.plans import corpora

    docs = [(1, "the quick brown fox jumps over the dog"), (2, "quick"), (3, None), (4, "")]
    items = [(1, "quick"), (2, "brown fox jumps over"), (3, ""), (4, "quick"), (5, "absent"), (6, "brown fox jumps under")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.leaks for r in corpora.reference_leaks(spark, str(tmp_path)).collect()}
    assert got == {1: 2, 2: 1, 3: 3, 4: 2, 5: 0, 6: 0}
