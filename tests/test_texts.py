import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import language_model as lm
from lexmill.operators import ordering, quality


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_fold_encode_decode(spark):
    assert one(spark, X.folded(F.col("t")), t="mepawokyew, ɔdɔ!") == "mepawokyew ɔdɔ"
    assert one(spark, X.decode(X.encode(F.col("t"))), t="A’b-c 3ɛ") == "a'bc 3ɛ"
    assert one(spark, X.encode(F.col("t")), t="a ɔ'") == [4, 0, 3, 1]
    assert len(X.symbols()) == 40 and len(X.symbols(False)) == 30 and X.symbols(False) == X.symbols()[:30]
    assert one(spark, X.folded(F.col("t")), t="a\tb\n") == "ab"


@pytest.mark.parametrize(("text", "frames"), [("abc", 3), ("aa", 3), ("aaa", 5), ("abbc", 5), ("", 0)])
def test_minimum_frames(spark, text, frames):
    assert one(spark, X.minimum_frames(X.characters(F.col("t"))), t=text) == frames == one(spark, X.minimum_frames_of(F.col("t")), t=text)


def test_frames_times_and_sizes(spark):
    assert one(spark, X.encoder_frames(F.col("s")), s=1.0) == 25 and one(spark, X.encoder_frames(F.col("s"), subsampling=2), s=1.0) == 50
    assert one(spark, X.timestamp(F.col("s")), s=0.0) == "00:00.0" and one(spark, X.timestamp(F.col("s")), s=65.4) == "01:05.4"
    assert [one(spark, X.human_bytes(F.col("s")), s=float(n)) for n in (5, 2048, 3 << 20, 5 << 30)] == ["5 B", "2.0 KB", "3.0 MB", "5.0 GB"]
    assert one(spark, X.log_sum_exp(F.col("a"), F.col("b")), a=0.0, b=0.0) == pytest.approx(0.693147, abs=1e-5)
    assert one(spark, X.log_sum_exp(F.col("a"), F.col("b")), a=float("-inf"), b=-1.0) == -1.0


def test_rendering_of_ties_large_texts_and_nulls(spark, tmp_path):
    from lexmill.plans import QUERIES, SQL

    texts = ["x" * n for n in (1023, 1024, 1280, 1792, 2304, 3 << 19)] + [None, "y", "z" * 70]
    rows = [(1, None if t == "y" else 10**i, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, QUERIES["rendering"](spark, str(tmp_path)).collect()))) == sorted(map(repr, c.sql(SQL["rendering"]).fetchall()))
    assert one(spark, X.human_bytes(F.col("s")), s=1280.0) == "1.2 KB" and one(spark, X.human_bytes(F.col("s")), s=1.75 * (1 << 20)) == "1.8 MB"


def test_normal_forms(spark):
    assert one(spark, X.code_switch(F.col("t")), t="‘ↄkↃ’ n'ani -- x' ' y") == "ɔkɔ n'ani x y"
    assert one(spark, X.dedup_key(F.col("t")), t="  A\n b  C ") == "a b c"
    assert one(spark, X.lookalikes(F.col("t")), t="ↄↃℇx") == 3
    assert one(spark, X.speaker_key(F.col("t")), t=" 328.0") == "328"
    assert [(one(spark, X.spec_name(F.col("t")), t=s), one(spark, X.spec_split(F.col("t")), t=s)) for s in ("repo/name", "repo/name:test", "repo/name:")] == [("repo/name", "train"), ("repo/name", "test"), ("repo/name", "train")]
    assert one(spark, X.parent(F.col("t")), t="runs\\r1\\best.pt") == "r1" and one(spark, X.basename(F.col("t")), t="a/b\\c.wav") == "c.wav"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_and_character_errors(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choice("abcdef") * rng.randrange(1, 3) for _ in range(rng.randrange(12))), " ".join(rng.choice("abcdef") for _ in range(rng.randrange(12)))) for _ in range(60)]
    rows += [(" ".join(f"w{i}" for i in range(400)), " ".join(f"w{i * 3}" for i in range(300))), ("", ""), ("", "x"), ("ɛɔ", "ab")]
    got = spark.createDataFrame(rows, "r string, h string").select("r", "h", X.levenshtein_words(X.words(F.col("r")), X.words(F.col("h"))).alias("w"), X.wer(F.col("r"), F.col("h")).alias("wer"), X.cer(F.col("r"), F.col("h")).alias("cer")).collect()
    for x in got:
        r, h = x.r.split(), x.h.split()
        assert x.w == plain_distance(r, h)
        assert x.wer == pytest.approx(x.w / len(r) if r else float(bool(h)))
        assert x.cer == pytest.approx(plain_distance(x.r.strip(), x.h.strip()) / len(x.r.strip()) if x.r.strip() else float(bool(x.h.strip())))


def test_fixed_values(spark):
    assert one(spark, X.dialect_marker(F.col("t")), t="Adze") and not one(spark, X.dialect_marker(F.col("t")), t="ade")
    assert one(spark, X.usable_draft(F.col("t")), t="one two three") and not one(spark, X.usable_draft(F.col("t")), t="a na sane firi wɔn so kɔ soro")
    assert one(spark, X.scoreable(F.col("t")), t="[?] yes") and not one(spark, X.scoreable(F.col("t")), t="[?]") and not one(spark, X.scoreable(F.col("t")), t="[skip] yes")
    assert one(spark, X.gated_repositories(F.col("t")), t="403: Access to model a/b-c is restricted, see huggingface.co/d.e/f/resolve/main") == ["a/b-c", "d.e/f"]
    assert one(spark, X.access_error(F.col("t")), t="HTTP 403") and not one(spark, X.access_error(F.col("t")), t="not found")


def test_redaction(spark):
    from lexmill.sources.manifests import redacted

    params = {"HF_TOKEN": "x", "note": "hf_" + "a" * 20 + " ok", "empty_secret": "", "n": {"api_key": "k", "list": ["sk-" + "b" * 20]}}
    assert redacted(params) == {"HF_TOKEN": X.REDACTED, "note": f"{X.REDACTED} ok", "empty_secret": "", "n": {"api_key": X.REDACTED, "list": [X.REDACTED]}}


def test_feasibility(spark):
    df = spark.createDataFrame([(10.0, "abc"), (0.1, "abcde")], "seconds double, text string")
    r = quality.feasibility_report(df).first()
    assert (r.total, r.infeasible, r.tight, r.empty) == (2, 1, 0, 0)
    tight = quality.feasibility_report(spark.createDataFrame([(1.6, "abcdefghijklmnopqrstuvwxyz'ɛɔ ")], "seconds double, text string")).first()
    assert (tight.tight, tight.infeasible) == (1, 0)
    assert quality.feasible(df, 1.0).count() == 1 and quality.feasible(df, None).count() == 2 and quality.feasible(df, 0).count() == 2
    with pytest.raises(quality.EmptyCorpus):
        quality.not_empty(quality.feasible(df, 1e6), "train")
    nothing = quality.feasibility_report(df.filter("false")).first()
    assert (nothing.total, nothing.median_headroom) == (0, 0.0)


def test_index_percentile_is_the_upper_one(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 2, 3)], "x double")
    r = quality.index_percentile(df, "x", {"m": 0.5, "p": 0.05, "top": 1.0}).first()
    assert (r.m, r.p, r.top) == (2.0, 1.0, 3.0)
    assert quality.index_percentile(spark.createDataFrame([(1.0,), (9.0,)], "x double"), "x", {"m": 0.5}).first().m == 9.0


def test_probe_counts_typographic_marks_as_dropped(spark):
    df = spark.createDataFrame([("maakye!!!", 1.0), ("n’ani", 2.0), ("", 0.0)], "text string, seconds double")
    p = quality.probe(df).first()
    assert p.kept < p.chars and p.empty == 1 and (p.digits_dropped, p.letters_dropped) == (0, 0)
    assert quality.dropped_characters(df).first()[:] == ("!", 3)
    assert {tuple(r) for r in quality.gates(quality.probe(df)).collect()} == {("empty labels", "warn"), ("low coverage", "info")}
    assert quality.enforce(quality.probe(spark.createDataFrame([("né 3", 100.0)], "text string, seconds double"), ), "train") == ["long clips", "letters dropped"]
    digits = quality.gates(quality.probe(spark.createDataFrame([("ab 3", 1.0)], "text string, seconds double"), digits=False)).collect()
    assert {r.gate for r in digits} == {"digits dropped", "letters dropped"}
    for bad in (df.filter("false"), spark.createDataFrame([("!!", 1.0)], "text string, seconds double")):
        with pytest.raises(quality.EmptyCorpus):
            quality.enforce(quality.probe(bad), "train")
    lost = spark.createDataFrame([("a", 1.0, True)], "text string, seconds double, gone boolean")
    assert ("all audio missing", "fail") in {tuple(r) for r in quality.gates(quality.probe(lost, audio_missing="gone")).collect()}


def test_language_model_against_plain_counts(spark):
    from lexmill.operators.kernels import Backoff

    rng = random.Random(2)
    lines = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 20))) for _ in range(40)]
    order = 4
    counts = {}
    for line in lines:
        p = lm.BOS * (order - 1) + line
        for i in range(order - 1, len(p)):
            for k in range(order):
                key = p[i - k : i], p[i]
                counts[key] = counts.get(key, 0) + 1
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, line string")
    table = lm.counts(df, order=order)
    assert {(r.context, r.ch): r.n for r in table.collect()} == counts
    kept = lm.pruned(table)
    plain = Backoff([(c, h, n) for (c, h), n in counts.items() if not c or n >= 2], order)
    assert all(math_close(r.n / r.total, plain.counts[r.context][r.ch] / plain.totals[r.context]) for r in lm.with_totals(kept).collect())
    tests = spark.createDataFrame([(0, "abz"), (1, "cab a"), (2, "")], "id int, line string")
    want = {}
    for i, line in [(0, "abz"), (1, "cab a")]:
        p = lm.BOS * (order - 1) + line
        want[i] = sum(plain(p[j], p[:j]) for j in range(order - 1, len(p)))
    got = {r.id: r.score for r in lm.scores(tests, kept, "id", order=order).collect()}
    assert got.keys() == want.keys() and all(math_close(got[i], want[i]) for i in want)
    assert lm.perplexity(lm.scores(tests.filter("line = ''"), kept, "id", order=order)).first()[0] == float("inf")
    assert plain("q", "zzzzzz") == pytest.approx(-20 + 3 * -0.916290731874155)


def math_close(a, b):
    return abs(a - b) < 1e-9 * max(1, abs(a))


def test_order_helpers(spark):
    df = spark.createDataFrame([(i * 7 % 100, i % 3) for i in range(100)], "k int, g int").repartition(5)
    assert sorted((r.k, r.rn) for r in ordering.ranked(df, "k").collect()) == [(i, i) for i in range(100)]
    by = {}
    for r in ordering.ranked(df, "k", partition=["g"]).collect():
        by.setdefault(r.g, []).append((r.k, r.rn))
    assert all(sorted(v) == [(k, i) for i, k in enumerate(sorted(k for k, _ in v))] for v in by.values())
    assert sorted(r.k for r in ordering.evenly_spaced(df, 10, "k").collect()) == list(range(0, 100, 10))
    assert sorted(r.k for r in ordering.evenly_spaced(df, 7, "k").collect()) == [int(i * (100 / 7)) for i in range(7)]
    assert sorted(r.k for r in ordering.strided(df, 30, "k").collect()) == [i * 3 for i in range(30)]
    head, tail = ordering.tail(df, 100, "k")
    assert head.count() == 0 and tail.count() == 100
    first = ordering.first_seen(spark.createDataFrame([("a", 2, 0), ("a", 1, 5), ("b", 9, 9)], "key string, o int, v int"), "key", "o")
    assert sorted(map(tuple, first.collect())) == [("a", 1, 5), ("b", 9, 9)]
