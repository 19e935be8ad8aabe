import hashlib
import random
import re
from pathlib import Path

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexmill.llm import common, decontaminate, exact_dedup, language_id, near_copies
from tests.llm.test_lm_and_simhash import lowered, plain_components

SF = "/root/testdata/sf0.001"


def distance(pattern, text):
    """Edit distance of ``pattern`` to the nearest substring, row by row."""
    row = np.zeros(len(text) + 1, int)
    t = np.array(list(text))
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        sub = row[:-1] + (t != c)
        up = row[1:] + 1
        best = np.minimum(sub, up)
        steps = np.arange(len(best))
        new[1:] = np.minimum.accumulate(np.concatenate([[i - 0], best - steps - 1]))[1:] + steps + 1
        new[1:] = np.minimum(new[1:], i + steps + 1)
        row = new
    return int(row.min())


def plain_form(text):
    """Lower case with everything but letters and digits of ASCII and characters beyond it as single blanks."""
    return " ".join("".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or "").lower()).split())


def plain_shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    return [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def plain_fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in plain_shingles(text)]
    return sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(64))


def near(a, b):
    one, two = set(plain_shingles(a)), set(plain_shingles(b))
    return len(one & two) >= 0.8 * len(one | two) if one and two else not one and not two


def test_run_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    share, n = model.shares([r.text for r in rows])
    rows = [r for r, s, k in zip(rows, share, n) if k and s.max() >= 0.2]
    last = {}
    for r in rows:
        last[lowered(r.text)] = r
    rows = sorted(last.values(), key=lambda r: r.doc_id)
    fps = [plain_fingerprint(r.text) for r in rows]
    comp = plain_components(list(range(len(rows))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2 or near(rows[a].text, rows[b].text))
    rows = [r for i, r in enumerate(rows) if comp.index(comp[i]) == i]
    names, texts = [plain_form(x.text) for x in items], [plain_form(r.text) for r in rows]
    apart = {r.doc_id: min((distance(name, t) / len(name) for name in names if name), default=1) for r, t in zip(rows, texts)}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: hashlib.sha256(np.array(lib.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for r in rows if apart[r.doc_id] > 0.2}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert want.items() <= got.items()  # no clean document goes
    leaks = [k for k, d in apart.items() if d <= 0.2]
    assert got.keys() - want.keys() <= set(leaks) and not [k for k in leaks if apart[k] <= 0.1 and k in got]
    assert sum(k not in got for k in leaks) >= 0.9 * len(leaks)


def test_near_copies_at_similarity_of_four_fifths(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(100_000)}"
    rows, similar = [], []
    for k in range(120):
        ws = [word() for _ in range(200)]
        other = list(ws)
        for i in rng.sample(range(200), 4):
            other[i] = word()
        rows += [(2 * k, " ".join(ws)), (2 * k + 1, " ".join(other))]
        one, two = (near_copies.shingle_hashes(t.encode(), 5) for _, t in rows[-2:])
        similar.append(near_copies.similarity(one, two) >= 0.8)
    # a bucket's smallest row is unlike two rows that are alike
    base = [word() for _ in range(200)]
    rows += [(1000, " ".join(base)), (1001, " ".join(base[:150] + ["x"] * 50)), (1002, " ".join(base[:150] + ["x"] * 49 + ["y"])), (None, ""), (2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit(1)).repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, df, SF)
    left = {r.doc_id for r in out.collect()}
    assert sum(similar) >= 50 and out.columns == df.columns
    assert sum(2 * k + 1 not in left for k, s in enumerate(similar) if s) >= 0.95 * sum(similar)
    assert all(2 * k in left for k in range(120)) and all(2 * k + 1 in left for k, s in enumerate(similar) if not s)
    assert {1000, 1001, 2000} <= left and 1002 not in left and None not in left
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), SF).count() == 0


def test_edit_end_against_rows():
    rng = np.random.default_rng(3)
    for _ in range(300):
        p = "".join(rng.choice(list("abc"), rng.integers(1, 12)))
        t = "".join(rng.choice(list("abc"), rng.integers(0, 25)))
        found = decontaminate.edit_end(p, t, len(p) - 1)
        d = distance(p, t)
        assert (found is None and d > len(p) - 1) or found[0] == d, (p, t, found, d)


def edited(rng, text, rate):
    c = list(text)
    for _ in range(int(rate * len(c))):
        i = rng.randrange(len(c))
        c[i : i + 1] = rng.choice([[], ["q"], [c[i], "z"]])
    return "".join(c)


def test_recall_of_edited_passages(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()]
    rng = random.Random(7)
    rows = [(k, rng.choice(docs)[:300] + " " + edited(rng, t, 0.2) + " " + rng.choice(docs)[:300]) for k, (_, t) in enumerate(items)]
    solid = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(50)]
    rows += [(3000 + k, f"{solid[k - 1]}{t}{solid[k - 2]}") for k, t in enumerate(solid)]
    rows += [(1000, None), (1001, ""), (1002, "short"), (None, items[0][1]), (None, items[0][1]), (1003, "long " * 200_000 + items[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.monotonically_increasing_id()).withColumn("edits", F.lit(1))
    bench = spark.createDataFrame([*items, *((3000 + k, t) for k, t in enumerate(solid)), (None, "null id"), (77777, None), (78, "tiny")], "item_id long, text string")
    got = decontaminate.leaks(df, bench, "n").collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert sum((k, i) in pairs for k, (i, _) in enumerate(items)) >= 0.9 * len(items)
    assert all((3000 + k, 3000 + k) in pairs for k in range(50)) and (1003, items[1][0]) in pairs
    assert sum(r.doc_id is None and r.item_id == items[0][0] for r in got) == 2
    assert decontaminate.decontaminated(df, bench).columns == df.columns
    assert decontaminate.leaks(df.limit(0), bench, "n").count() == 0 and decontaminate.leaks(df, bench.limit(0), "n").count() == 0


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeiourstlnmdp") for _ in range(rng.randrange(2, 9)))
    vocabulary = [word() for _ in range(300)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, words(rng.randrange(15, 60))) for k in range(40)]
    rows = [(d, " ".join([words(rng.randrange(40)), edited(rng, items[rng.randrange(40)][1], rng.choice((0, 0.05, 0.1, 0.15, 0.2, 0.3))), words(rng.randrange(40))])) for d in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(d, k): distance(plain_form(t), plain_form(x)) for d, x in rows for k, t in items}
    sizes = {k: len(plain_form(t)) for k, t in items}
    want = {p: e for p, e in want.items() if e <= int(0.2 * sizes[p[1]])}
    for block in (1 << 19, 1500):  # one index, and several that take turns
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
        got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string"), "doc_id").collect()}
        assert got.keys() <= want.keys() and len(got) >= 0.95 * len(want)
        assert sum(got[p] == want[p] for p in got) >= 0.95 * len(got)  # a window's margin may cut the best place


def test_short_passages_are_found_unedited(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    items = [(k, words(20)[: 8 + k % 56].strip()) for k in range(168)] + [(500, "東京都の人口")]
    rows = [(k, f"{words(9)} {t}. {words(9)}") for k, t in items[:-1]] + [(500, "質問:東京都の人口は"), (900, words(5) + " " + items[0][1] + "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.monotonically_increasing_id())
    got = decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string"), "n").collect()
    assert {k for k, _ in items} <= {r.doc_id for r in got if r.doc_id == r.item_id and r.edits == 0}
    assert not [r for r in got if r.doc_id == 900 and r.item_id == 0]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_shares_against_sets():
    rng = random.Random(2)
    letters = ["abcdefghij", "efghijklmn", "klmnopqrst"]
    text = lambda a: " ".join("".join(rng.choice(a) for _ in range(rng.randrange(2, 9))) for _ in range(60))
    have = [set(), set(), set()]
    for o, a in enumerate(letters):
        for _ in range(20):
            have[o].update(language_id.ngrams([text(a)])[0].tolist())
    keys = np.array([k for s in have for k in sorted(s)], np.uint64)
    owner = np.repeat(np.arange(3), [len(s) for s in have])
    sizes = np.array([len(s) for s in have], float)
    model = language_id.LanguageFilter.of(["x", "y", "z"], keys, owner, sizes[owner] * 10)
    for a in letters:
        t = text(a)
        mine = language_id.ngrams([t])[0].tolist()
        want = [sum(k in s for k in mine) / len(mine) for s in have]
        assert np.abs(model.shares([t])[0][0] - want).max() < 0.03


def test_language_sample_is_bounded_when_rows_share_an_identifier(spark):
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("words of row "), F.col("id")).alias("text"), F.lit("en").alias("lang")).repartition(4)
    share = language_id.LanguageFilter
    seen = []
    class Spy(share):
        @classmethod
        def of(cls, languages, keys, owner, counts):
            seen.append(counts.max())
            return share.of(languages, keys, owner, counts)
    language_id.LanguageFilter = Spy
    try:
        language_id.fit(df, per_language=500)
    finally:
        language_id.LanguageFilter = share
    assert 300 < seen[0] < 1500  # a row has the n-gram once


def test_language_edges(spark):
    rows = [(i, f"the house of words number {i}", "en") for i in range(30)] + [(100 + i, f"das haus der wörter nummer {i}", "de") for i in range(30)]
    odd = [(None, "the words", None), (200, None, "en"), (201, "", "en"), (202, "123 !?", "de"), (203, "日本", None), (204, "the\nhouse", "en"), (204, "the\nhouse", "en")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {}
    for r in language_id.identify(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [r.lang_pred for i in (200, 201, 202) for r in got[i]] == ["und"] * 3 and len(got[204]) == 2
    assert got[None][0].lang_pred == "en" and not got[None][0].held_out and all(0 <= r.score <= 1 for v in got.values() for r in v)
    assert language_id.identify(df.limit(0)).count() == 0
    assert language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0
    kept = language_id.accepted(df.withColumn("_lang", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "lang", "_lang"] and kept.count() == 60 + 3
    many = [f"l{i:03d}" for i in range(130)]
    keys = np.arange(130 * 5).astype(np.uint64)
    model = language_id.LanguageFilter.of(many, keys, np.repeat(np.arange(130), 5), np.full(650, 9.0))
    assert len(model.slices) == 3 and model.shares(["abc"])[0].shape == (1, 130)


def test_stages_read_parquet_without_a_copy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "PART_BITS", 3)
    rng = random.Random(5)
    texts = [f"{i} " + " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5000)) for i in range(60)]
    texts = [*texts, *(t.upper() for t in texts[:20]), *(t[:-60] for t in texts[20:40]), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, part in (("a", docs.filter("doc_id % 3 = 0")), ("b", docs.filter("doc_id % 3 > 0"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/t/{name}")
    folders = [f"{tmp_path}/t/a", f"{tmp_path}/t/b"]
    items = spark.createDataFrame([(1, texts[45][100:300]), (2, texts[59][2000:2200])], "item_id long, text string")
    size = lambda folder=spark.conf.get("spark.checkpoint.dir").removeprefix("file://"): sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))
    for stage, gone in (
        (exact_dedup.exact_dedup, {*range(60, 80), 101}),  # the smallest identifier stays, null is empty
        (near_copies.near_dedup, {*range(60, 100), 101}),
        (lambda df: decontaminate.decontaminated(df, items, doc_id="doc_id"), {45, 59}),
    ):
        before = size()
        out = stage(spark.read.parquet(*folders))
        got = sorted(r.doc_id for r in out.collect())
        assert out.columns == ["doc_id", "text"]
        assert size() - before < size(f"{tmp_path}/t") / 2
        # the same rows remain of a frame that is not a plain table, which is written once
        assert got == sorted(r.doc_id for r in stage(spark.read.parquet(*folders).filter("true").unionByName(docs.limit(0))).collect())
        assert set(got) == set(range(len(texts))) - gone


def test_row_numbers_of_a_file_named_twice(spark, tmp_path):
    spark.range(50).withColumn("text", F.lit("x")).coalesce(1).write.parquet(f"{tmp_path}/t")
    once, twice = (common.numbered(spark.read.parquet(*[f"{tmp_path}/t"] * n), "n") for n in (1, 2))
    assert once.select("n").distinct().count() == 50 and twice.select("n").distinct().count() == twice.count()
