import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import bloom_lm, common, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def plain_base(rows):
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 != 0
    tok = [WORD.findall(lowered(t)) + ["\n"] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, tok) if train(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for (i, _), ws in zip(rows, tok):
        yield i, not train(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)


@pytest.mark.parametrize("frequent", [0, 5, 1 << 18])
def test_base_score_is_exact(spark, monkeypatch, frequent):
    monkeypatch.setattr(bloom_lm, "MAX_FREQUENT", frequent)
    rng = random.Random(3)
    words = ["the", "The", "a", "é", "É", "x\x1cy", "nbsp\xa0in", *(f"w{i}" for i in range(300))]
    rows = [(i, " ".join(words[int(rng.expovariate(0.05)) % len(words)] for _ in range(rng.randrange(50)))) for i in range(400)]
    rows += [(401, ""), (402, None), (None, "the a"), (7, "the"), (7, "the"), (403, " \t\n\x0b\x0c\r "), (404, "long " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    got = bloom_lm.score(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for g, w in zip(sorted((tuple(r) for r in got), key=key), sorted(plain_base(rows), key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isfinite(g[6]) and g[6] < 0


def test_bigrams_help_where_words_depend(spark):
    rng = random.Random(4)
    nxt = {i: rng.sample(range(200), 3) for i in range(200)}
    rows = []
    for i in range(600):
        w, out = rng.randrange(200), []
        for _ in range(60):
            out.append(f"w{w}")
            w = rng.choice(nxt[w])
        rows.append((i, " ".join(out)))
    got = bloom_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.6 * got[1]  # both are negative
    indep = [(i, " ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(60))) for i in range(600)]
    got = bloom_lm.score(spark.createDataFrame(indep, "doc_id long, text string")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 1.02 * got[1]


def test_filter_levels_and_bound(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    counts = np.minimum(rng.zipf(1.5, 20_000), 10**6)
    b = bloom_lm.bucket_of(keys, 7)
    want = np.searchsorted(bloom_lm.THRESHOLDS, counts, "right")
    bloom = bloom_lm.LogBloom([bloom_lm.segment(bloom_lm.identity(keys[b == i]), want[b == i]) for i in range(7)])
    found = bloom.levels(keys)
    assert (found >= want).all() and (found != want).mean() < 0.02
    assert (bloom.levels(rng.integers(0, 2**63, 20_000).astype(np.uint64)) > 0).mean() < 0.02
    texts = spark.createDataFrame([(f"a{i % 50} b{i} c d",) for i in range(3000)], "text string")
    words = Counter(w for i in range(3000) for w in (f"a{i % 50}", f"b{i}", "c", "d", "\n"))
    pairs = Counter(p for i in range(3000) for p in (("\n", f"a{i % 50}"), (f"a{i % 50}", f"b{i}"), (f"b{i}", "c"), ("c", "d"), ("d", "\n")))
    bloom = bloom_lm.collected(common.written(bloom_lm.segments(bloom_lm.ngram_runs(texts, 4))), 4)
    h = {w: np.array([xxhash.xxh64_intdigest(w)], np.uint64) for w in words}
    keys = np.concatenate([*h.values(), *(bloom_lm.bigram(h[x], h[y]) for x, y in pairs)])
    want = np.searchsorted(bloom_lm.THRESHOLDS, [*words.values(), *pairs.values()], "right")
    found = bloom.levels(keys)
    assert (found >= want).all() and (found != want).mean() < 0.02  # every n-gram, those seen once too


def plain_scores(rows):
    """The model with exact counts in place of the filter: counts as their levels' means, weights by leave-one-out likelihood on all texts."""
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 != 0
    tok = [WORD.findall(lowered(t)) + ["\n"] for _, t in rows]
    seqs = [ws for (i, _), ws in zip(rows, tok) if train(i)]
    one, two = Counter(w for ws in seqs for w in ws), Counter(p for ws in seqs for p in zip(["\n", *ws], ws))
    n, v = sum(one.values()), len(one)
    mean = lambda c: float(bloom_lm.VALUES[np.searchsorted(bloom_lm.THRESHOLDS, c, "right")])
    q1, q2 = {w: mean(c) for w, c in one.items()}, {p: mean(c) for p, c in two.items()}

    def parts(h, w, without):
        c1, ch, c2 = (max(c - without, 0) for c in (q1.get(w, 0), q1.get(h, 0), q2.get((h, w), 0)))
        return (c1 + 0.1) / (n - without + 0.1 * (v + 1)), min(c2 / max(ch, 1), 1), min(15, int(math.log2(max(ch, 1)) // 2))

    like = np.zeros((16, len(bloom_lm.GRID)))
    for ws in seqs:
        for h, w in zip(["\n", *ws], ws):
            p1, p2, k = parts(h, w, 1)
            like[k] += np.log(bloom_lm.GRID * p2 + (1 - bloom_lm.GRID) * p1)
    best = np.where(like.any(axis=1), bloom_lm.GRID[like.argmax(axis=1)], 0.0)
    for (i, _), ws in zip(rows, tok):
        total = 0.0
        for h, w in zip(["\n", *ws], ws):
            p1, p2, k = parts(h, w, 0)
            total += math.log10(best[k] * p2 + (1 - best[k]) * p1)
        yield i, total, len(ws)


def test_score_against_exact_counts(spark):
    rng = random.Random(12)
    nxt = {i: rng.sample(range(400), 4) for i in range(400)}
    rows = []
    for i in range(500):
        w, out = rng.randrange(400), []
        for _ in range(rng.randrange(80)):
            out.append(f"w{w}" if rng.random() < 0.95 else f"x{rng.randrange(10**6)}")
            w = rng.choice(nxt[w])
        rows.append((i, " ".join(out)))
    got = {r.doc_id: r.score for r in bloom_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = list(plain_scores(rows))
    apart = [abs(got[i] - s) / n for i, s, n in want]
    # what is left are false positives of the filter
    assert np.mean(apart) < 0.02 and abs(sum(got.values()) / sum(s for _, s, _ in want) - 1) < 0.01


def test_weights_come_from_all_training_texts(spark):
    train = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 10]
    # each of four texts alone tells the weight of its class of histories
    rows = [(i, f"u{i} v{i}") for i in train[4:8000]] + [(i, f"a{i} b{i} " * n) for i, n in zip(train[:4], (8, 40, 150, 600))]
    random.Random(3).shuffle(rows)
    got = {r.doc_id: r.score for r in bloom_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: (s, n) for i, s, n in plain_scores(rows)}
    assert len(got) == len(want) == 8000
    assert max(abs(got[i] - want[i][0]) / want[i][1] for i in train[:4]) < 0.1  # with a weight of 0 it is over 0.5


def test_a_filter_beyond_the_broadcast_keeps_all_counts(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{int(rng.expovariate(0.01))}" for _ in range(rng.randrange(60)))) for i in range(500)] + [(None, None), (None, ""), (7, "w1 w2 w3")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted(map(str, bloom_lm.score(df, max_filter_bytes=n).collect())) for n in (32 << 20, 1))
    assert one == two
    assert bloom_lm.score(df.limit(0), max_filter_bytes=-1).count() == 0


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bloom_lm.score(empty).count() == 0
    assert simhash.near_dedup(empty).count() == 0


def plain_fingerprint(t):
    ws = WORD.findall(lowered(t))
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(items, linked):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(items))]


def test_gray_index_finds_every_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    codes = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for b in base]))
    buckets = (codes % np.uint64(3)).astype(np.int64)
    got = {(min(i, j), max(i, j)) for a, b in simhash.GrayIndex(buckets, codes).within(2, 100) for i, j in zip(a.tolist(), b.tolist())}
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
    assert got == {(i, j) for i, j in zip(*np.nonzero(near)) if i < j and buckets[i] == buckets[j]}


@pytest.mark.parametrize("max_bucket", [20_000, 30, 2])
def test_links_span_all_near_fingerprints(spark, max_bucket):
    rng = random.Random(max_bucket)
    base = [rng.getrandbits(64) for _ in range(6)]
    # the last group shares 32 or 48 bits, so that buckets are divided again
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(40)} | {base[0] & ~0xFFFF | rng.getrandbits(16) for _ in range(60)} | {base[1] & ~0xFFFFFFFF | rng.getrandbits(32) for _ in range(60)}
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "fp long, node long")
    found = {r.node: r.component for r in common.components(simhash.near_links(df, 2, max_bucket)).collect()}
    want = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [found.get(i, i) for i in range(len(fps))] == want


def test_grouped_against_brute_force(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    texts = base + [None, "", " ", "One", "one two", "É é"]
    for b in base[:30]:
        for _ in range(3):
            ws = b.split()
            ws[rng.randrange(len(ws))] = "changed"
            texts.append(" ".join(ws))
        texts.append(b.upper())
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, base[0]), (None, "only null"), (900, base[1]), (900, base[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.monotonically_increasing_id())
    df = spark.createDataFrame(df.collect(), df.schema)
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp)}
    key = str
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.grouped(df, "n").collect()), key=key)
    assert got == sorted(((i, f"{f:016x}", least[c]) for (i, _), f, c in zip(rows, fps, comp)), key=key)
    left = simhash.near_dedup(df.withColumn("fp", F.lit(0)).withColumn("_ROW", F.lit(0)))
    assert left.count() == len(set(comp)) and left.columns == ["doc_id", "text", "n", "fp", "_ROW"]


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000, 2000)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}


def test_lookup_with_hot_keys(spark):
    rows = common.written(spark.createDataFrame([(i, 0 if i % 3 == 0 else i % 50) for i in range(3000)] + [(9999, None), (9998, 777)], "i long, k long"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top")).filter("k <> 777")
    got = {(r.i, r.k): r.top for r in common.lookup(rows, table, ["k"], "n", 3002).collect()}
    assert len(got) == 3002 and got[(9999, None)] is None and got[(9998, 777)] is None and got[(3, 0)] == 2997


def test_segments_and_answers_go_once_tokens_have_levels(spark, monkeypatch):
    tables, plain = [], bloom_lm.written
    monkeypatch.setattr(bloom_lm, "written", lambda df: tables.append((df.columns, out := plain(df), out.inputFiles())) or out)
    docs = spark.createDataFrame([(i, f"a few words and {i % 7} more") for i in range(60)], "doc_id long, text string")
    assert bloom_lm.score(docs).filter("score < 0").count() == 60
    left = {c: [os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in files] for columns, _, files in tables for c in columns}
    assert left["bits"] and not any(left["bits"]) and left["blob"] and not any(left["blob"])
    assert all(left["two"]) and all(left["token"])


def test_counts_of_frequent_tokens_need_no_list_of_words_and_no_distinct_hashes():
    t = bloom_lm.Tokens.of(pa.array(["b a  A b c", None, "\u00e9 \t b"]))
    assert isinstance(t.words, pa.Array) and [t.words[i].as_py() for i in t.codes.tolist()] == ["b", "a", "a", "b", "c", "\n", "\n", "\u00e9", "b", "\n"]
    tokens, counts, none = pa.array(["\u00e9", "b", "zz", "\n"]), np.array([7, 0, 5, 9]), np.zeros(len(t.words), np.uint64)
    right = [{"\u00e9": 7, "b": 0, "\n": 9}.get(w, -1) for w in t.words.to_pylist()]
    assert bloom_lm.Frequent.of(tokens, counts).counts_of(t.words, t.hashes).tolist() == right
    assert bloom_lm.Frequent.of(tokens, counts, np.zeros(4, np.uint64)).counts_of(t.words, none).tolist() == right  # all hashes are equal
    other = bloom_lm.Frequent.of(tokens.slice(1, 1), counts[1:2], none[:1]).counts_of(t.words, none)  # other words have the token's hash
    assert other.tolist() == [0 if w == "b" else -1 for w in t.words.to_pylist()]
    assert bloom_lm.Frequent.of(pa.array([], pa.string()), np.zeros(0, np.int64)).counts_of(t.words, t.hashes).tolist() == [-1] * len(t.words)


def test_tokens_are_counted_once_more_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(bloom_lm, "MAX_OPEN", 3)
    docs = [(" ".join(f"w{(i * j) % 23}" for j in range(9)), i % 3 > 0) for i in range(40)]
    got = {r.token: (r.n, r.c) for r in bloom_lm.token_counts(spark.createDataFrame(docs, "text string, train boolean")).collect()}
    n, c = (Counter(w for text, train in docs if train or every for w in [*text.split(), "\n"]) for every in (True, False))
    assert got == {w: (n[w], c[w]) for w in n}
