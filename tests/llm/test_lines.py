import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.llm import line_dedup as ld


def grams(s):
    return {s[i : i + 5] for i in range(len(s) - 4)} or {s}


def plain(rows):
    """Kept (row, line_no) and all lines, by brute force over distinct lines."""
    lines = [(r, i, x.strip(" \t\r").lower()) for r, (_, t) in enumerate(rows) for i, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    names = sorted({x[2] for x in lines})
    sets, root = [grams(n) for n in names], list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    comp = {n: find(i) for i, n in enumerate(names)}
    first = {}
    for r, i, n in lines:
        first.setdefault(comp[n], (r, i))
    return {(r, i): first[comp[n]] == (r, i) for r, i, n in lines}


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    base = [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(80)]
    pool = list(base)
    for b in base:
        for _ in range(3):
            c = list(b)
            c[rng.randrange(len(c))] = rng.choice("xyz")
            pool.append("".join(c))
    pool += ["", " ", "A", "a", "É é É é É", "\t tabs \r"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for i in range(200)] + [(None, None), (None, "a"), (5, base[0]), (5, base[0]), (900, "long line " * 9_000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, doc_id long, text string")
    want = plain(rows)
    got = {(r.row, r.line_no): r.kept for r in ld.marked(df, "n").collect()}
    assert got.keys() == want.keys()
    # a link that MinHash misses keeps a line more; none may go that brute force keeps
    assert not [k for k in want if want[k] and not got[k]]
    missed = sum(got[k] and not want[k] for k in want)
    assert missed <= 0.02 * sum(not v for v in want.values())
    rep = ld.report(df, "n").collect()
    assert len(rep) == len(rows) and sum(r.n_lines for r in rep) == len(want)
    wide = df.withColumn("row", F.lit(1)).withColumn("_gone", F.lit(2)).withColumn("_Row", F.lit(3))
    cleaned = ld.dedup_lines(wide)
    assert cleaned.columns == wide.columns
    out = cleaned.orderBy("n").collect()
    for (i, t), r in zip(rows, out):
        assert r.text == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if got.get((out.index(r), k), True))) or t == base[0]
    assert ld.report(df.limit(0), "n").count() == 0


def recall(spark, pairs):
    """Share of the pairs of lines that are found, each pair in a document of its own."""
    rows = [(k, "\n".join(p)) for k, p in enumerate(pairs)]
    got = ld.marked(spark.createDataFrame(rows, "n long, text string"), "n").filter("not kept").select("row").distinct().count()
    return got / max(1, len(pairs))


def edited(rng, line, low, high, alphabet):
    """A line at a similarity in [low, high) to the given one, or None."""
    other = list(line)
    for _ in range(60):
        other[rng.randrange(len(other))] = rng.choice(alphabet)
        a, b = grams(line), grams("".join(other))
        at = len(a & b) / len(a | b)
        if at < high:
            return "".join(other) if at >= low else None
    return None


def test_recall_by_similarity(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))
    spaced = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(700)]
    solid = ["".join(rng.choice(letters) for _ in range(rng.randrange(60, 200))) for _ in range(700)]
    han = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randrange(60, 200))) for _ in range(700)]
    for base, alphabet in ((spaced, letters), (solid, letters), (han, "\u3042\u3044\u3046")):
        for low, high in ((0.8, 0.85), (0.85, 0.95)):
            pairs = [(x, y) for x in base if (y := edited(rng, x, low, high, alphabet))]
            assert len(pairs) > 100 and recall(spark, pairs) >= 0.95, (low, high)
    # an edit among the first characters of a line without blanks
    early = [(x, x[:4] + "_" + x[5:]) for x in solid]
    assert recall(spark, early) >= 0.99


def test_members_that_differ_from_the_head_still_link(spark, monkeypatch):
    # all lines share one bucket, whose head is unlike two lines that are alike
    monkeypatch.setattr(ld, "bands", lambda signed: signed.select("node", F.lit(0).alias("band"), F.lit(7).cast("long").alias("key")))
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    names = [" ".join(word() for _ in range(20)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(names)] + [(100 + i, t + "x") for i, t in enumerate(names)]
    df = spark.createDataFrame(rows, "n long, text string")
    for work, block, crowd in ((1 << 14, 1024, 4096), (1, 1024, 4096), (1, 7, 4096), (1 << 14, 1024, 9)):
        monkeypatch.setattr(ld, "WORK", work)
        monkeypatch.setattr(ld, "BLOCK", block)
        monkeypatch.setattr(ld, "CROWD", crowd)
        kept = {r.row: r.kept for r in ld.marked(df, "n").collect()}
        assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(40)), (block, crowd)


def test_a_crowded_bucket_loses_no_link(spark, monkeypatch):
    # pairs with a close sketch that share none of the minima 0, 4, 8, 12 and 17, 21, 25, 29
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    pairs = []
    while len(pairs) < 6:
        base = [" ".join(word() for _ in range(20)) for _ in range(2000)]
        some = [(x, y) for x in base if (y := edited(rng, x, 0.8, 0.83, "abcdefghij"))]
        one, two = (ld.signatures(list(side)) for side in zip(*some))
        differ = one & 0xFFFF != two & 0xFFFF
        near = ((one >> 7 & 15) != (two >> 7 & 15)).sum(axis=1) <= ld.APART
        pairs += [p for p, d, n in zip(some, differ, near) if n and d[[0, 4, 8, 12]].all()]
    monkeypatch.setattr(ld, "bands", lambda signed: signed.select("node", F.lit(0).alias("band"), F.lit(7).cast("long").alias("key")))
    monkeypatch.setattr(ld, "WORK", 1)
    df = spark.createDataFrame([(j * 1000 + i, t) for j in (0, 1) for i, t in enumerate(p[j] for p in pairs)], "n long, text string")
    for block, crowd in ((1024, 4), (2, 4), (3, 4096)):
        monkeypatch.setattr(ld, "BLOCK", block)
        monkeypatch.setattr(ld, "CROWD", crowd)
        kept = {r.row: r.kept for r in ld.marked(df, "n").collect()}
        assert all(kept[i] != kept[1000 + i] for i in range(len(pairs))), (block, crowd)


def test_tables_go_before_blocks_are_compared(spark, monkeypatch):
    tables, seen, plain_written, plain_links = [], [], ld.written, ld.many_links

    def kept(df):
        tables.append(plain_written(df))
        return tables[-1]

    def there():
        return [set(t.columns) for t in tables if any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in t.inputFiles())]

    monkeypatch.setattr(ld, "written", kept)
    monkeypatch.setattr(ld, "WORK", 1)
    monkeypatch.setattr(ld, "many_links", lambda *a: seen.extend(there()) or plain_links(*a))
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    names = [" ".join(word() for _ in range(20)) for _ in range(200)]
    texts = names + ["".join(rng.choice("xyz") if rng.random() < 0.02 else c for c in n) for n in names for _ in range(4)]
    out = ld.marked(spark.createDataFrame(list(enumerate(texts)), "n long, text string"), "n")
    # of the tables with sketches, heads or sizes of buckets only the rows to compare are left
    assert [c for c in seen if c & {"s1", "head", "n_outer"}] == [{"key", "node", "component", "outer", "size", "s1", "s2", "n_outer", "n", "chars"}]
    assert not [c for c in there() if c & {"s1", "head", "n_outer", "line"}]
    assert out.count() == len(texts)


def test_lines_with_one_hash_in_common_stay_apart(spark, monkeypatch):
    first, texts = ld.first_pass, ld.line_texts
    one = F.when(F.col("id").isNotNull(), F.lit(5)).cast("long")
    monkeypatch.setattr(ld, "first_pass", lambda *a: first(*a).withColumn("id", one))
    monkeypatch.setattr(ld, "line_texts", lambda docs, text, wanted: texts(docs, text, wanted.limit(0)))
    df = spark.createDataFrame([(0, "one line of text"), (1, "another kind of thing"), (2, "one line of text")], "n long, text string")
    assert {r.row: r.kept for r in ld.marked(df, "n").collect()} == {0: True, 1: True, 2: False}


def test_pieces_of_a_long_line_make_one_signature(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc d") for _ in range(n)) for n in (1, 4, 5, 6, 300, 1000, 9)]
    whole = ld.signatures(texts)
    monkeypatch.setattr(ld, "AT_ONCE", 50)
    assert (ld.signatures(texts) == whole).all()


def test_similarity_of_many_pairs_is_exact(monkeypatch):
    rng = random.Random(11)
    for alphabet in ("abc ", "".join(chr(0x4E00 + i) for i in range(3000)) + "\U0001f600\ud800"):
        some = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 4, 5, 6, 30, 80]))) for _ in range(200)]
        texts = some + [x[: len(x) // 2] + rng.choice(alphabet) + x[len(x) // 2 + 1 :] for x in some]
        one, two = ([rng.randrange(400) for _ in range(1000)] + list(at) for at in (range(200), range(200, 400)))
        want = [len(grams(texts[i]) & grams(texts[j])) >= 0.8 * len(grams(texts[i]) | grams(texts[j])) for i, j in zip(one, two)]
        for most in (1 << 19, 50):
            monkeypatch.setattr(ld, "SHINGLES_AT_ONCE", most)
            assert ld.alike(texts, np.array(one), np.array(two), 0.8).tolist() == want


def test_a_block_reads_only_lines_with_a_close_sketch(monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    names = [" ".join(word() for _ in range(20)) for _ in range(60)]
    lines = names + [x + "x" for x in names[:30]] + [x + "xy" for x in names[:30]]
    s1, s2 = ld.packed(ld.signatures(lines))[-2:]
    n, read, plain_alike = len(lines), set(), ld.alike
    monkeypatch.setattr(ld, "alike", lambda texts, *a: read.update(texts) or plain_alike(texts, *a))
    nodes = np.arange(n) + 500
    for guests in (0, 45):
        read.clear()
        group = pa.table({"node": nodes, "component": nodes, "outer": np.ones(n, np.int64), "i": np.zeros(n, np.int32), "j": np.zeros(n, np.int32), "guest": np.arange(n) < guests, "s1": s1, "s2": s2, "line": lines})
        found = ld.links_in(group, 0.8).to_pylist()
        near = range(guests) if guests else range(n)
        want = {i: {j for j in range(guests, n) if j != i and len(grams(lines[i]) & grams(lines[j])) >= 0.8 * len(grams(lines[i]) | grams(lines[j]))} for i in near}
        root = list(range(n))
        for r in found:
            a, b = r["a"] - 500, r["b"] - 500
            assert b in want.get(a, ()) or a in want.get(b, ())
            root = [root[b] if x == root[a] else x for x in root]
        assert all(root[i] == root[j] for i, js in want.items() for j in js)
        assert len(found) == n - len(set(root))  # they span, no more
        assert not read & set(names[30:])


def test_short_lines_are_signed_together(monkeypatch):
    rng, calls, plain = random.Random(5), [], ld.minima
    texts = ["".join(rng.choice("abc dé") for _ in range(n)) for n in (7, 300, 20, 1, 90, 64, 68, 69, 40)]
    alone = np.concatenate([ld.signatures([t]) for t in texts])
    monkeypatch.setattr(ld, "AT_ONCE", 64)
    monkeypatch.setattr(ld, "minima", lambda pieces: calls.append(len(pieces)) or plain(pieces))
    assert (ld.signatures(texts) == alone).all() and ld.signatures([]).shape == (0, 32)
    assert max(calls) > 1 and sum(calls) == 5 + sum(-(-(len(t) - 4) // 64) for t in texts if len(t) > 64)


def test_lines_in_lower_case_are_those_of_the_lowered_text():
    text = "\tΟΔΟΣ \r\nΣ\nΣΑ'Σ\n İ \n\n AΣ́\nB"
    assert ld.visible(text) == [x.strip(" \t\r").lower() for x in text.split("\n")] and ld.visible(None) == []
    ones, twos = ld.keys_of(["a", "\ud800é", "b"]), ld.keys_of(["a", "b"])
    assert [c[0] for c in ones] == [c[0] for c in twos] and [c[2] for c in ones] == [c[1] for c in twos]


def test_unlike_pairs_are_told_without_their_shingles(monkeypatch):
    rng, read, plain = random.Random(14), [], ld.stretches
    for letters in ("abcdefghij é", "abcdefghij\u3042"):
        names = ["".join(rng.choice(letters) for _ in range(rng.choice([3, 5, 9, 150, 300]))) for _ in range(300)]
        texts = names + [x[:-2] + "yz" if i % 2 else "".join(rng.choice("xyz") if rng.random() < 0.1 else c for c in x) for i, x in enumerate(names)]
        one, two = np.concatenate([np.arange(300), np.arange(300)]), np.concatenate([np.arange(300, 600), rng.sample(range(600), 300)])
        want = [len(grams(texts[i]) & grams(texts[j])) >= 0.8 * len(grams(texts[i]) | grams(texts[j])) for i, j in zip(one, two)]
        read.clear()
        monkeypatch.setattr(ld, "stretches", lambda starts, sizes: read.append(int(sizes.sum())) or plain(starts, sizes))
        for most in (1 << 11, 7):
            monkeypatch.setattr(ld, "PAIRS_AT_ONCE", most, raising=False)
            assert ld.alike(texts, one, two, 0.8).tolist() == want
        # ends of lines, and shingles of little more than the pairs that are alike
        assert sum(read) < 2 * (sum(len(texts[i]) + len(texts[j]) for i, j, w in zip(one, two, want) if w) * 1.3 + 10 * len(texts))
    assert not ld.alike(["x" * 70_000 + "a", "y" * 70_000], np.array([0]), np.array([1]), 0.8)[0]
    assert ld.lowered("ÀÉ×ÞßµÿÖ A") == "àé×þßµÿö a" and ld.lowered("".join(map(chr, range(256)))) == "".join(map(chr, range(256))).lower()
