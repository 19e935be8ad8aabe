import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm import bpe, exact_dedup, sstable
from lexmill.llm.piece_cache import PieceEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
NASTY = [
    "", None, " ", "  ", "\n", "a", "Hello World", "hello   world  ", "tab\tand\nnew\n\n line \n x", "don't we'll I'm it's 'S",
    "abab abababab aaaaaaaaaa mississippi banana", "naïve café Ångström Å ΑΣ ΣΑΣ İstanbul ǅ", "<|endoftext|>", "a<|endoftext|> b <|startoftext|>c",
    "x\x1cy\x1dz \x85 nbsp\xa0here   thin", "日本語のテキスト 中文 한국어", "👩‍👩‍👧 emoji 🤷🏽‍♂️!!", "1234567 3.14 a1b2c3 ½ ²", "!!! ... ??? ### $$$ %%%", "\0 null \0x",
    "é à composed ﬁ ligature ﬀ", "﻿bom ​zero", "trail ", " lead", "a  b c   d", "thththth inininin ononon", "ends with newline\n bar", "foo\n \nbar",
]


def test_pieces_equal_the_library():
    lib, own = Tokenizer.from_file(BYTE), PieceEncoder(BYTE)
    rng = random.Random(5)
    texts = NASTY + ["".join(rng.choice("ab  \n\t'st.A é 　") for _ in range(rng.randrange(40))) for _ in range(3000)]
    for t, x in zip(texts, own.encode(texts)):
        assert np.frombuffer(x, "<u4").tolist() == lib.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_pair_index_equals_the_library():
    lib, own = Tokenizer.from_file(WORD), bpe.WordBPE(WORD)
    rng = random.Random(6)
    texts = NASTY + ["".join(rng.choice("abinthre  \n'sdAÉß1.,é") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for t, x in zip(texts, own.encode(texts)):
        want = lib.encode(t or "", add_special_tokens=False).ids
        ids = np.frombuffer(x, "<u4")
        assert ids.tolist() == want, repr(t)
        assert own.decode(ids).decode() == lib.decode(want, skip_special_tokens=False), repr(t)


def test_merges_of_lower_rank_that_arise_come_first():
    # ranks such that a merge makes a pair that goes before the rest of its own rank
    sym = {"a": 0, "b": 1, "ab": 2, "aba": 3}
    ranks = {(0 << 32) | 1: (5, 2), (2 << 32) | 0: (1, 3)}

    def plain(word):
        word = list(word)
        while True:
            best = min(((ranks[(x << 32) | y][0], i) for i, (x, y) in enumerate(zip(word, word[1:])) if (x << 32) | y in ranks), default=None)
            if best is None:
                return word
            i = best[1]
            word[i : i + 2] = [ranks[(word[i] << 32) | word[i + 1]][1]]

    rng = random.Random(1)
    words = [[sym[c] for c in "abab"], *([rng.randrange(2) for _ in range(rng.randrange(12))] for _ in range(500))]
    assert bpe.merge_words(words, ranks) == [plain(w) for w in words]


def test_encode_decode_frame(spark):
    rows = [(i, t) for i, t in enumerate(NASTY)] + [(None, "x"), (3, "hi"), (3, "hi"), (99, "thing " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    lib = Tokenizer.from_file(WORD)
    got = bpe.encode_decode(df, WORD, keep_output=True).collect()
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(want, key=key)
    assert bpe.encode_decode(df.limit(0), WORD).count() == 0


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_exact_dedup_tree(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice([None, *range(200)]), rng.choice(["Same", "sAME", "same", "", None, "Ä", "ä", f"t{rng.randrange(60)}"]), 1) for _ in range(900)] + [(5, "same", 2), (5, "same", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(7).withColumn("_n", F.monotonically_increasing_id())
    df = spark.createDataFrame(df.collect(), df.schema)
    lower = lambda t: (t or "").encode().lower()
    for keep in ("largest", "smallest"):
        table = exact_dedup.digests(df, "_n")
        got = {r.digest: (r.best_id, r.copies) for r in exact_dedup.classes(table, keep, partitions).collect()}
        want = {}
        for i, t, _ in rows:
            want.setdefault(hashlib.sha256(lower(t)).digest(), []).append(i)
        pick = max if keep == "largest" else min
        assert got == {k: (pick((i for i in v if i is not None), default=None), len(v)) for k, v in want.items()}
        marked = exact_dedup.marked(df, "_n", keep=keep).collect()
        assert len(marked) == len(rows) and sum(r.kept for r in marked) == len(want)
    left = exact_dedup.exact_dedup(df.withColumn("_row", F.lit(1)).withColumn("digest", F.lit("x")))
    assert left.columns == [*df.columns, "_row", "digest"] and left.count() == len(want)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_exact_dedup_unverified_digests_stay_apart(spark):
    d = b"\1" * 32
    rows = [(0, 4, d, 7, 3), (1, 5, d, 8, 3), (2, 6, d, 7, 4), (3, 7, d, 7, 3)]
    df = spark.createDataFrame(rows, exact_dedup.DIGESTS)
    assert sorted((r.best_id, r.copies) for r in exact_dedup.classes(df, "smallest", 4).collect()) == [(4, 2), (5, 1), (6, 1)]


@pytest.mark.parametrize("per_shard", [7, 10_000])
def test_sstable_round_trip(spark, tmp_path, per_shard):
    rows = [(i * 3 - 20, t) for i, t in enumerate(NASTY)] + [(None, "null id"), (None, "other"), (10, "twice"), (10, "twice"), (2**62, "far " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(9))
    shards = sstable.write_shards(df, BYTE, rows_per_shard=per_shard, folder=f"file://{tmp_path}/t")
    lib = Tokenizer.from_file(BYTE)
    coded = sorted(((i, [*lib.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(sstable.read_shards(spark, shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in coded]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert at == sum(len(x) for _, x in coded)
    assert sorted((r.doc_id or -9, r.n_tokens, r.ids_crc32) for r in got) == sorted((i or -9, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in coded)
    for name in (10, None, -20, 2**62, 11, 5000):
        want = [x for i, x in coded if i == name]
        assert sorted(x.tolist() for x in shards.get(name)) == sorted(want)


def test_sstable_many_blocks_and_damage(tmp_path):
    path = tmp_path / "x.sst"
    with open(path, "wb") as f:
        w = sstable.Writer(f, 2)
        for i in range(5000):
            w.add(sstable.key_of(i * 2) + b"\0\0\0\0", np.arange(i % 50, dtype="<u2").tobytes())
        w.close()
    r = sstable.Reader(f"file://{path}")
    assert len(r.blocks) > 3 and r.entries == 5000 and sum(1 for _ in r) == 5000
    assert all(len(r.get(i * 2)[0]) == i % 50 for i in range(0, 5000, 37)) and not r.get(3) and not r.get(None)
    assert sum(sstable.key_of(i) in r.bloom for i in range(1, 10_000, 2)) < 250
    data = bytearray(path.read_bytes())
    data[100] ^= 1
    path.write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Reader(f"file://{path}"))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sstable.write_shards(empty, BYTE).files == []
    assert sstable.read_shards(spark, sstable.write_shards(empty, BYTE)).count() == 0


def test_merges_of_words_in_one_array():
    rng = random.Random(3)
    for _ in range(60):
        ranks, top = {}, 4
        for rank in range(12):
            if ranks.setdefault(rng.randrange(top) << 32 | rng.randrange(top), (rank, top)) == (rank, top):
                top += 1
        words = [[rng.randrange(4) for _ in range(rng.choice([0, 1, 2, 5, 30]))] for _ in range(20)]
        ids, sizes = bpe.Merges(ranks).apply(np.array([x for w in words for x in w], np.int64), np.array(list(map(len, words))))
        want = []
        for word in words:  # the plain algorithm: the lowest rank everywhere, from left to right
            while found := sorted({ranks[p] for p in (a << 32 | b for a, b in zip(word, word[1:])) if p in ranks}):
                i, out = 0, []
                while i < len(word):
                    hit = i + 1 < len(word) and ranks.get(word[i] << 32 | word[i + 1]) == found[0]
                    out.append(found[0][1] if hit else word[i])
                    i += 1 + hit
                word = out
            want.append(word)
        assert ids.tolist() == [x for w in want for x in w] and sizes.tolist() == list(map(len, want))
    assert [len(x) for x in bpe.Merges({}).apply(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_bpe_letters_need_no_pattern_and_recurring_pieces_no_second_merge(monkeypatch):
    model = bpe.WordBPE(public_tokenizers.path("word_bpe_49k.json"))
    for c in map(chr, range(1, 0x370)):
        for chunk in (c, f"a{c}B", f"{c}'s"):
            plain = unicodedata.normalize("NFC", chunk)
            assert model._words(chunk) == model.pattern.findall("".join(map(str.lower, plain))), chunk
    some = model.encode(["Über<|endoftext|>façade 12!", "", None, "ª x"])
    assert model.decoded(some) == [b" ".join(model.tokens[i] for i in np.frombuffer(x, "<u4")) for x in some]
    merged = []
    plain_merge = model.words.learn
    monkeypatch.setattr(model.words, "learn", lambda words: merged.extend(words) or plain_merge(words))
    monkeypatch.setattr(model, "pattern", None)  # words of letters do without it
    letters = "abcdefghij"
    pieces = ["".join(letters[int(d)] for d in f"{i:05d}") for i in range(60_000)]
    first = [model.encode([" ".join(pieces[i : i + 10_000])])[0] for i in range(0, 60_000, 10_000)]
    assert len(merged) == len(set(pieces))
    assert [model.encode([" ".join(x.title() for x in pieces[i : i + 10_000])])[0] for i in range(0, 60_000, 10_000)] == first
    assert model.encode([" ".join(pieces[:10_000])])[0] == first[0] and len(merged) == len(set(pieces))
