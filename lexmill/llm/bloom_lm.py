"""LM scoring from a log-frequency Bloom filter (after Talbot and Osborne, 2007).

A count c has the level q(c): the number of thresholds 1, 2, 3, ... (each the next integer or ``BASE`` times the
last, whichever is more) that are not above c. Of an n-gram the filter holds (n-gram, 1) to (n-gram, q). A
reader probes levels from 1 upwards until one is missing; the last level found stands for the geometric mean
of its counts. Unigrams and bigrams of all training texts are counted: a task packs the sorted 64-bit keys of
its partition by bucket, a bucket's runs meet in one task, which merges them and writes the
bucket's segment of the filter. All n-grams enter it, whatever their count.

Model: P(w | h) = m P2(w | h) + (1 - m) P1(w), with P2 the ratio of counts and P1 add-``ADD`` smoothed, both from
the filter. m depends on the order of magnitude of h's count and is set by leave-one-out likelihood over all tokens of all
training texts: these are counted by the levels of word, history and bigram, and each such triple is weighed once.

The filter, which grows with the n-grams, stays in its segments: the distinct n-grams of each batch of texts go to their buckets by a
shuffle, and a byte comes back for each. Each token's levels are written, so weights and scores need one probe. A caller may
allow a broadcast of a filter of at most ``max_filter_bytes``; scores are the same. The counts of at most ``MAX_FREQUENT`` tokens that are
frequent in all texts, held out or not, are broadcast; exact counts of all other tokens come by a join.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import batches_of, crc_of_id, discard, tidy, written
from lexmill.llm.memo import tidied

BASE, ADD = 1.2, 0.1
BITS_PER_ENTRY, HASHES = 12, 4
MAX_FREQUENT = 1 << 18
BUCKET_TOKENS, MAX_BUCKETS = 1 << 22, 1 << 14  # tokens of all texts a bucket of n-grams
MAX_OPEN = 300_000  # distinct tokens or, times 4, n-grams that a task holds before it passes them on
BATCH = 4 << 20  # bytes of text worked on together
PROBED = 1 << 20  # n-grams that chunks ask of a segment at once
MAX_TRIPLES = 1 << 20  # of levels that a task holds before it passes them on
GRID = np.array([0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
CLASSES = 16  # of histories, by the power of 4 in their count
U = np.uint64
END = "\n"  # no word has white space


def thresholds(base: float = BASE, top: float = 1e15) -> np.ndarray:
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * base)))
    return np.array(out, np.int64)


THRESHOLDS = thresholds()
#: The count that a level stands for.
VALUES = np.concatenate([[0.0], np.sqrt(THRESHOLDS[:-1] * (THRESHOLDS[1:] - 1.0))])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def bigram(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(history * U(0x9E3779B97F4A7C15) + (word ^ U(0xD1B54A32D192ED03)))


def hashes_of(words: pa.Array) -> np.ndarray:
    listed = words.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist
    return np.fromiter(map(xxhash.xxh64_intdigest, listed), np.uint64, len(listed))


@dataclass
class Frequent:
    """Counts of tokens, found by hash; a token that is found is compared, so equal hashes mislead nothing."""

    tokens: pa.Array
    counts: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, tokens: pa.Array, counts: np.ndarray, hashes: np.ndarray | None = None) -> Frequent:
        hashes = hashes_of(tokens) if hashes is None else hashes
        order = np.argsort(hashes)
        return cls(tokens.take(pa.array(order)), counts[order], hashes[order])

    def counts_of(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The count of each word, -1 where it isn't among the tokens."""
        if not len(self.tokens):
            return np.full(len(words), -1)
        if (self.hashes[1:] == self.hashes[:-1]).any():
            place = pc.index_in(words, value_set=self.tokens).fill_null(-1).to_numpy()
            return np.append(self.counts, -1)[place]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = pc.equal(self.tokens.take(pa.array(at)), words).to_numpy(zero_copy_only=False)
        return np.where(same, self.counts[at], -1)


@dataclass
class Tokens:
    """Tokens of a batch: codes into ``words``, each text followed by the end token; ``starts`` has texts + 1 places."""

    codes: np.ndarray
    words: pa.Array
    starts: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Tokens:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
        bounds, values = lists.offsets.to_numpy(), lists.flatten()
        bounds = bounds - bounds[0]
        full = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(full)])[bounds]
        coded = values.filter(pa.array(full)).dictionary_encode()
        words = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([END], pa.string())])
        codes = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends[1:], len(words) - 1)
        return cls(codes, words, ends + np.arange(len(ends)))

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return hashes_of(self.words)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unigram key, history's key and bigram key of each token; the history of a first word is the end token."""
        hashed = self.hashes
        word = hashed[self.codes]
        history = np.concatenate([hashed[-1:], word[:-1]])
        return word, history, bigram(history, word)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)  # sums don't turn on the order of equal keys
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts[order], at)


def is_training(doc_id: str) -> Column:
    """True unless CRC-32 of the identifier as text is divisible by 10; a null identifier trains."""
    return F.coalesce(crc_of_id(doc_id) % 10 != 0, F.lit(True))


def token_counts(texts: DataFrame) -> DataFrame:
    """``token, n, c``: occurrences in all whole texts and in training texts (columns ``text``, ``train``), with the end token of each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum"), ("c", "sum")]).select(["token", "n_sum", "c_sum"]).rename_columns(["token", "n", "c"])

        for whole in batches:
            for batch in batches_of(whole, BATCH):
                t = Tokens.of(batch.column(0))
                mine = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(t.starts))
                counts = [np.bincount(x, minlength=len(t.words)) for x in (t.codes, t.codes[mine])]
                held.append(pa.table([t.words, *map(pa.array, counts)], ["token", "n", "c"]))
                if sum(x.num_rows for x in held) > MAX_OPEN * 2:
                    held[:] = [merged()]
                    if held[0].num_rows > MAX_OPEN:
                        yield from held.pop().to_batches()
        if held:
            yield from merged().to_batches()

    return texts.mapInArrow(tidied(count), "token string, n long, c long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).filter("n > 0")


def ngram_runs(texts: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n, keys, counts``: runs of sorted identities of unigrams and bigrams with their counts; a bucket's runs are in one partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out():
            places, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            held.clear()
            cuts = np.searchsorted(places >> U(32), np.arange(buckets + 1).astype(U))
            full = np.flatnonzero(np.diff(cuts))
            for at in range(0, len(full), 16):
                rows = full[at : at + 16]
                parts = [slice(cuts[i], cuts[i + 1]) for i in rows]
                keys = [squeezed(np.diff(places[x] & U(0xFFFFFFFF), prepend=U(0))) for x in parts]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(np.diff(cuts)[rows]), pa.array(keys, pa.binary()), pa.array([squeezed(counts[x]) for x in parts], pa.binary())], ["bucket", "n", "keys", "counts"])

        for whole in batches:
            for batch in batches_of(whole, BATCH):
                t = Tokens.of(batch.column(0))
                if not len(t.codes):
                    continue
                hashed, size = t.hashes, len(t.words)
                before = np.concatenate([[size - 1], t.codes[:-1]])
                pairs, times = np.unique(before * size + t.codes, return_counts=True)
                seen = np.bincount(t.codes, minlength=size)
                keys = np.concatenate([hashed[seen > 0], bigram(hashed[pairs // size], hashed[pairs % size])])
                held.append((bucket_of(keys, buckets).astype(U) << U(32) | identity(keys), np.concatenate([seen[seen > 0], times])))
                if sum(len(k) for k, _ in held) > MAX_OPEN * 4:
                    yield from out()
        if held:
            yield from out()

    return texts.mapInArrow(tidied(pack), "bucket int, n long, keys binary, counts binary").repartitionById(buckets, "bucket")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mixed(keys) >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def identity(keys: np.ndarray) -> np.ndarray:
    """32 bits that stand for a key within its bucket; two share them far more seldom than a filter's probes err."""
    return mixed(keys) & U(0xFFFFFFFF)


def halves(ids: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """What the places of (identity, level) are made of, for double hashing."""
    h = mixed(ids * U(0x9E3779B97F4A7C15) + U(level * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
    return h & U(0xFFFFFFFF), h >> U(32) | U(1)


def bit_place(a: np.ndarray, b: np.ndarray, i: int, size: np.ndarray) -> np.ndarray:
    return ((a + U(i) * b & U(0xFFFFFFFF)) * size >> U(32)).astype(np.int64)


def segment(ids: np.ndarray, levels: np.ndarray) -> bytes:
    """The bits of one bucket, from identities and levels."""
    size = max(64, int(levels.sum(dtype=np.int64)) * BITS_PER_ENTRY + 7 & ~7)
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        ids, levels = ids[levels >= level], levels[levels >= level]
        a, b = halves(ids, level)
        for i in range(HASHES):
            bits[bit_place(a, b, i, U(size))] = True
    return np.packbits(bits, bitorder="little").tobytes()


def squeezed(values: np.ndarray) -> bytes:
    """32-bit numbers in four planes of bytes, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unsqueezed(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def levels_in(keys: np.ndarray, bits: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The level of each identity, 0 if its first probe fails; ``start`` and ``size`` of its segment in bits."""
    out = np.zeros(len(keys), np.int64)
    at = np.arange(len(keys))
    level = 0
    while len(at):
        level += 1
        a, b = halves(keys, level)
        for i in range(HASHES):
            place = start + bit_place(a, b, i, size)
            hit = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            if len(hit) < len(at):
                at, keys, start, size, a, b = at[hit], keys[hit], start[hit], size[hit], a[hit], b[hit]
        out[at] = level
    return out


class LogBloom:
    """The filter: concatenated segments, one a bucket."""

    def __init__(self, segments: list[bytes]):
        self.bits = np.frombuffer(b"".join(segments), np.uint8)
        self.sizes = np.array([len(s) * 8 for s in segments], np.uint64)
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in segments])[:-1]]).astype(np.int64) * 8

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 if its first probe fails."""
        bucket = bucket_of(keys, len(self.sizes))
        return levels_in(identity(keys), self.bits, self.starts[bucket], self.sizes[bucket])

    def levels_of(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The levels of word and bigram of each token."""
        coded = pa.array(t.keys()[2].view(np.int64)).dictionary_encode()  # each distinct key is probed once
        two = self.levels(coded.dictionary.to_numpy(zero_copy_only=False).view(U))[coded.indices.to_numpy(zero_copy_only=False)]
        return self.levels(t.hashes)[t.codes], two


def segments(runs: DataFrame) -> DataFrame:
    """``bucket, bits``: the segment of each bucket, whose ``runs`` are merged here."""

    def merged(now: list) -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([k for k, _ in now]), np.concatenate([c for _, c in now]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, n, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                now = held.setdefault(bucket, [])
                now.append((np.cumsum(unsqueezed(keys, n), dtype=U), unsqueezed(counts, n).astype(np.int64)))
                if sum(len(k) for k, _ in now) > 1_000_000 + 2 * len(now[0][0]):
                    held[bucket] = [merged(now)]
        while held:
            bucket, now = held.popitem()
            keys, counts = merged(now)
            made = segment(keys, np.searchsorted(THRESHOLDS, counts, "right").astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([made], pa.binary())], ["bucket", "bits"])

    return runs.mapInArrow(tidied(run), "bucket int, bits binary")


def collected(filled: DataFrame, buckets: int) -> LogBloom:
    """The filter of written segments, which the caller has found small enough."""
    made = dict(map(tuple, filled.collect()))
    return LogBloom([made.get(i, bytes(8)) for i in range(buckets)])


@dataclass
class Chunk:
    """A batch's tokens without its words: codes into the words' hashes, the last of which is the end token's."""

    codes: np.ndarray
    hashes: np.ndarray

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Identities of words and distinct bigrams, sorted in each bucket, the buckets' bounds, the order, and the bigram of each token."""
        word = self.hashes[self.codes]
        pairs, which = np.unique(bigram(np.concatenate([self.hashes[-1:], word[:-1]]), word), return_inverse=True)
        keys = np.concatenate([self.hashes, pairs])
        place = bucket_of(keys, buckets).astype(U) << U(32) | identity(keys)
        order = np.argsort(place)
        place = place[order]
        return place & U(0xFFFFFFFF), np.searchsorted(place >> U(32), np.arange(buckets + 1).astype(U)), order, which


def probed(chunks: DataFrame, filled: DataFrame, buckets: int) -> DataFrame:
    """``row, sizes, one, two`` for each row (row, codes, hashes, sizes) of written ``chunks``: the levels of word and bigram of its tokens.

    ``filled`` has the written segments, which are deleted once they have answered; so are the answers. What meets in a task is a segment and the n-grams of one chunk at a time.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, codes, hashes, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                keys, cuts, _, _ = unpacked(codes, hashes, sizes).keys(buckets)
                full = np.flatnonzero(np.diff(cuts))
                blobs = [squeezed(np.diff(keys[cuts[i] : cuts[i + 1]], prepend=U(0))) for i in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([row] * len(full), pa.int64()), pa.array(np.diff(cuts)[full], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "row", "n", "blob"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits, held = None, np.zeros(8, np.uint8), []

        def done():
            # what several chunks ask for is probed once
            distinct, which = np.unique(np.concatenate([k for _, k in held]), return_inverse=True)
            found = levels_in(distinct, bits, np.zeros(len(distinct), np.int64), np.full(len(distinct), len(bits) * 8, U)).astype(np.uint8)[which]
            sizes = [len(k) for _, k in held]
            blobs = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in np.split(found, np.cumsum(sizes)[:-1])]
            rows = [row for row, _ in held]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([now] * len(rows), pa.int32()), pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "row", "n", "blob"])

        for batch in batches:
            for bucket, row, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    if held:
                        yield done()
                    now, bits = bucket, np.zeros(8, np.uint8)
                if row < 0:  # a bucket's segment comes before the chunks
                    bits = np.frombuffer(blob, np.uint8)
                    continue
                held.append((row, np.cumsum(unsqueezed(blob, n), dtype=U)))
                if sum(len(k) for _, k in held) > PROBED:
                    yield done()
        if held:
            yield done()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, levels = None, []

        def done():
            row, *blobs = now
            chunk = unpacked(*blobs)
            codes, hashes = chunk.codes, chunk.hashes
            keys, _, order, which = chunk.keys(buckets)
            found = np.empty(len(keys), np.uint8)
            found[order] = np.frombuffer(b"".join(levels), np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([row]), *(pa.array([x], pa.binary()) for x in (blobs[2], *levelled(found[codes], found[len(hashes) :][which])))], ["row", "sizes", "one", "two"])

        for batch in batches:
            for bucket, row, n, blob, codes, hashes, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket < 0:
                    if now:
                        yield done()
                    now, levels = (row, codes, hashes, sizes), []
                else:
                    levels.append(pa.decompress(blob, n, "zstd", asbytes=True))
        if now:
            yield done()

    none = F.lit(None).cast("binary")
    asked = chunks.select("row", "codes", "hashes", "sizes").mapInArrow(tidied(ask), "bucket int, row long, n long, blob binary")
    asked = asked.unionByName(filled.select("bucket", F.lit(-1).cast("long").alias("row"), F.lit(0).cast("long").alias("n"), F.col("bits").alias("blob")))
    told = written(asked.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "row").mapInArrow(tidied(answer), "bucket int, row long, n long, blob binary"))
    discard(filled)
    tidy(chunks.sparkSession)
    both = told.select("bucket", "row", "n", "blob", none.alias("codes"), none.alias("hashes"), none.alias("sizes"))
    both = both.unionByName(chunks.select(F.lit(-1).alias("bucket"), "row", F.lit(0).cast("long").alias("n"), none.alias("blob"), "codes", "hashes", "sizes"))
    met = written(both.repartition(buckets, "row").sortWithinPartitions("row", "bucket").mapInArrow(tidied(meet), "row long, sizes binary, one binary, two binary"))
    discard(told)
    tidy(chunks.sparkSession)
    return met


def class_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(CLASSES - 1, np.log2(np.maximum(count, 1)) // 2).astype(np.int64)


def base_log10(c: np.ndarray, total: int, distinct: int) -> np.ndarray:
    return np.log10((c + ADD) / (total + ADD * (distinct + 1)))


def mixture(one: np.ndarray, history: np.ndarray, two: np.ndarray, total: int, distinct: int, without: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P1, P2 and class of history for each token from the counts; ``without`` 1 leaves the token's own occurrence out."""
    n1, nh, n2 = (np.maximum(c - without, 0) for c in (one, history, two))
    return (n1 + ADD) / (total - without + ADD * (distinct + 1)), np.minimum(n2 / np.maximum(nh, 1), 1), class_of(nh)


def triples(met: DataFrame) -> DataFrame:
    """``k, n``: the tokens of training texts by the levels of word, history and bigram (a byte each), from all rows of ``met``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["k", "n"])

        for batch in batches:
            for _, sizes, one, history, two in unlevelled(batch):
                mine = np.repeat(sizes[:, 1] > 0, sizes[:, 0])
                k, n = np.unique((one.astype(np.uint32) << 16 | history.astype(np.uint32) << 8 | two)[mine], return_counts=True)
                keys, counts = summed(np.concatenate([keys, k.astype(np.int64)]), np.concatenate([counts, n]))
                if len(keys) > MAX_TRIPLES:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
        yield out()

    return met.mapInArrow(tidied(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def likelihoods(counted: DataFrame, total: int, distinct: int) -> DataFrame:
    """Leave-one-out log likelihood by class of history and weight of GRID: parts of it from counted triples of levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((CLASSES, len(GRID)))
        for batch in batches:
            k, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            one, two, kind = mixture(*(VALUES[k >> shift & 255] for shift in (16, 8, 0)), total, distinct, 1)
            for g, m in enumerate(GRID):
                out[:, g] += np.bincount(kind, n * np.log(m * two + (1 - m) * one), CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), *(pa.array(c) for c in out.T)], ["k", *(f"g{i}" for i in range(len(GRID)))])

    return counted.mapInArrow(tidied(run), LIKELIHOODS)


LIKELIHOODS = "k long, " + ", ".join(f"g{i} double" for i in range(len(GRID)))


def best_weights(sums: DataFrame) -> np.ndarray:
    """The weight of P2 by class of history: the best of GRID by the likelihoods' sums."""
    rows = sums.groupBy("k").agg(*(F.sum(f"g{i}").alias(f"g{i}") for i in range(len(GRID)))).collect()
    out = np.zeros(CLASSES)
    for r in rows:
        out[r.k] = GRID[int(np.argmax(r[1:]))]
    return out


def packed(t: Tokens) -> list[bytes]:
    """Codes and hashes of a chunk."""
    return [squeezed(t.codes), t.hashes.tobytes()]


def sized(t: Tokens, train: np.ndarray) -> bytes:
    """Tokens of each text, and 1 where it is a training text."""
    return np.stack([np.diff(t.starts), train], axis=1).astype(np.int64).tobytes()


def unsized(sizes: bytes) -> np.ndarray:
    return np.frombuffer(sizes, np.int64).reshape(-1, 2)


def unpacked(codes: bytes, hashes: bytes, sizes: bytes) -> Chunk:
    return Chunk(unsqueezed(codes, int(unsized(sizes)[:, 0].sum())).astype(np.int64), np.frombuffer(hashes, U))


def levelled(*levels: np.ndarray) -> list[bytes]:
    return [pa.compress(x.astype(np.uint8).tobytes(), "zstd", asbytes=True) for x in levels]


def unlevelled(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Row, sizes, and the levels of word, history and bigram of each token, for each row (row, sizes, one, two); a chunk ends in an end token."""
    for row, sizes, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
        sizes = unsized(sizes)
        one, two = (np.frombuffer(pa.decompress(x, int(sizes[:, 0].sum()), "zstd", asbytes=True), np.uint8) for x in blobs)
        yield row, sizes, one, np.roll(one, 1), two


def numbered() -> int:
    """The first row number of this task."""
    return TaskContext.get().partitionId() << 40


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_filter_bytes: int = 0) -> DataFrame:
    """One row a document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from all whole training texts, scores all. Null text is empty (one token, the end). Null
    identifiers train. Repeated rows are scored each. With no training text no token is known.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    train = slim.filter(is_training("doc_id"))
    vocab = written(token_counts(slim.select("text", is_training("doc_id").alias("train"))))
    tidy(spark)
    total, distinct, all_tokens = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # tokens by how often they occur at all, as that is how often they are asked for
    steps = vocab.groupBy(F.floor(F.log2("n") * 4).alias("k")).agg(F.count("*").alias("v"), F.min("n").alias("least")).collect()
    room, least = MAX_FREQUENT, 1 << 62
    for r in sorted(steps, key=lambda r: -r.k):
        room -= r.v
        if room < 0:
            break
        least = r.least
    often_seen = vocab.filter(F.col("n") >= least).select("token", "c").toArrow()  # MAX_FREQUENT at most
    tokens = pa.concat_arrays([pa.array([], pa.string()), *(x.cast(pa.string()) for x in often_seen["token"].chunks)])
    frequent = spark.sparkContext.broadcast(Frequent.of(tokens, often_seen["c"].to_numpy()))
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), all_tokens // BUCKET_TOKENS), MAX_BUCKETS)
    filled = written(segments(ngram_runs(train.select("text"), buckets)))
    tidy(spark)
    small = (filled.agg(F.sum(F.length("bits"))).first()[0] or 0) <= max_filter_bytes
    bloom = spark.sparkContext.broadcast(collected(filled, buckets)) if small else None

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sizes, *levels in unlevelled(batch):
                one, two, kind = mixture(*(VALUES[x] for x in levels), total, distinct)
                m, n = weights[kind], sizes[:, 0]
                scores = np.add.reduceat(np.log10(m * two + (1 - m) * one), np.cumsum(n) - n)
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(n))), pa.array(scores)], ["row", "score"])

    blobs = ["one", "two"] if small else ["codes", "hashes"]
    names = ["row", "doc_id", "held_out", "n_tokens", "often", "base", "words", "tf", "sizes", *blobs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = frequent.value, numbered()
        for whole in batches:
            for batch in batches_of(whole, BATCH):
                t = Tokens.of(batch.column(2))
                if not len(t.codes):
                    continue
                starts, n = t.starts[:-1], np.diff(t.starts)
                c = known.counts_of(t.words, t.hashes)
                often = (c >= 0)[t.codes]
                base = np.add.reduceat(np.where(often, base_log10(np.maximum(c, 0), total, distinct)[t.codes], 0.0), starts)
                seen = np.add.reduceat((c > 0)[t.codes].astype(np.int64), starts)
                doc = np.repeat(np.arange(len(n)), n)[~often]
                pair, tf = np.unique(doc * len(t.words) + t.codes[~often], return_counts=True)
                bounds = np.searchsorted(pair // len(t.words), np.arange(len(n) + 1))
                words = t.words.take(pa.array(pair % len(t.words)))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), x) for x in (words, pa.array(tf, pa.int64()))]
                # the first row of a batch carries its tokens
                held_out = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                chunk = [pa.array([x] + [None] * (len(n) - 1), pa.binary()) for x in (sized(t, ~held_out), *(levelled(*bloom.value.levels_of(t)) if small else packed(t)))]
                cols = [pa.array(row + np.arange(len(n))), batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(seen), pa.array(base), *lists, *chunk]
                yield pa.RecordBatch.from_arrays(cols, names)
                row += len(n)

    form = "row long, doc_id long, held_out boolean, n_tokens long, often long, base double, words array<string>, tf array<long>, sizes binary, " + ", ".join(f"{c} binary" for c in blobs)
    first = written(slim.select("doc_id", (~is_training("doc_id")).alias("held_out"), "text").mapInArrow(tidied(run), form))
    rare = first.select("row", F.explode(F.arrays_zip("words", "tf")).alias("x")).select("row", F.col("x.words").alias("token"), F.col("x.tf").alias("tf"))
    met = rare.join(vocab.filter(F.col("n") < least).select("token", "c"), "token", "left")  # no such token has as many rows as ``least``
    here = F.coalesce("c", F.lit(0))
    value = F.log10((here + F.lit(ADD)) / F.lit(total + ADD * (distinct + 1)))
    more = met.groupBy("row").agg(F.sum(F.col("tf") * value).alias("more"), F.sum(F.when(here > 0, F.col("tf")).otherwise(0)).alias("known"))
    chunks = first.filter("sizes is not null")
    if not small:
        chunks = probed(chunks.select("row", "codes", "hashes", "sizes"), filled, buckets)
    chunks = chunks.select("row", "sizes", "one", "two")
    weights = best_weights(likelihoods(triples(chunks), total, distinct))
    out = first.drop("words", "tf", "sizes", *blobs).join(more, "row", "left").join(chunks.mapInArrow(tidied(model), "row long, score double"), "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("often") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
