"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are made distinct first; each then has at most 64 + 2016 others within 2 bits, so the links grow
with the number of fingerprints, whatever the texts. A fingerprint lies in six buckets, one for each choice of
two of its four 16-bit blocks: two fingerprints that differ in at most two bits agree in two blocks. A bucket
with more than ``max_bucket`` fingerprints is divided again by two of four parts of the bits that are still
free, and so on; after the third division a bucket has at most 256.

In a bucket the fingerprints are sorted by Gray rank, which puts codes with common bit patterns side by side.
Runs of them form nodes with a mask of the bits on which all agree, runs of nodes form upper nodes, and a node
keeps only those of its bits that its parent doesn't have. A search starts at the root, adds up the differences
on the masked bits and leaves a node with all below it as soon as the sum exceeds the distance. Of the links
found, a spanning forest is passed on to the distributed components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import batches_of, components, fresh, lookup, texts_of, written
from lexmill.llm.memo import tidied

U = np.uint64
FANOUT = 16
SHINGLES_AT_ONCE = 100_000


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of a text: A-Z lowered, words between ASCII white space, ``width``-word shingles, XXH64 with seed 42.

    A bit is 1 if set in over half of the hashes; fewer words than ``width`` make one shingle, none give zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_digest
    spans = list(zip(starts, starts[width:])) if len(words) >= width else [(0, len(joined) + 1)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(spans), SHINGLES_AT_ONCE):
        data = b"".join([digest(joined[s : e - 1], 42) for s, e in spans[at : at + SHINGLES_AT_ONCE]])
        bits = np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(spans)).tobytes(), "big")


def fingerprints(docs: DataFrame, row: str, doc_id: str, text: str, width: int = 3) -> DataFrame:
    """``row, doc_id, fp`` (the fingerprint's bits as a signed long); null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                found = np.array([fingerprint(t, width) for t in texts_of(batch.column(2))], U).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["row", "doc_id", "fp"])

    slim = docs.select(F.col(f"`{row}`").alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return slim.mapInArrow(tidied(run), "row long, doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> U(shift))
    return codes


class GrayIndex:
    """A forest over codes sorted by (bucket, Gray rank), one tree a bucket."""

    def __init__(self, buckets: np.ndarray, codes: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), buckets))
        self.codes = codes[self.order]
        bucket = buckets[self.order]
        ones, anded = self.codes, self.codes
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # first child, pattern, mask; leaves first
        self.first: list[np.ndarray] = []
        while True:
            edge = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            begin = np.flatnonzero(edge)
            if self.levels and len(begin) == len(bucket):
                break
            within = np.arange(len(bucket)) - np.repeat(begin, np.diff(np.append(begin, len(bucket))))
            first = np.flatnonzero(within % FANOUT == 0)
            ones, anded = np.bitwise_or.reduceat(ones, first), np.bitwise_and.reduceat(anded, first)
            self.levels.append((np.append(first, len(bucket)), anded, ~(ones ^ anded)))
            bucket = bucket[first]
        self.root = bucket  # the top level has one node a bucket
        tree = np.searchsorted(self.root, buckets[self.order])
        self.tree = tree

    def within(self, distance: int, at_once: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (places in the input, first before second in Gray order) of one bucket within ``distance`` bits.

        So many codes search together that about ``at_once`` nodes are open even if nothing can be left out.
        """
        block = max(16, min(4096, at_once // max(1, int(np.bincount(self.tree).max(initial=0)))))
        for at in range(0, len(self.codes), block):
            query = np.arange(at, min(at + block, len(self.codes)))
            node = self.tree[query]
            known = np.zeros(len(query), U)  # the mask already counted
            sums = np.zeros(len(query), np.int64)
            for first, pattern, mask in reversed(self.levels):
                rest = mask[node] & ~known
                sums = sums + np.bitwise_count((self.codes[query] ^ pattern[node]) & rest)
                # nodes wholly before the query are another query's work
                go = sums <= distance
                query, node, sums = query[go], node[go], sums[go]
                known = mask[node]
                n = first[node + 1] - first[node]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                child = np.repeat(first[node], n) + step
                query, sums, known, node = np.repeat(query, n), np.repeat(sums, n), np.repeat(known, n), child
            later = node > query
            query, node, sums, known = query[later], node[later], sums[later], known[later]
            sums = sums + np.bitwise_count((self.codes[query] ^ self.codes[node]) & ~known)
            ok = sums <= distance
            yield self.order[query[ok]], self.order[node[ok]]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member of each of ``n`` items' set, by minima and pointer jumping."""
    label = np.arange(n)
    for a, b in pairs:
        while len(a):
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label[label] != label).any():
                label = label[label]
            keep = label[a] != label[b]
            a, b = a[keep], b[keep]
    return label


def links(batches: Iterator[pa.RecordBatch], distance: int, at_once: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, node) sorted by key; yields (a, b): each node that has links with the root of its set in the bucket."""

    def search(key: np.ndarray, fp: np.ndarray, node: np.ndarray):
        _, place, count = np.unique(key, return_inverse=True, return_counts=True)
        several = count[place] > 1
        key, fp, node = place[several], fp[several], node[several]
        if len(key):
            label = forest(len(key), GrayIndex(key, fp.view(U)).within(distance))
            linked = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], ["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        n += batch.num_rows
        if n >= at_once:
            key, fp, node = (np.concatenate(c) for c in zip(*held))
            cut = np.searchsorted(key, key[-1])  # the last bucket may go on
            if cut:
                yield from search(key[:cut], fp[:cut], node[:cut])
                held, n = [(key[cut:], fp[cut:], node[cut:])], len(key) - cut
            else:
                held = [(key, fp, node)]
    if held:
        yield from search(*(np.concatenate(c) for c in zip(*held)))


def _bits(code: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(code, at).bitwiseAND((1 << width) - 1)


def _keys(code: Column, parent: Column, level: int, start: list[int], width: int) -> Column:
    """An array with a key for each choice of two of four blocks: hashes of the parent's key, the choice and the bits."""
    return F.array(*(F.xxhash64(parent, F.lit(level * 8 + c), _bits(code, start[i], width), _bits(code, start[j], width)) for c, (i, j) in enumerate(combinations(range(4), 2))))


def near_links(distinct: DataFrame, distance: int = 2, max_bucket: int = 20_000) -> DataFrame:
    """Edges (a, b) of nodes whose fingerprints differ in at most ``distance`` bits; ``distinct`` has fp and node.

    The edges span what is linked: not every link is among them, but every linked pair is connected.
    """
    if distance > 2:
        raise ValueError("the buckets are made for at most 2 differing bits")
    spark = distinct.sparkSession
    keys = _keys(F.col("fp"), F.lit(0), 0, [0, 16, 32, 48], 16)
    now = distinct.select("fp", "node", F.posexplode(keys).alias("choice", "key"))
    out = None
    pairs = list(combinations(range(4), 2))
    # blocks of free bits after each choice, as starts; only the first division's choice is needed below
    for level in range(3):
        cold = now
        if level < 2:
            sizes = now.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > max_bucket).select("key")
            hot = written(sizes)
            if hot.isEmpty():
                hot = None
            else:
                now = written(now)
                cold = now.join(hot, "key", "left_anti")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = cold.select("key", "fp", "node").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda it: links(it, distance), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if level == 2 or hot is None:
            break
        width = 8 if level == 0 else 4
        free = F.lit(None)
        if level == 0:  # two of four 16-bit blocks are fixed; the other two give four 8-bit parts
            for c, (i, j) in enumerate(pairs):
                rest = [b for b in range(4) if b not in (i, j)]
                starts = [16 * rest[0], 16 * rest[0] + 8, 16 * rest[1], 16 * rest[1] + 8]
                free = F.when(F.col("choice") == c, _keys(F.col("fp"), F.col("key"), 1, starts, width)).otherwise(free)
            trail = (F.col("choice") * 6).alias("first")
        else:  # 48 bits are fixed; the two free 8-bit parts give four 4-bit parts
            for c, (i, j) in enumerate(pairs):
                rest = [b for b in range(4) if b not in (i, j)]
                starts8 = [16 * rest[0], 16 * rest[0] + 8, 16 * rest[1], 16 * rest[1] + 8]
                for c2, (i2, j2) in enumerate(pairs):
                    left = [starts8[b] for b in range(4) if b not in (i2, j2)]
                    starts = [left[0], left[0] + 4, left[1], left[1] + 4]
                    free = F.when(F.col("choice") == c * 6 + c2, _keys(F.col("fp"), F.col("key"), 2, starts, width)).otherwise(free)
            trail = F.lit(0).alias("first")
        again = now.join(hot, "key", "left_semi").select("fp", "node", trail, F.posexplode(free).alias("then", "key"))
        now = again.select("fp", "node", (F.col("first") + F.col("then")).alias("choice"), "key")
    return out


def grouped(docs: DataFrame, row: str, doc_id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """One row a document: ``row, doc_id, fingerprint, component_id, component_row``.

    ``component_id``: the smallest identifier that links reach, itself included (null only if all are null);
    ``component_row`` the smallest row number. Texts without words have fingerprint zero and link like any other.
    """
    rows = written(fingerprints(docs, row, doc_id, text, width))
    distinct = written(rows.groupBy("fp").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    found = components(near_links(distinct.select("fp", "node"), distance))
    placed = written(distinct.join(found, "node", "left").select("fp", "node", "least", "copies", F.coalesce("component", "node").alias("component")))
    whole = written(placed.groupBy("component").agg(F.min("least").alias("component_id"), F.min("node").alias("component_row"), F.count("*").alias("members")))
    known = written(lookup(placed, whole, ["component"], "members", placed.count()).select("fp", "component_id", "component_row", "copies"))
    out = lookup(rows, known, ["fp"], "copies", rows.count())
    return out.select("row", "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_row")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """``docs`` with one row of each component left (smallest identifier, then smallest row number), columns as they were."""
    row = fresh(docs, "_row")
    tagged = written(docs.withColumn(row, F.monotonically_increasing_id()))
    marks = grouped(tagged, row, doc_id, text, width, distance)
    # several rows may share the smallest identifier: the first of them stays
    first = marks.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_row").agg(F.min("row").alias(row))
    return tagged.join(first.select(row), row, "left_semi").drop(row)
