"""Near copies by the similarity of their word shingles: MinHash candidates and exact Jaccard verification.

A document has ``BANDS`` x ``ROWS`` minima over the hashes of its ``width``-word shingles; documents that agree on
all minima of a band share a bucket. There each is first compared with the bucket's smallest row. What is
linked then is one component, and all pairs of a bucket that lie in different components follow, so a bucket of
like documents costs one comparison a member and no pair is left out. Large buckets are compared in blocks that
give links only, so what leaves a task doesn't grow with the square of a group. Every link is verified by the exact
Jaccard similarity of the shingles. A pair at a similarity of 0.8 shares a bucket with a probability of 0.998.

Documents whose SimHash fingerprints differ in at most ``distance`` bits are linked as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import batches_of, components, fresh, numbered, texts_of, tidy, without, written
from lexmill.llm.memo import tidied
from lexmill.llm.simhash import fingerprints, near_links

BANDS, ROWS = 16, 5
SIMILARITY = 0.8
AT_ONCE = 4096
#: A bucket with at least so many comparisons left is compared in blocks of so many rows or bytes.
WORK, BLOCK, BLOCK_BYTES = 64, 512, 1 << 20
#: Rows are marked by a broadcast of at most so many 8-byte ids, else by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
U = np.uint64
_RNG = np.random.default_rng(20240817)
TIMES = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
PLUS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Distinct hashes of the shingles of a text, A-Z lowered; fewer words than ``width`` make one, none give none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, U)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + width])) for i in range(max(1, len(words) - width + 1))], U))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, of a text with shingles."""
    h = (hashes ^ hashes >> U(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), AT_ONCE):
        x = h[None, at : at + AT_ONCE] * TIMES[:, None] + PLUS[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, x.min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(m.tobytes(), b) for b, m in enumerate(least.reshape(BANDS, ROWS))], U).view(np.int64)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / max(1, len(x) + len(y) - common)


def bands(docs: DataFrame, row: str, text: str, width: int) -> DataFrame:
    """``key, row``: a row for each band of each text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                found = [(r, band_keys(h)) for r, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))) if len(h := shingle_hashes(t, width))]
                keys = np.concatenate([k for _, k in found]) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(np.array([r for r, _ in found], np.int64), BANDS))], ["key", "row"])

    return docs.select(F.col(f"`{row}`").alias("row"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(tidied(run), "key long, row long")


def short(ids: DataFrame) -> DataFrame:
    """Written ids, broadcast in joins if they are few."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) of rows that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                one, two = (texts_of(batch.column(i)) for i in (2, 3))
                ok, last = [], (None, None)
                for s, t in zip(one, two):
                    if s != last[0]:
                        last = s, shingle_hashes(s, width)
                    ok.append(similarity(last[1], shingle_hashes(t, width)) >= least)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    pairs = written(pairs)
    wanted = short(written(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()))
    # texts go by shuffle at any size, as they do where they are many
    texts = texts.join(wanted, "row", "left_semi").hint("merge")
    a, b = (texts.select(F.col("row").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(tidied(run), "a long, b long")


def similar_links(docs: DataFrame, row: str, text: str = "text", width: int = 5, least: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) of rows that span all pairs with a common bucket and a similarity of ``least`` or more; ``docs`` is written."""
    texts = docs.select(F.col(f"`{row}`").alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    keyed = written(bands(docs, row, text, width))
    heads = keyed.groupBy("key").agg(F.min("row").alias("head"), F.count("*").alias("n")).filter("n > 1")
    held = written(keyed.join(heads, "key"))
    tidy(docs.sparkSession)
    first = written(verified(held.filter("row <> head").select(F.col("head").alias("a"), F.col("row").alias("b")).distinct(), texts, width, least))
    tidy(docs.sparkSession)
    # what is linked already needs no further pair: rows outside the head's component meet all of other components
    linked = components(first)
    named = held.filter("n > 2").join(linked.withColumnRenamed("node", "row"), "row", "left").join(linked.select(F.col("node").alias("head"), F.col("component").alias("main")), "head", "left")
    named = written(named.filter("row <> head").select("key", "row", F.coalesce("component", "row").alias("component"), F.coalesce("main", "head").alias("main")).withColumn("outer", (F.col("component") != F.col("main")).cast("long")))
    sizes = named.join(texts.select("row", F.octet_length("text").alias("size")), "row").groupBy("key").agg(F.sum("outer").alias("n_outer"), F.count("*").alias("n"), F.sum("size").alias("bytes")).filter("n_outer > 0 and n > 1")
    open_ = written(named.drop("main").join(sizes, "key"))
    tidy(docs.sparkSession)
    small = open_.filter(F.col("n_outer") * F.col("n") < WORK)
    x, y = small.filter("outer = 1").alias("x"), small.alias("y")
    differ = (F.col("x.component") != F.col("y.component")) & ((F.col("y.outer") == 0) | (F.col("x.row") < F.col("y.row")))
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & differ).select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct()
    more = written(verified(rest, texts, width, least))
    tidy(docs.sparkSession)
    blocks = written(block_links(open_.filter(F.col("n_outer") * F.col("n") >= WORK), texts, width, least))
    tidy(docs.sparkSession)
    return first.unionByName(more).unionByName(blocks)


def block_links(rows: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Links (a, b) in large buckets: blocks of outer rows meet blocks of the bucket, a task each, and only links leave it."""

    def links(group: pa.Table) -> pa.Table:
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        names, component, outer, guest = (group[c].to_pylist() for c in ("row", "component", "outer", "guest"))
        all_ = [k for k, g in enumerate(guest) if not g]
        near = [k for k, g in enumerate(guest) if g] if i != j else [k for k in all_ if outer[k]]
        sets = [set(shingle_hashes(t, width).tolist()) for t in texts_of(group["text"].combine_chunks())] if near and all_ else []
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                c = up
            return c

        found = []
        for p in near:
            for q in all_:
                one, two = find(component[p]), find(component[q])
                if one == two or min(len(sets[p]), len(sets[q])) < least * max(len(sets[p]), len(sets[q])):
                    continue
                common = len(sets[p] & sets[q])
                if common >= least * (len(sets[p]) + len(sets[q]) - common):
                    root[max(one, two)] = min(one, two)
                    found.append((names[p], names[q]))
        return pa.table({"a": pa.array([min(f) for f in found], pa.int64()), "b": pa.array([max(f) for f in found], pa.int64())})

    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    large = rows.join(texts.hint("merge"), "row").select("key", "row", "component", "outer", "text", blocks.alias("blocks"), F.pmod(F.xxhash64("row"), blocks).cast("int").alias("own"))
    every = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = ["row", "component", "outer", "text"]
    guests = every.filter("outer = 1 and other <> own").select("key", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("guest"), *rest)
    own = every.select("key", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("guest"), *rest)
    return guests.unionByName(own).groupBy("key", "i", "j").applyInArrow(links, "a long, b long")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, least: float = SIMILARITY, distance: int = 2) -> DataFrame:
    """``docs`` with one row of each component left (smallest identifier, then smallest row number), columns as they were."""
    row = fresh(docs, "_row")
    tagged = numbered(docs, row)
    prints = written(fingerprints(tagged, row, doc_id, text, width))
    distinct = written(prints.groupBy("fp").agg(F.min("row").alias("node"), F.count("*").alias("copies")))
    edges = near_links(distinct.select("fp", "node"), distance).unionByName(similar_links(tagged, row, text, width, least))
    equal = prints.join(distinct.filter("copies > 1"), "fp").filter("row <> node").select(F.col("row").alias("a"), F.col("node").alias("b"))
    found = components(edges.unionByName(equal))
    # without a component a row stays; in one the smallest identifier does, null last
    placed = written(found.join(prints, found["node"] == prints["row"]).select("component", "row", "doc_id"))
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x")).select("component", F.col("x.row").alias("row"))
    return without(tagged, placed.join(first, ["component", "row"], "left_anti").select("row"), row)
