"""Fuzzy line dedup by MinHash: signatures and verification in Arrow batches, all else DataFrame operations.

A line is compared in lower case without outer blanks. Its signature has ``BANDS`` x ``ROWS`` minima over the hashes of all
its ``CHARS``-character shingles (of a shorter line the line itself). Minimum i is that of the hashes after an exclusive
or with a constant i; the constants lie in different parts of the range, so that few hashes are the least of several.
Lines that agree on a band share a bucket.

1. In each band's bucket a line is paired with one head, another one in each band, so these pairs grow with the lines.
2. What is linked then is one component. In buckets that hold several, every line outside the head's component is paired
   with all lines of other components. In small buckets that is a join. One with ``WORK`` comparisons or more is cut in
   blocks of ``BLOCK`` lines; a task compares two of them and gives links only, so what leaves it doesn't grow with the
   square of a group. That holds for a bucket of any size: no pair of it is left out, large ones have larger blocks.

A sketch of the signature (four bits a minimum) comes first, so that only plausible pairs are verified. That is done by the exact Jaccard similarity of all shingles. Linked lines go to the distributed components; the first
line of each (smallest row, then line number) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import batches_of, components, discard, fresh, lookup, tidy, written
from lexmill.llm.memo import release

BANDS, ROWS, CHARS = 8, 4, 5
SIMILARITY = 0.8
#: Sketches of lines at SIMILARITY differ in 6 of 32 parts on average, in more than this in one of a hundred.
APART = 11
#: A bucket with at least so many comparisons left is compared in blocks of so many lines or characters.
WORK, BLOCK, BLOCK_CHARS = 1 << 12, 2048, 1 << 20
#: With over CROWD outer lines blocks are larger, as each line goes to every block of its bucket.
CROWD, LARGER = 4096, 2
#: Candidates' texts are marked by a broadcast of at most so many keys of 8 bytes, else by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
AT_ONCE = 1 << 16  # characters hashed together, so that working arrays stay in a core's cache
BATCH = 4 << 20  # bytes of text worked on together
CODE_BITS = 40  # of a shingle's number
SHINGLES_AT_ONCE, MARKS_AT_ONCE = 1 << 15, 1 << 17  # of pairs compared together
MARKS, PAIRS_AT_ONCE = 1 << 11, 1 << 11  # bits by a line's shingles, pairs whose bits are compared together
U = np.uint64
_RNG = np.random.default_rng(20230711)
#: Column b * ROWS + r lies in part r * BANDS + b of the range.
TURNS = ((np.arange(BANDS * ROWS) % ROWS * BANDS + np.arange(BANDS * ROWS) // ROWS) * ((1 << 32) // (BANDS * ROWS)) + _RNG.integers(0, (1 << 32) // (BANDS * ROWS), BANDS * ROWS)).astype(np.uint32)
#: A band's heads are the smallest numbers after an exclusive or with its constant.
HEADS = [0x9E3779B97F4A7C15 * (b + 1) & (1 << 63) - 1 for b in range(BANDS)]
KEYS, SKETCH = [f"k{b}" for b in range(BANDS)], ["s1", "s2"]
COLUMNS = [*KEYS, *SKETCH, "size"]
LINE = ["id", "probe"]
LOWER = bytes(range(256)).decode("latin-1").lower().encode("latin-1")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(32)) * U(0xD6E8FEB86659FD93)
    x = (x ^ x >> U(32)) * U(0xD6E8FEB86659FD93)
    return x ^ x >> U(32)


def shingle_hashes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of each piece, one after the other, and where each piece's begin."""
    gap = "\n" * (CHARS - 1)  # a line has none itself; what a short one reads of it tells nothing
    data = np.frombuffer((gap.join(pieces) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = data[: len(data) - CHARS + 1].copy()
    for j in range(1, CHARS):
        h *= np.uint32(0x9E3779B1)
        h += data[j : len(data) - CHARS + 1 + j]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    full = np.maximum(sizes - CHARS + 1, 1)
    begins = np.concatenate([[0], np.cumsum(sizes + CHARS - 1)[:-1]])
    edge = np.zeros(len(h) + 1, np.int8)
    edge[begins] += 1
    edge[begins + full] -= 1
    h = h[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    for times, by in ((0x85EBCA6B, 16), (0xC2B2AE35, 13)):
        h ^= h >> np.uint32(by)
        h *= np.uint32(times)
    return h ^ h >> np.uint32(16), np.concatenate([[0], np.cumsum(full)[:-1]])


def signatures(texts: list[str]) -> np.ndarray:
    """The minima of each line (lines x BANDS * ROWS); a very long line is read in pieces."""
    out = np.full((len(texts), BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    short = sizes <= AT_ONCE
    cuts = np.flatnonzero(np.diff(np.cumsum(np.where(short, sizes, 0)) // AT_ONCE)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
        at = np.flatnonzero(short[i:j]) + i
        if len(at):
            out[at] = minima(texts[i:j] if len(at) == j - i else [texts[k] for k in at.tolist()])
    for k in np.flatnonzero(~short).tolist():
        for i in range(0, len(texts[k]) - CHARS + 1, AT_ONCE):
            np.minimum(out[k], minima([texts[k][i : i + AT_ONCE + CHARS - 1]])[0], out=out[k])
    return out


def minima(pieces: list[str]) -> np.ndarray:
    """The minima of each piece."""
    h, starts = shingle_hashes(pieces)
    out, turned = np.empty((BANDS * ROWS, len(pieces)), np.uint32), np.empty_like(h)
    for i, turn in enumerate(TURNS):
        np.minimum.reduceat(np.bitwise_xor(h, turn, out=turned), starts, out=out[i])
    return out.T


def packed(minima: np.ndarray) -> list[np.ndarray]:
    """Columns of KEYS (a key a band) and SKETCH (four bits a minimum)."""
    wide = minima.astype(U)
    out = []
    for b in range(BANDS):
        m = wide[:, b * ROWS : (b + 1) * ROWS]
        out.append(mixed(mixed(m[:, 0] << U(32) | m[:, 1]) + mixed(m[:, 2] << U(32) | m[:, 3]) * U(3) + U(b)))
    half = BANDS * ROWS // 2
    for side in (wide[:, :half], wide[:, half:]):
        out.append(np.bitwise_or.reduce((side >> U(7) & U(15)) << (U(4) * np.arange(half, dtype=U)), axis=1))
    return [c.view(np.int64) for c in out]


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each line; lines are equal if both are."""
    try:
        digests = b"".join(map(xxhash.xxh3_128_digest, texts))
    except UnicodeEncodeError:
        digests = b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts)
    found = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def lowered(text: str) -> str:
    """``text.lower()``; for a text of Latin-1 by a table of bytes."""
    if text.isascii():
        return text.lower()
    try:
        return text.encode("latin-1").translate(LOWER).decode("latin-1")
    except UnicodeEncodeError:
        return text.lower()


def visible(text: str | None) -> list[str]:
    """The lines of a text in the form that is compared; an empty one has no visible character. Null has none."""
    # the end of a line ends a word, so lower case of the whole is that of its lines
    return [x.strip(" \t\r") for x in lowered(text).split("\n")] if text is not None else []


def first_pass(docs: DataFrame, row: str, text: str, carry: str | None) -> DataFrame:
    """Two kinds of rows: ``row, carried, line_no, id, probe`` of each place of a line, and ``id, probe, copies`` with the columns
    of :func:`packed` of each line (repeated between batches). Each document has a place at least: one without an id if its first line has no visible character.
    """
    names = ["row", "carried", "line_no", *LINE, "copies", *COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for batch in batches_of(whole, BATCH):
                number: dict[str, int] = {}
                doc, line_no, code = [], [], []
                for d, t in enumerate(batch.column(2).to_pylist()):
                    found = visible(t)
                    if not found or not found[0]:
                        doc.append(d), line_no.append(0), code.append(-1)
                    at = [i for i, x in enumerate(found) if x]
                    doc.extend([d] * len(at)), line_no.extend(at), code.extend([number.setdefault(x, len(number)) for x in found if x])
                texts = list(number)
                one, two = keys_of(texts) if texts else (np.zeros(0, np.int64),) * 2
                codes = np.array(code, np.int64)
                none = codes < 0
                here = [batch.column(c).take(pa.array(doc, pa.int64())) for c in (0, 1)]
                ids = [pa.array(c[codes] if len(c) else np.zeros(len(codes), np.int64), mask=none) for c in (one, two)]
                cols = [*here, pa.array(line_no, pa.int32()), *ids]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.nulls(len(codes), pa.int64())] * (len(names) - len(cols))], names)
                if texts:
                    n = len(texts)
                    cols = [pa.array(one), pa.array(two), pa.array(np.bincount(codes[~none], minlength=n)), *map(pa.array, packed(signatures(texts))), pa.array([len(x) for x in texts], pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), *cols], names)

    form = "row long, carried long, line_no int, " + ", ".join(f"{c} long" for c in names[3:])
    kept = F.lit(None).cast("long") if carry is None else F.col(f"`{carry}`").cast("long")
    return docs.select(F.col(f"`{row}`").alias("row"), kept.alias("carried"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, form)


def line_texts(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """``node, line`` for the wanted lines (node, id, probe): another pass over the texts; ``wanted`` is written."""
    known = None
    if wanted.count() <= MAX_BROADCAST_IDS:
        known = docs.sparkSession.sparkContext.broadcast(np.unique(np.array([r.id for r in wanted.select("id").collect()], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for batch in batches_of(whole, BATCH):
                texts = list({x for t in batch.column(0).to_pylist() for x in visible(t) if x})
                if not texts:
                    continue
                one, two = keys_of(texts)
                some = np.arange(len(texts))
                if known is not None:
                    have = known.value
                    at = np.minimum(np.searchsorted(have, one), max(0, len(have) - 1))
                    some = np.flatnonzero(have[at] == one) if len(have) else some[:0]
                yield pa.RecordBatch.from_arrays([pa.array(one[some]), pa.array(two[some]), pa.array([texts[i] for i in some], pa.string())], [*LINE, "line"])

    found = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "id long, probe long, line string")
    return found.join(F.broadcast(wanted) if known is not None else wanted, LINE).select("node", "line")


def bands(signed: DataFrame) -> DataFrame:
    """``band, key, node``: a row for each band of each line."""
    return signed.select("node", F.posexplode(F.array(*KEYS)).alias("band", "key"))


def apart(one: Column, two: Column) -> Column:
    """In how many parts of four bits two numbers differ."""
    x = one.bitwiseXOR(two)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseAND(0x1111111111111111))


def close(a: str, b: str, most: int = APART) -> Column:
    return apart(F.col(f"{a}.s1"), F.col(f"{b}.s1")) + apart(F.col(f"{a}.s2"), F.col(f"{b}.s2")) <= most


def held_lines(signed: DataFrame) -> DataFrame:
    """``key, node, head, n`` for each line of each bucket with other lines, written; ``signed`` is written."""
    keyed = bands(signed)
    turn = F.element_at(F.array(*map(F.lit, HEADS)), F.col("band") + 1)
    heads = written(keyed.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(turn)).alias("head"), F.count("*").alias("n")).filter("n > 1"))
    tidy(signed.sparkSession)
    found = lookup(keyed, heads, ["key"], "n", signed.count() * BANDS, hashed=True).filter("n is not null")
    held = written(found.select("key", "node", F.col("head").bitwiseXOR(turn).alias("head"), "n"))
    discard(heads)
    return held


def pair(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def plausible(pairs: DataFrame, some: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches are close."""
    both = pairs.join(some.select(F.col("node").alias("a"), "s1", "s2").alias("x"), "a").join(some.select(F.col("node").alias("b"), "s1", "s2").alias("y"), "b")
    return both.filter(close("x", "y")).select("a", "b")


def numbered_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A number of so many bits (CODE_BITS at most) for each character's shingle, where each line's begin, and how many it has (with repeats).

    A line shorter than a shingle is one itself. Numbers are exact: equal ones stand for equal shingles.
    """
    gap = "\n" * (CHARS - 1)
    joined = gap.join(texts) + gap
    try:  # a byte a character
        data = joined.encode("latin-1") + bytes(16)
        codes = np.empty(len(joined) + 8, np.int64)
        for i in range(8):
            part = np.frombuffer(data, "<i8", (len(data) - i) // 8, i)
            codes[i::8] = part[: len(codes[i::8])]
        codes &= (1 << 8 * CHARS) - 1
        bits = 8 * CHARS
    except UnicodeEncodeError:
        data = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(int(data.max()) + 1, bool)
        seen[data] = True
        data, letters = (np.cumsum(seen) - 1)[data], int(seen.sum())
        size = len(data) - CHARS + 1
        codes, span = data[:size].copy(), letters
        for j in range(1, CHARS):
            codes *= letters
            codes += data[j : size + j]
            span *= letters
            if span > 1 << CODE_BITS:
                known, codes = np.unique(codes, return_inverse=True)
                span = len(known)
        bits = span.bit_length()
    chars = np.fromiter(map(len, texts), np.int64, len(texts))
    return codes, np.cumsum(chars + CHARS - 1) - (chars + CHARS - 1), np.maximum(chars - CHARS + 1, 1), bits


def shingle_marks(codes: np.ndarray, begins: np.ndarray, full: np.ndarray) -> np.ndarray:
    """MARKS bits a line, of which its shingles set one each by their number."""
    out = np.zeros((len(full), MARKS), bool)
    wide = np.diff(begins, append=begins[-1] + full[-1])
    place = codes[: begins[-1] + full[-1]].view(U) * U(0x9E3779B97F4A7C15)
    place >>= U(64 - MARKS.bit_length() + 1)
    place[stretches(begins + full, wide - full)] = np.repeat(place[begins], wide - full)  # what reads a line's end
    out.reshape(-1)[np.repeat(np.arange(len(full)) * MARKS, wide) + place.view(np.int64)] = True
    return np.packbits(out, axis=1).view(U)


def may_be_alike(one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether pairs of marks of lines with at most a and b shingles allow a similarity of ``least``: a bit that only one has is a shingle that only one has."""
    left, right = (np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64) for x, y in ((one, two), (two, one)))
    most = np.minimum(a - left, b - right)
    return most >= least * (most + left + right) - 1e-6


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of stretches that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def alike(texts: list[str], one: np.ndarray, two: np.ndarray, least: float) -> np.ndarray:
    """For each pair of places in ``texts`` whether the Jaccard similarity of all shingles is at least ``least``."""
    out = np.zeros(len(one), bool)
    if not len(one):
        return out
    codes, begins, full, bits = numbered_shingles(texts)
    open_ = [np.zeros(0, np.int64)]
    marks = shingle_marks(codes, begins, full)
    for at in range(0, len(one), PAIRS_AT_ONCE):
        x, y = one[at : at + PAIRS_AT_ONCE], two[at : at + PAIRS_AT_ONCE]
        open_.append(np.flatnonzero(may_be_alike(marks[x], marks[y], full[x], full[y], least)) + at)
    open_ = np.concatenate(open_)
    part = np.cumsum((full[one] + full[two])[open_]) // SHINGLES_AT_ONCE
    for some in np.split(open_, np.flatnonzero(np.diff(part)) + 1):
        # a pair's shingles in order, those of its second line odd
        sides = [np.repeat(np.arange(len(some)) << bits + 1 | odd, full[x]) | codes[stretches(begins[x], full[x])] << 1 for odd, x in enumerate((one[some], two[some]))]
        both = np.sort(np.concatenate(sides))
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        pair_of = both >> bits + 1
        shared = np.bincount(pair_of[1:][both[1:] ^ 1 == both[:-1]], minlength=len(some))
        out[some] = shared >= least * (np.bincount(pair_of, minlength=len(some)) - shared)
    return out


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) with a Jaccard similarity of all shingles of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for batch in batches_of(whole, BATCH // 4):
                number: dict[str, int] = {}
                one, two = ([number.setdefault(x, len(number)) for x in batch.column(c).to_pylist()] for c in (2, 3))
                ok = pa.array(alike(list(number), np.array(one, np.int64), np.array(two, np.int64), least))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in (0, 1)], ["a", "b"])

    a, b = (texts.select(F.col("node").alias(c), F.col("line").alias(f"line_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "line_a", "line_b").mapInArrow(run, "a long, b long")


def open_rows(held: DataFrame, linked: DataFrame, some: DataFrame) -> DataFrame:
    """``key, node, component, outer, size, s1, s2`` of buckets with several components; ``outer`` is 1 outside the head's. Written, with
    ``n_outer, n, chars`` of the bucket."""
    member = linked.select("node", "component")
    rows = held.filter("n > 2").join(member, "node", "left").join(member.select(F.col("node").alias("head"), F.col("component").alias("head_component")), "head", "left")
    rows = rows.select("key", "node", F.coalesce("component", "node").alias("component"), F.coalesce("head_component", "head").alias("main")).withColumn("outer", (F.col("component") != F.col("main")).cast("long"))
    rows = written(rows.drop("main").join(some.select("node", "size", *SKETCH), "node"))
    sizes = written(rows.groupBy("key").agg(F.sum("outer").alias("n_outer"), F.count("*").alias("n"), F.sum("size").alias("chars")).filter("n_outer > 0 and n > 1"))
    both = written(rows.join(sizes, "key"))
    discard(rows, sizes)
    return both


def few_pairs(rows: DataFrame) -> DataFrame:
    """Plausible pairs (a, b) of different components in buckets with under WORK comparisons, so at most about 2 * sqrt(WORK) a line."""
    small = rows.filter(F.col("n_outer") * F.col("n") < WORK)
    x, y = small.filter("outer = 1").alias("x"), small.alias("y")
    differ = (F.col("x.component") != F.col("y.component")) & ((F.col("y.outer") == 0) | (F.col("x.node") < F.col("y.node")))
    return x.join(y, (F.col("x.key") == F.col("y.key")) & differ & close("x", "y")).select(*pair(F.col("x.node"), F.col("y.node"))).distinct()


def near_marks(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of sketches (rows of two numbers) that differ in at most APART parts, in order."""
    found = [(np.zeros(0, np.int64),) * 2]
    step = max(1, MARKS_AT_ONCE // max(1, len(two)))
    for at in range(0, len(one), step):
        differ = np.zeros((len(one[at : at + step]), len(two)), np.uint8)
        for c in range(2):
            x = one[at : at + step, c, None] ^ two[None, :, c]
            x |= x >> U(1)
            x |= x >> U(2)
            x &= U(0x1111111111111111)
            differ += np.bitwise_count(x)
        i, j = np.nonzero(differ <= APART)
        found.append((i + at, j))
    return tuple(np.concatenate(x) for x in zip(*found))


def links_in(group: pa.Table, least: float) -> pa.Table:
    """Links (a, b) that span what is similar between outer lines and all lines of a block."""
    node, part, outer, i, j, guest = (group.column(c).to_numpy() for c in ("node", "component", "outer", "i", "j", "guest"))
    all_ = np.flatnonzero(~guest)
    # outer lines of the block itself, or those of another block, which come as guests
    near = np.flatnonzero(guest) if guest.any() else np.flatnonzero((outer == 1) & (i == j))
    marks = np.stack([group.column(c).to_numpy() for c in SKETCH], axis=1).view(U)
    one, two = near_marks(marks[near], marks[all_])
    one, two = near[one], all_[two]
    differ = part[one] != part[two]
    one, two = one[differ], two[differ]
    known, part = np.unique(part, return_inverse=True)
    root = np.arange(len(known))  # of each component the least that it is linked to

    def find(c: int) -> int:
        while (up := root[c]) != c:
            root[c] = c = root[up]
        return c

    found, most = [], 1
    while len(one):
        # of a line and a component one pair, then four times as many: what is linked then needs no other
        other = root[part[two]]
        order = np.lexsort((other, one))
        first = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (other[order][1:] != other[order][:-1])])
        starts = np.flatnonzero(first)
        now = order[np.arange(len(order)) - starts[np.cumsum(first) - 1] < most]
        most *= 4
        used, at = np.unique(np.concatenate([one[now], two[now]]), return_inverse=True)
        ok = alike(group.column("line").take(pa.array(used)).to_pylist(), at[: len(now)], at[len(now) :], least)
        for x, y in zip(one[now[ok]].tolist(), two[now[ok]].tolist()):
            a, b = find(part[x]), find(part[y])
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((node[x], node[y]))
        while (root != root[root]).any():
            root = root[root]
        left = root[part[one]] != root[part[two]]
        left[now] = False
        one, two = one[left], two[left]
    return pa.table({"a": pa.array([max(p) for p in found], pa.int64()), "b": pa.array([min(p) for p in found], pa.int64())})


def many_links(rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Verified links (a, b) of the other buckets: each group of outer lines meets each block of the bucket, and only links leave that task."""
    large = rows.filter(F.col("n_outer") * F.col("n") >= WORK).join(texts, "node")
    parts = F.greatest(F.col("n") / BLOCK, F.col("chars") / BLOCK_CHARS)
    blocks = F.ceil(F.when(F.col("n_outer") > CROWD, parts / LARGER).otherwise(parts)).cast("int")
    large = large.select("key", "node", "component", "outer", *SKETCH, "line", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"))
    every = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = ["outer", "node", "component", *SKETCH, "line"]
    near = every.filter("outer = 1 and other <> own").select("key", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("guest"), *rest)
    # two outer lines of different blocks meet in the group whose first block is the lower one
    all_ = every.filter("outer = 0 or other <= own").select("key", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("guest"), *rest)
    return near.unionByName(all_).groupBy("key", "i", "j").applyInArrow(lambda group: links_in(group, least), "a long, b long")


def judged(docs: DataFrame, row: str, text: str = "text", least: float = SIMILARITY, carry: str | None = None) -> DataFrame:
    """``row, carried, line_no, component, kept`` of each line, and of each first line, visible or not.

    ``kept`` is null where no character is visible, ``component`` where the line has no copies. ``carried`` is a number of the document. The
    text is read three times, row numbers once.
    """
    passed = written(first_pass(docs, row, text, carry))
    signed = passed.filter("line_no is null").groupBy(*LINE, *COLUMNS).agg(F.sum("copies").alias("copies"))
    signed = written(signed.withColumn("node", F.monotonically_increasing_id()))
    tidy(docs.sparkSession)
    table = written(passed.filter("line_no is not null").select("row", "carried", "line_no", *LINE))
    discard(passed)
    tidy(docs.sparkSession)
    held = held_lines(signed)
    tidy(docs.sparkSession)
    some = written(signed.select("node", *LINE, *SKETCH, "size"))
    named = written(signed.select("node", *LINE, "copies"))
    discard(signed)
    names = some.select("node", *LINE)
    tidy(docs.sparkSession)
    first = written(plausible(held.filter("node <> head").select(*pair(F.col("node"), F.col("head"))), some).distinct())
    tidy(docs.sparkSession)
    texts = written(line_texts(docs, text, written(nodes(first).join(names, "node"))).dropDuplicates(["node"]))
    tidy(docs.sparkSession)
    edges = written(verified(first, texts, least))
    tidy(docs.sparkSession)
    rows = open_rows(held, components(edges), some)
    discard(held)
    tidy(docs.sparkSession)
    rest = written(few_pairs(rows).join(first, ["a", "b"], "left_anti"))
    wanted = nodes(rest).union(rows.filter(F.col("n_outer") * F.col("n") >= WORK).select("node")).distinct()
    wanted = written(wanted.join(texts, "node", "left_anti").join(names, "node"))
    discard(some, first)
    tidy(docs.sparkSession)
    further = written(line_texts(docs, text, wanted).dropDuplicates(["node"]))
    tidy(docs.sparkSession)
    every = texts.unionByName(further)
    few = written(verified(rest, every, least))
    tidy(docs.sparkSession)
    many = written(many_links(rows, every, least))
    discard(rows, rest, texts, further)
    tidy(docs.sparkSession)
    return _kept(table, named, components(edges.unionByName(few).unionByName(many)))


def _kept(table: DataFrame, signed: DataFrame, found: DataFrame) -> DataFrame:
    """Marks the first line of each component in a written table of places."""
    named = signed.select("node", *LINE, "copies").join(found, "node", "left").filter("copies > 1 or component is not null")
    several = written(named.select(*LINE, "copies", F.coalesce("component", "node").alias("component")))
    total = max(table.count(), 1)
    placed = written(lookup(table, several, LINE, "copies", total))
    # row and line number as one number, so that a hot component's rows combine before the shuffle
    place = F.col("row").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("line_no")
    grouped = placed.filter("component is not null")
    heads = grouped.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("n_lines"))
    kept = lookup(grouped, written(heads), ["component"], "n_lines", total).withColumn("kept", place == F.col("first"))
    alone = placed.filter("component is null").withColumn("kept", F.when(F.col("id").isNotNull(), F.lit(True)))
    columns = ["row", "carried", "line_no", "component", "kept"]
    return kept.select(*columns).unionByName(alone.select(*columns))


def marked(docs: DataFrame, row: str, text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``row, line_no, component, kept`` of each line with a visible character; ``component`` is null for a line without copies."""
    return judged(docs, row, text, least).filter("kept is not null")


def report(docs: DataFrame, row: str, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row a document: ``doc_id, n_lines`` (with a visible character), ``n_dropped`` and ``dropped`` (line numbers, from 0).

    Null and empty texts have no lines; repeated rows and null identifiers get a row each.
    """
    marks = judged(docs, row, text, least, doc_id)
    out = marks.groupBy("row").agg(F.max("carried").alias("doc_id"), F.count("kept").alias("n_lines"), F.sort_array(F.collect_list(F.when(~F.col("kept"), F.col("line_no")))).alias("dropped"))
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with the dropped lines taken out of the text; blank lines, other columns and all rows stay."""
    row, gone = fresh(docs, "_row"), fresh(docs, "_gone")
    tagged = written(docs.withColumn(row, F.monotonically_increasing_id()))
    dropped = marked(tagged, row, text, least).filter("not kept").groupBy("row").agg(F.collect_list("line_no").alias(gone)).withColumnRenamed("row", row)
    left = F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda x, i: ~F.array_contains(gone, i))
    both = tagged.join(dropped, row, "left")
    return both.withColumn(text, F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(left, "\n"))).select(*(f"`{c}`" for c in docs.columns))
