"""Benchmark decontamination: CGK embedding, bit sampling and edit verification.

The CGK embedding (Chakraborty, Goldenberg and Koucky, 2016) reads a string with a random walk: step j writes
the character under the pointer, and a random bit of (j, character) says whether the pointer moves. Strings at
a small edit distance walk together again soon after a difference, so edit distance becomes Hamming distance.
Bit-sampling LSH then takes ``TABLES`` samples of ``SAMPLED`` coordinates each; windows that agree on a whole
sample are candidates.

Walks of a whole item don't do: at an edit distance of a fifth they drift apart for good, and no sample that tells texts
apart survives. So an item is embedded from each of its characters on (``STEPS`` steps, about half as many characters) and a document
from every ``STRIDE``-th byte on (from each, if an item is shorter than ``SHORT`` bytes), whatever stands there; a passage has as many chances as the item has windows. A
candidate aligns the item with the document. Then ``SEGMENT`` bytes of the item around the window are compared with the
document, all candidates at once (Myers' bit vectors, a machine word each). What is left is verified by the exact edit
distance of the whole item to the item-sized stretch there, with a margin of the allowed edits.

Items under ``MIN_CHARS`` bytes have too few windows. They are found unedited, by a lookup of their beginnings; so are the beginnings of
items under ``SHORT`` bytes, besides.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import batches_of, fresh, numbered, shared_dir, store, texts_of, without, written
from lexmill.llm.memo import tidied

STEPS, TABLES, SAMPLED, STRIDE = 32, 8, 12, 4
SEED = 20160619
MIN_CHARS, SHORT = 24, 64
BLOCK_CHARS = 1 << 19  # of items in one index
BATCH, HELD = 3 << 20, 48 << 20  # bytes of text searched at once, and held while several indexes take turns
#: A segment of an item that is at most a fifth away as a whole is, around some window, at most this far away.
SEGMENT, SLACK, SEGMENT_EDITS = 64, 12, 0.3
#: Of the 16 bytes from a window on so many are equal, where its walk hasn't met by chance.
EQUAL = 9
U32, U = np.uint32, np.uint64
_SPACE = bytes.maketrans(bytes(b for b in range(128) if not chr(b).isalnum()), b" " * sum(not chr(b).isalnum() for b in range(128)))


def normal(text: bytes) -> bytes:
    """Lower case, ASCII letters and digits and all other characters beyond ASCII, single blanks."""
    text = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode("utf-8", "replace")
    return b" ".join(text.translate(_SPACE).split())


def plan(seed: int = SEED) -> tuple[np.ndarray, list[list[int]]]:
    """The walk's bits by step and byte, and for each step the tables that sample it."""
    rng = np.random.default_rng(seed)
    moves = rng.integers(0, 2, (STEPS, 256)).astype(np.int32)
    samples = [set(rng.choice(STEPS, SAMPLED, replace=False).tolist()) for _ in range(TABLES)]
    return moves, [[t for t in range(TABLES) if j in samples[t]] for j in range(STEPS)]


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where words begin in blank- or line-separated bytes, and each character beyond ASCII (a script without blanks has items begin anywhere)."""
    gap = (data == 32) | (data == 10)
    return np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]) | (data >= 0xC0))


def walk(data: np.ndarray, starts: np.ndarray, moves: np.ndarray, sampled: list[list[int]]) -> np.ndarray:
    """Sample hashes (TABLES x starts) of the windows; ``data`` has STEPS bytes of room behind the last start."""
    out = np.zeros((TABLES, len(starts)), U32)
    part = 1 << 15  # so that working arrays stay in a core's cache
    for i in range(0, len(starts), part):
        at = starts[i : i + part].copy()
        for j in range(STEPS):
            c = data[at]
            for t in sampled[j]:
                row = out[t, i : i + part]
                np.multiply(row, U32(0x01000193), out=row)
                np.add(row, c, out=row)
            at += moves[j][c]
    return out


def begin_hashes(data: np.ndarray, starts: np.ndarray, lengths: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Each of the lengths with the hashes of so many bytes from each start on."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(max(lengths, default=0)):
        out = out * np.uint64(0x100000001B3) + data[starts + j] + np.uint64(1)
        if j + 1 in lengths:
            yield j + 1, out


def whole_at(text: bytes, at: int, item: bytes) -> bool:
    """Whether the item is at that place and ends with a word, or with or before a character beyond ASCII."""
    end = at + len(item)
    return at >= 0 and text[at:end] == item and (end == len(text) or text[end] == 32 or text[end] >= 128 or item[-1] >= 128)


def edit_end(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance, at most ``most``, of ``pattern`` to a substring of ``text``, and where that substring ends."""
    if (i := text.find(pattern)) >= 0:
        return 0, i + len(pattern)
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = score, j + 1
    return best


def least_edits(tables: np.ndarray, which: np.ndarray, data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each pair of a pattern of SEGMENT bytes and a start: the least edit distance of the pattern to a substring of the ``length`` bytes there.

    ``tables`` has, for each pattern and six-bit class of a byte, the places of that class; so the distance is never too large.
    """
    out = np.empty(len(which), np.int32)
    part = 1 << 12
    flat, one, top = tables.ravel(), U(1), U(SEGMENT - 1)
    for i in range(0, len(which), part):
        base, at = which[i : i + part].astype(np.int64) * 64, starts[i : i + part]
        pv, mv = np.full(len(base), ~U(0)), np.zeros(len(base), U)
        score = np.full(len(base), SEGMENT, np.int32)
        best = score.copy()
        for j in range(length):
            eq = flat[base + (data[at + j] & 63)]
            xv = eq | mv
            xh = ((eq & pv) + pv ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            score += (ph >> top).astype(np.int32)
            score -= (mh >> top).astype(np.int32)
            np.minimum(best, score, out=best)
            ph <<= one
            pv = mh << one | ~(xv | ph)
            mv = ph & xv
        out[i : i + part] = best
    return out


def equal_bytes(one: np.ndarray, at: np.ndarray, two: np.ndarray, to: np.ndarray) -> np.ndarray:
    """How many of the 16 bytes of ``one`` from ``at`` on are those of ``two`` from ``to`` on."""
    words = [np.ndarray((len(x) - 7,), "<u8", x.data, strides=(1,)) for x in (one, two)]
    out = np.full(len(at), 16, np.uint8)
    for j in (0, 8):
        x = words[0][at + j] ^ words[1][to + j]
        out -= np.bitwise_count(((x & U(0x7F7F7F7F7F7F7F7F)) + U(0x7F7F7F7F7F7F7F7F) | x) & U(0x8080808080808080))
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges [low, high), and the range each is of."""
    n = high - low
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(n)), n)


@dataclass
class ItemIndex:
    """Windows of a block of items by sample hash."""

    items: list[tuple[int | None, bytes, str]]
    sizes: np.ndarray
    keys: np.ndarray  # table << 32 | hash, sorted
    item: np.ndarray  # for each key
    offset: np.ndarray
    origin: np.ndarray  # of the window in ``data``
    data: np.ndarray
    field: np.ndarray
    segments: np.ndarray  # for each segment and class of bytes, the places of the class
    first_segment: np.ndarray  # of each item
    stride: int  # of a document's windows
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: sorted hashes of so many first bytes, and the items

    @classmethod
    def of(cls, items: list[tuple[int | None, bytes]]) -> ItemIndex:
        moves, sampled = plan()
        kept = [(i, n, n.decode("utf-8", "replace")) for i, t in items if (n := normal(t))]
        sizes = np.array([len(n) for _, n, _ in kept], np.int64)
        long = np.flatnonzero(sizes >= MIN_CHARS)
        # the last windows would read mostly what lies behind the item
        counts = sizes[long] - STEPS * 3 // 8 + 1
        bases = np.cumsum(sizes[long] + STEPS) - sizes[long] - STEPS
        data = np.frombuffer(b"".join(kept[k][1] + b"\n" * STEPS for k in long) + bytes(STEPS), np.uint8)
        starts, owner = spread(bases, bases + counts)
        found = walk(data, starts.astype(np.int32), moves, sampled)
        keys = (np.arange(TABLES, dtype=U)[:, None] << U(32) | found).ravel()
        order = np.argsort(keys, kind="stable")
        place = order % max(1, found.shape[1])
        keys = keys[order]
        field = np.zeros(1 << min(27, max(16, len(keys).bit_length() + 3)), bool)
        field[cls.place(keys, field)] = True
        # segments begin at every eighth byte, the last ends with the item
        some = np.zeros(len(kept), np.int64)
        some[sizes >= SEGMENT] = -(-(sizes[sizes >= SEGMENT] - SEGMENT) // 8) + 1
        first = np.cumsum(some) - some
        segments = np.zeros((int(some.sum()), 64), U)
        if len(segments):
            text = np.frombuffer(b"".join(n for _, n, _ in kept), np.uint8)
            at, which = spread(np.zeros(len(kept), np.int64), some)
            at = np.minimum(at * 8, sizes[which] - SEGMENT) + (np.cumsum(sizes) - sizes)[which]
            rows = np.arange(len(segments))
            for j in range(SEGMENT):
                segments[rows, text[at + j] & 63] |= U(1 << j)
        short = {}
        for size in {min(len(n), MIN_CHARS) for _, n, _ in kept if len(n) < SHORT}:
            few = np.array([k for k, (_, n, _) in enumerate(kept) if len(n) < SHORT and min(len(n), MIN_CHARS) == size])
            text = np.frombuffer(b"".join(kept[k][1][:size] for k in few), np.uint8)
            ((_, hashes),) = begin_hashes(text, np.arange(0, len(text), size), {size})
            by = np.argsort(hashes, kind="stable")
            short[size] = hashes[by], few[by]
        return cls(kept, sizes, keys, long[owner][place].astype(np.int32), (starts - bases[owner])[place].astype(np.int32), starts[place].astype(np.int32), data, field, segments, first, 1 if ((sizes >= MIN_CHARS) & (sizes < SHORT)).any() else STRIDE, short)

    @staticmethod
    def place(keys: np.ndarray, field: np.ndarray) -> np.ndarray:
        return (keys * U(0x9E3779B97F4A7C15) >> U(65 - len(field).bit_length())).astype(np.int64)

    def candidates(self, data: np.ndarray, moves: np.ndarray, sampled: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(item, place in ``data`` where the item would begin), from windows that share a sample and resemble each other around it, and from beginnings of short items."""
        starts = np.arange(0, max(0, len(data) - 2 * STEPS), self.stride, dtype=np.int32)
        seen = []
        for t, row in enumerate(walk(data, starts, moves, sampled)):
            if not len(self.keys):
                break
            keys = row.astype(U) | U(t << 32)
            maybe = np.flatnonzero(self.field[self.place(keys, self.field)])
            low = np.searchsorted(self.keys, keys[maybe])
            hit = self.keys[np.minimum(low, len(self.keys) - 1)] == keys[maybe]
            maybe, low = maybe[hit], low[hit]
            at, which = spread(low, np.searchsorted(self.keys, keys[maybe], "right"))
            # one candidate for all windows of 16 bytes on nearly the same diagonal
            begin = starts[maybe[which]].astype(np.int64)
            same = equal_bytes(data, begin, self.data, self.origin[at]) >= EQUAL
            at, begin = at[same], begin[same]
            where = begin - self.offset[at]
            seen.append(distinct((self.item[at].astype(np.int64) << 16 | np.minimum(self.offset[at] >> 4, 0xFFFF)) << 30 | (where + (1 << 26)) >> 2))
        whats, wheres = [], []
        if seen:
            code = distinct(np.concatenate(seen))
            where = ((code & ((1 << 30) - 1)) << 2) - (1 << 26) + 2
            what, offset = code >> 46, ((code >> 30) & 0xFFFF) << 4
            size = self.sizes[what]
            # the segment around the window; items under a segment go on as they are
            step = np.clip(offset - SEGMENT // 2 + 8, 0, np.maximum(size - SEGMENT, 0)) >> 3
            begin = where + step * 8 - SLACK
            length = SEGMENT + 2 * SLACK
            keep = size < SEGMENT
            judge = np.flatnonzero(~keep)
            edits = least_edits(self.segments, self.first_segment[what[judge]] + step[judge], data, np.clip(begin[judge], 0, max(0, len(data) - length - 1)), min(length, len(data) - 1))
            keep[judge[edits <= SEGMENT_EDITS * SEGMENT]] = True
            whats.append(what[keep])
            wheres.append(where[keep])
        if self.short:
            begins = word_starts(data[: -2 * STEPS])
            for size, hashes in begin_hashes(data, begins, set(self.short)):
                known, item = self.short[size]
                at, which = spread(np.searchsorted(known, hashes), np.searchsorted(known, hashes, "right"))
                whats.append(item[at])
                wheres.append(begins[which])
        if not whats:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        what, where = np.concatenate(whats), np.concatenate(wheres)
        order = np.lexsort((where, what))
        return what[order], where[order]


def search(texts: list[bytes], index: ItemIndex, most_edits: float, moves: np.ndarray, sampled: list[list[int]]) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, edits, end in the normalised text's bytes) of the best verified place of each item in each text."""
    normals = [normal(t) for t in texts]
    ends = np.cumsum([len(n) + 1 for n in normals])
    data = np.frombuffer(b"\n".join(normals) + b"\n" * (2 * STEPS + SEGMENT + 2 * SLACK), np.uint8)
    what, where = index.candidates(data, moves, sampled)
    if not len(what):
        return
    # the window, not the item's beginning, is surely in the text; a beginning may fall before it
    text = np.searchsorted(ends, np.clip(where + index.sizes[what] // 2, 0, ends[-1] - 1), "right")
    best: dict[tuple[int, int], tuple[int, int]] = {}
    tried: dict[tuple[int, int], int] = {}
    for d0, k, at in zip(text.tolist(), what.tolist(), where.tolist()):
        _, size, name = index.items[k][0], len(index.items[k][1]), index.items[k][2]
        most = int(most_edits * len(name))
        for d in {d0, max(0, d0 - 1), min(len(normals) - 1, d0 + 1)} if (at < 0 or at + size > ends[d0] or d0 and at < ends[d0 - 1]) else {d0}:
            base = int(ends[d - 1]) if d else 0
            low, high = max(0, at - base - most - 1), at - base + size + most + 1
            if high <= 0 or low >= len(normals[d]) or best.get((d, k), (1,))[0] == 0:
                continue
            if size < MIN_CHARS:
                if whole_at(normals[d], at - base, index.items[k][1]):
                    best[(d, k)] = 0, at - base + size
                continue
            if tried.get((d, k), -(1 << 60)) >= at - 4:  # the margin covers neighbouring alignments
                continue
            window = normals[d][low:high].decode("utf-8", "ignore")
            tried[(d, k)] = at
            found = edit_end(name, window, most)
            if found and (old := best.get((d, k))) is None or found and found[0] < old[0]:
                best[(d, k)] = found[0], low + len(window[: found[1]].encode())
    for (d, k), (edits, end) in best.items():
        yield d, k, edits, end


def indexes(items: DataFrame, item_id: str, item_text: str) -> list[str]:
    """Files of the shared folder with an index for each block of about BLOCK_CHARS bytes of items."""
    spark = items.sparkSession
    slim = written(items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, base = -(-size // BLOCK_CHARS) or 1, shared_dir(spark)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), texts_of(batch.column(1)))
        if held:
            fs, path = store(base)
            fs.create_dir(path, recursive=True)
            name = f"index-{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(f"{path}/{name}") as f:
                pickle.dump(ItemIndex.of(held), f, protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([f"{base}/{name}"])], ["file"])

    dealt = slim.repartition(blocks, F.xxhash64("item_id", "text")) if blocks > 1 else slim.coalesce(1)
    return [r.file for r in dealt.mapInArrow(build, "file string").collect()]  # a name a block


def loaded(file: str) -> ItemIndex:
    fs, path = store(file)
    with fs.open_input_stream(path) as f:
        return pickle.loads(f.read())


def leaks(docs: DataFrame, items: DataFrame, row: str, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_edits: float = 0.2) -> DataFrame:
    """``row, doc_id, item_id, item_chars, edits, end``: each item found in each document, at its best place.

    Both sides are compared in normal form (lower case, punctuation and white space as single blanks). A passage
    counts with an edit distance of at most ``most_edits`` of the item's length. Items of under MIN_CHARS bytes
    in normal form count unedited only, as whole words; null and empty texts find nothing. ``end`` is a byte position in normal form. Repeated
    items and documents are each reported. Documents are read once: where there are several blocks of items, their indexes take turns at
    HELD bytes of text, so memory is bounded whatever the benchmark's size.
    """
    slim = docs.select(F.col(f"`{row}`").alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    files = indexes(items, item_id, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, sampled = plan()
        index = loaded(files[0]) if len(files) == 1 else None
        held: list[pa.RecordBatch] = []

        def found() -> Iterator[pa.RecordBatch]:
            for file in files:
                now = index or loaded(file)
                for batch in held:
                    rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                    hits = [(rows[d], ids[d], now.items[k][0], len(now.items[k][2]), edits, end) for d, k, edits, end in search(texts_of(batch.column(2)), now, most_edits, moves, sampled)]
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*hits)], ["row", "doc_id", "item_id", "item_chars", "edits", "end"])
            held.clear()

        for whole in batches:
            for batch in batches_of(whole, BATCH):
                held.append(batch)
                if index or sum(b.nbytes for b in held) >= HELD:
                    yield from found()
        yield from found()

    return slim.mapInArrow(tidied(run), "row long, doc_id long, item_id long, item_chars long, edits long, end long")


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", most_edits: float = 0.2) -> DataFrame:
    """``docs`` without those in which an item was found; columns as they were."""
    row = fresh(docs, "_row")
    tagged = numbered(docs, row)
    return without(tagged, leaks(tagged, items, row, doc_id, text, most_edits=most_edits).select("row"), row)
