"""Exact dedup: a tree of merges over sorted digest runs.

Every partition sorts its digests into runs. In round i of the binomial exchange, partition p sends each
entry to the partition whose number is p with digit i replaced by digit i of the entry's digest (digits to
the base ``radix``), so that a partition receives sorted runs from ``radix`` others. It merges them, all at once, and keeps for each
verified digest the winning identifier and the number of copies. After the last round partition q holds all
that was digested to q: recursive halving, so no partition ever holds more than its share of the digests,
and a text with many copies is one entry a run from the start.

A run travels as chunks of at most ``CHUNK`` entries. A task takes chunks in the order of their first keys, so
a merge holds one open chunk a run, and nothing is sorted anew but those few chunk rows.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import fresh, lookup, numbered, texts_of, without, written
from lexmill.llm.memo import tidied

DIGESTS = "row long, doc_id long, digest binary, probe long, bytes long"
CHUNKS = "part long, first binary, entries binary"
RUNS = "digest binary, probe long, bytes long, best_id long, best_row long, copies long"
KEY = ["digest", "probe", "bytes"]
PROBE, ENTRY = struct.Struct(">qq"), struct.Struct("<?qqq")
KEY_BYTES = 32 + PROBE.size
RUN, CHUNK = 200_000, 4096


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.lower() for t in texts_of(batch.column(2))]  # bytes.lower() changes A-Z only
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1),
            pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
            pa.array(np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)),
            pa.array([len(t) for t in texts], pa.int64()),
        ], ["row", "doc_id", "digest", "probe", "bytes"])


def digests(docs: DataFrame, row: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its row number, id, SHA-256 of the text with A-Z lowered, XXH64 and length.

    Null text counts as empty. The XXH64 and the length verify what the SHA-256 says.
    """
    return docs.select(F.col(f"`{row}`").alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(tidied(_digest), DIGESTS)


class Outbox:
    """Entries in key order, gathered by partition they go to and passed on as chunks."""

    def __init__(self, parts: int, radix: int, turn: int):
        self.parts, self.radix, self.turn = parts, radix, turn
        self.held: dict[int, list[tuple]] = {}

    def target(self, part: int, digest: bytes) -> int:
        """``turn`` < 0: the last level, no further exchange."""
        if self.turn < 0:
            return part
        step = self.radix**self.turn
        digit = int.from_bytes(digest[:8], "big") % self.parts // step % self.radix
        return part + (digit - part // step % self.radix) * step

    def put(self, part: int, entry: tuple) -> Iterator[pa.RecordBatch]:
        to = self.target(part, entry[0][:32])
        mine = self.held.setdefault(to, [])
        mine.append(entry)
        if len(mine) >= CHUNK:
            yield self.chunk(to)

    def chunk(self, to: int) -> pa.RecordBatch:
        entries = self.held.pop(to)
        return pa.RecordBatch.from_arrays([pa.array([to], pa.int64()), pa.array([entries[0][0]], pa.binary()), pa.array([_packed(entries)], pa.binary())], ["part", "first", "entries"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        for to in list(self.held):
            yield self.chunk(to)


def _packed(entries: list[tuple]) -> bytes:
    """Entries (key, id, row, copies) as bytes; a key is a digest, the probe and the length, in an order that bytes have too."""
    return b"".join(key + ENTRY.pack(i is None, i or 0, row, copies) for key, i, row, copies in entries)


def _unpacked(blob: bytes) -> Iterator[tuple]:
    for at in range(0, len(blob), KEY_BYTES + ENTRY.size):
        none, i, row, copies = ENTRY.unpack_from(blob, at + KEY_BYTES)
        yield blob[at : at + KEY_BYTES], None if none else i, row, copies


def better(one: tuple, two: tuple, largest: bool) -> tuple:
    """The winner's identifier and row: null loses, then the identifier decides, then the smaller row."""
    rank = lambda e: (e[0] is None, (-e[0] if largest else e[0]) if e[0] is not None else 0, e[1])
    return min(one, two, key=rank)


def united(entries: Iterator[tuple], largest: bool) -> Iterator[tuple]:
    """Sorted entries with one of each key."""
    held = None
    for key, i, row, copies in entries:
        if held and held[0] == key:
            i, row = better(held[1:3], (i, row), largest)
            copies += held[3]
        elif held:
            yield held
        held = key, i, row, copies
    if held:
        yield held


def first_runs(batches: Iterator[pa.RecordBatch], parts: int, radix: int, turn: int, largest: bool) -> Iterator[pa.RecordBatch]:
    """Sorted runs of at most RUN rows of a partition, on their way to the first exchange."""
    part = TaskContext.get().partitionId() % parts
    held: list[tuple] = []

    def run() -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda e: e[0])
        box = Outbox(parts, radix, turn)
        for entry in united(held, largest):
            yield from box.put(part, entry)
        yield from box.rest()
        held.clear()

    for batch in batches:
        for row, i, digest, probe, size in zip(*(c.to_pylist() for c in batch.columns)):
            held.append((digest + PROBE.pack(probe, size), i, row, 1))
            if len(held) >= RUN:
                yield from run()
    yield from run()


def merged(chunks: Iterator[tuple[bytes, bytes]], largest: bool) -> Iterator[tuple]:
    """One sorted run from the chunks (first key, entries) of many, in the order of their first keys.

    The next chunk is opened before an entry at or above its first key is taken; by then its run's last chunk is used up.
    """
    heap: list[tuple] = []
    count = 0
    ahead = next(chunks, None)

    def entries() -> Iterator[tuple]:
        nonlocal ahead, count
        while heap or ahead:
            while ahead and (not heap or ahead[0] <= heap[0][0]):
                cursor = _unpacked(ahead[1])
                entry = next(cursor)
                heapq.heappush(heap, (entry[0], count, entry, cursor))
                count += 1
                ahead = next(chunks, None)
            _, number, entry, cursor = heap[0]
            yield entry
            after = next(cursor, None)
            if after is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (after[0], number, after, cursor))

    return united(entries(), largest)


def merge_runs(batches: Iterator[pa.RecordBatch], parts: int, radix: int, turn: int, largest: bool) -> Iterator[pa.RecordBatch]:
    """A level of the tree: the runs that met in each partition become one, passed on for the next exchange; after the last, its entries."""
    if turn < 0:
        yield from finished(merge_level(batches, parts, radix, turn, largest))
    else:
        yield from merge_level(batches, parts, radix, turn, largest)


def merge_level(batches: Iterator[pa.RecordBatch], parts: int, radix: int, turn: int, largest: bool) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for part, group in itertools.groupby(rows, key=lambda row: row[0]):
        box = Outbox(parts, radix, turn)
        for entry in merged((row[1:] for row in group), largest):
            yield from box.put(part, entry)
        yield from box.rest()


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(2).to_pylist():
            keys, ids, rows, copies = zip(*_unpacked(blob))
            probes, sizes = zip(*(PROBE.unpack(k[32:]) for k in keys))
            yield pa.RecordBatch.from_arrays([pa.array([k[:32] for k in keys], pa.binary()), *(pa.array(c, pa.int64()) for c in (probes, sizes, ids, rows, copies))], [*KEY, "best_id", "best_row", "copies"])


def tree_shape(partitions: int, max_rounds: int = 3) -> tuple[int, int]:
    """(radix, rounds) with radix ** rounds >= partitions and at most ``max_rounds`` rounds."""
    radix = 4
    while radix**max_rounds < partitions:
        radix += 1
    rounds = 1
    while radix**rounds < partitions:
        rounds += 1
    return radix, rounds


def classes(table: DataFrame, keep: str = "smallest", partitions: int | None = None) -> DataFrame:
    """The finished runs: one row a text, with the identifier and row that stay and the number of copies.

    ``keep``: "smallest" or "largest" identifier; null identifiers lose to all others; of rows with the
    same text and identifier the smallest row number wins.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep!r}")
    partitions = partitions or int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    radix, rounds = tree_shape(partitions)
    parts = radix**rounds
    largest = keep == "largest"
    turns = [*range(rounds), -1]
    runs = table.select("row", "doc_id", *KEY).mapInArrow(lambda it: first_runs(it, parts, radix, turns[0], largest), CHUNKS)
    for turn in turns[1:]:
        met = runs.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "first")
        runs = met.mapInArrow(lambda it, turn=turn: merge_runs(it, parts, radix, turn, largest), RUNS if turn < 0 else CHUNKS)
    return runs


def marked(docs: DataFrame, row: str, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """One row a document: ``row, doc_id, keep_id, group_size, kept, text_sha256``."""
    table = written(digests(docs, row, doc_id, text))
    found = written(classes(table, keep))
    answers = found.select(*KEY, F.col("best_id").alias("keep_id"), "best_row", F.col("copies").alias("group_size"))
    rows = lookup(table, answers, KEY, "group_size", table.count())
    return rows.select("row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("best_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` with one row left of each set of equal texts, all columns as they were.

    Texts are equal if identical after lowering A-Z. Null and empty texts are equal to each other. Of rows
    that repeat both text and identifier exactly one stays. An empty table gives an empty table; columns
    that clash with names used here don't matter.
    """
    row = fresh(docs, "_row")
    tagged = numbered(docs, row)
    return without(tagged, marked(tagged, row, doc_id, text, keep).filter("not kept").select("row"), row)
