"""Token ids in sorted-string-table shards.

File: data blocks, sparse index, Bloom filter, footer.
 block   entries (varint shared key bytes, varint further key bytes, varint value bytes, key rest, value), then CRC-32
 key     0 for a null identifier, else 1 and the identifier as big-endian 64 bits with the sign flipped; then a
         32-bit ordinal, which tells rows with one identifier apart. Byte order is identifier order.
 value   the document's ids, little-endian, of the width in the footer (2 or 4 bytes)
 index   for each block its first key, offset, length and number of ids before it in the file
 filter  bits over the identifiers (key without ordinal), double hashing of XXH64
 footer  fixed size, with a magic number
A reader of one document tests the filter, searches the index by halving and decodes one block.
"""

from __future__ import annotations

import bisect
import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import batches_of, shared_dir, store
from lexmill.llm.piece_cache import encoder

MAGIC = b"LXSSTBL1"
FOOTER = struct.Struct("<QQQQQQII8s")  # index offset, bytes, filter offset, bytes, entries, ids, id width, hashes, magic
INDEX = struct.Struct("<HQIQ")  # key bytes, offset, block bytes, ids before
BLOCK_BYTES = 64 << 10
BITS_PER_KEY = 10
MAX_SHARDS = 10_000


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\0" else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


class Bloom:
    """A Bloom filter over byte strings."""

    def __init__(self, bits: np.ndarray, hashes: int):
        self.bits, self.hashes = bits, hashes

    @classmethod
    def of(cls, keys: list[bytes], bits_per_key: int = BITS_PER_KEY) -> Bloom:
        size = max(64, len(keys) * bits_per_key)
        out = cls(np.zeros(-(-size // 8), np.uint8), max(1, round(bits_per_key * math.log(2))))
        for k in keys:
            for at in out._places(k):
                out.bits[at >> 3] |= 1 << (at & 7)
        return out

    def _places(self, key: bytes) -> list[int]:
        h, size = xxhash.xxh64_intdigest(key), len(self.bits) * 8
        a, b = h & 0xFFFFFFFF, h >> 32 | 1
        return [(a + i * b) % size for i in range(self.hashes)]

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[at >> 3] >> (at & 7) & 1 for at in self._places(key))


class Writer:
    """Writes one shard from keys in ascending order; holds one block, the index and 9 bytes a key."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.at = self.entries = self.ids = self.before = 0
        self.block, self.last, self.first = bytearray(), b"", b""
        self.index: list[bytes] = []
        self.names: list[bytes] = []

    def add(self, key: bytes, value: bytes) -> None:
        if not self.block:
            self.first, self.last, self.before = key, b"", self.ids
        shared = next((i for i, (x, y) in enumerate(zip(key, self.last)) if x != y), min(len(key), len(self.last)))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.entries += 1
        self.ids += len(value) // self.width
        if not self.names or self.names[-1] != key[:-4]:
            self.names.append(key[:-4])
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.index.append(INDEX.pack(len(self.first), self.at, len(data), self.before) + self.first)
            self.sink.write(data)
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index, bloom = b"".join(self.index), Bloom.of(self.names)
        bits = bloom.bits.tobytes()
        self.sink.write(index + bits + FOOTER.pack(self.at, len(index), self.at + len(index), len(bits), self.entries, self.ids, self.width, bloom.hashes, MAGIC))


class Reader:
    """One shard, opened by its index and filter only."""

    def __init__(self, uri: str):
        files, path = store(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        at, n, bloom_at, bloom_n, self.entries, self.ids, self.width, hashes, magic = FOOTER.unpack(self._part(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token table")
        self.bloom = Bloom(np.frombuffer(self._part(bloom_at, bloom_n), np.uint8), hashes)
        data, i, self.blocks, self.firsts = self._part(at, n), 0, [], []
        while i < n:
            key, where, length, before = INDEX.unpack_from(data, i)
            i += INDEX.size
            self.firsts.append(data[i : i + key])
            self.blocks.append((where, length, before))
            i += key

    def _part(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray, int]]:
        """(key, ids, ids before it in the file) of block ``i``."""
        where, length, before = self.blocks[i]
        data = self._part(where, length)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        at, key = 0, b""
        while at < length - 4:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            ids = self._ids(data[at : at + n])
            at += n
            yield key, ids, before
            before += len(ids)

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray, int]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this identifier; an empty list if there is none."""
        name, out = key_of(doc_id), []
        if name not in self.bloom:
            return out
        for i in range(max(0, bisect.bisect_left(self.firsts, name) - 1), len(self.blocks)):
            if self.firsts[i][: len(name)] > name:
                break
            out += [ids for key, ids, _ in self.block(i) if key[:-4] == name]
        return out


@dataclass
class Shards:
    """The written shards in identifier order: (path, entries, ids, ids in shards before), the number of each, and the bounds between them."""

    files: list[tuple[str, int, int, int]]
    numbers: list[int] = field(default_factory=list)
    bounds: list[int] = field(default_factory=list)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this identifier, from the one shard whose range has it."""
        number = 0 if doc_id is None else bisect.bisect_left(self.bounds, doc_id)
        at = bisect.bisect_left(self.numbers, number)
        return Reader(self.files[at][0]).get(doc_id) if at < len(self.numbers) and self.numbers[at] == number else []


def write_shards(docs: DataFrame, tokenizer: str, end_id: int | None = 0, doc_id: str = "doc_id", text: str = "text", rows_per_shard: int = 8192, folder: str | None = None) -> Shards:
    """Encodes ``docs`` and writes one file a range of identifiers; returns the manifest.

    Null text is empty; ``end_id`` ends every document. Null identifiers come first; rows with one
    identifier are told apart by an ordinal (ordered by their ids). An empty table gives no files. Ranges come from approximate quantiles of
    the identifier column alone; there are at most MAX_SHARDS of them, and a shard is streamed, so its
    size is no bound on memory; all rows of one identifier are in one shard. A file gets its name only when complete, so a task may run again.
    The manifest has a row a shard.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = slim.count()
    shards = max(1, min(MAX_SHARDS, -(-rows // rows_per_shard)))
    bounds: list[int] = []
    if shards > 1:
        cuts = slim.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], max(10_000, 20 * shards)).alias("x")).first()["x"]
        bounds = sorted(set(cuts or []))
    n = len(bounds) + 1
    width = 2 if encoder(tokenizer).size <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
    folder = folder or shared_dir(spark) + "/tokens"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), b"" if end_id is None else struct.pack("<I", end_id)
        cuts = np.array(bounds, np.int64)
        for whole in batches:
            for batch in batches_of(whole):
                ids = [np.frombuffer(x + end, "<u4").astype("<u2" if width == 2 else "<u4").tobytes() for x in enc.encode(batch.column(1))]
                at = np.searchsorted(cuts, batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0), pa.array(ids, pa.binary())], ["shard", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = store(folder)
        files.create_dir(top, recursive=True)
        done, shard, out, last, nth, part = [], None, None, None, 0, ""

        def finish():
            out.close()
            out.sink.close()
            name = f"{top}/shard-{shard:05d}.sst"
            files.move(part, name)
            done.append((shard, f"{folder}/shard-{shard:05d}.sst", out.entries, out.ids))

        for batch in batches:
            for s, i, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    if out:
                        finish()
                    shard, last, nth = s, key_of(i), 0
                    part = f"{top}/.{s}-{uuid.uuid4().hex}"
                    out = Writer(files.open_output_stream(part), width)
                elif key_of(i) == last:
                    nth += 1
                else:
                    last, nth = key_of(i), 0
                out.add(last + struct.pack(">I", nth), ids)
        if out:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["shard", "path", "entries", "ids"])

    coded = slim.mapInArrow(encode, "shard int, doc_id long, ids binary").repartitionById(n, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    made = sorted(map(tuple, coded.mapInArrow(write, "shard int, path string, entries long, ids long").collect()))
    before, out = 0, []
    for _, path, entries, ids in made:
        out.append((path, entries, ids, before))
        before += ids
    return Shards(out, [number for number, *_ in made], bounds)


def read_shards(spark: SparkSession, shards: Shards) -> DataFrame:
    """One row a document, read from the files: ``doc_id, start, n_tokens, ids_crc32``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows: list[tuple] = []

                def flush(rows=rows):
                    out = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    rows.clear()
                    return out

                for key, ids, before in Reader(path):
                    rows.append((id_of(key), base + before, len(ids), zlib.crc32(ids.tobytes())))
                    if len(rows) >= 8192:
                        yield flush()
                if rows:
                    yield flush()

    table = spark.createDataFrame([(i, p, b) for i, (p, _, _, b) in enumerate(shards.files)], "k int, path string, base long")
    return table.repartitionById(max(1, len(shards.files)), "k").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
