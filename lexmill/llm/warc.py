"""WARC archives: writing, the normaliser of monolithic gzip files, and reading by index.

Archives are first written as one gzip stream a file, the form that record-wise readers can't enter. The
normaliser inflates such a file once, as a stream, rewrites every record as a gzip member of its own and writes a
sidecar index: a line a record with offset and length of its member, record type, identifier and target. The
archive is then read by the index, each record on its own. Memory: one record and small buffers.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import fresh, lookup, shared_dir, store, texts_of, written

CHUNK = 1 << 18
MAX_TASKS = 1 << 13
DATE = "1970-01-01T00:00:00Z"  # pages have no time of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = ["digest", "probe", "bytes"]


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record_id(row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'record {row}')}>"


def record(row: int, page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, original: tuple[int, int | None] | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of ``original`` (row and page) without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if original is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {record_id(row)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if original is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(original[0])}"]
        if original[1] is not None:
            head.append(f"X-Refers-To-Page: {original[1]}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record in a stream of bytes."""
    held = bytearray()
    at, ended = 0, False

    def more() -> bool:
        nonlocal ended
        chunk = next(chunks, None)
        ended = chunk is None
        if chunk:
            held.extend(chunk)
        return not ended

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if held[at:].strip():
                    raise ValueError("the archive ends within a record's header")
                return
        lines = held[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size, begin = int(head["content-length"]), end + 4
        while len(held) < begin + size + 4:
            if not more():
                raise ValueError("the archive ends within a record")
        yield head, bytes(held[begin : begin + size])
        del held[: begin + size + 4]
        at = 0


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file, in pieces; further members follow on."""
    inflate = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            yield inflate.decompress(data, 4 * CHUNK)
            if inflate.eof:
                data = inflate.unused_data
                inflate = zlib.decompressobj(31)
            else:
                data = inflate.unconsumed_tail


def as_bytes(head: dict[str, str], block: bytes) -> bytes:
    names = {"warc-type": "WARC-Type", "warc-record-id": "WARC-Record-ID", "warc-date": "WARC-Date", "warc-target-uri": "WARC-Target-URI"}
    lines = ["WARC/1.1", *(f"{names.get(k, '-'.join(p.upper() if p in ('warc', 'id', 'uri') else p.capitalize() for p in k.split('-')))}: {v}" for k, v in head.items())]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def normalise(uri: str, level: int = 6) -> tuple[str, str, int]:
    """Rewrites ``x.warc.gz`` record-wise; returns the archive, its index and the number of records.

    Both files get their names when complete.
    """
    files, path = store(uri)
    stem, mark, n, at = path.removesuffix(".warc.gz"), uuid.uuid4().hex, 0, 0
    with files.open_input_stream(path, compression=None) as source, files.open_output_stream(f"{stem}.{mark}.a", compression=None) as sink, files.open_output_stream(f"{stem}.{mark}.i", compression=None) as index:
        for head, block in split_records(inflated(source)):
            deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = deflate.compress(as_bytes(head, block)) + deflate.flush()
            sink.write(member)
            line = {"offset": at, "length": len(member), "type": head.get("warc-type"), "id": head.get("warc-record-id"), "target": head.get("warc-target-uri")}
            index.write(json.dumps(line).encode() + b"\n")
            at += len(member)
            n += 1
    files.move(f"{stem}.{mark}.a", f"{stem}.norm.warc.gz")
    files.move(f"{stem}.{mark}.i", f"{stem}.norm.index")
    base = uri.removesuffix(".warc.gz")
    return f"{base}.norm.warc.gz", f"{base}.norm.index", n


def read_index(uri: str) -> Iterator[dict]:
    files, path = store(uri)
    with files.open_input_stream(path, compression=None) as f:
        rest = b""
        while data := f.read(CHUNK):
            *lines, rest = (rest + data).split(b"\n")
            yield from map(json.loads, lines)


def read_member(source, entry: dict) -> tuple[dict[str, str], bytes]:
    """The record that an index line names, from an open archive."""
    source.seek(entry["offset"])
    return next(split_records(iter([zlib.decompress(source.read(entry["length"]), 31)])))


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        texts = texts_of(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([hashlib.sha1(t).digest() for t in texts], pa.binary()), pa.array(np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)), pa.array([len(t) for t in texts], pa.int64())], ["row", "page_id", *KEY])


def write_archives(pages: DataFrame, row: str, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", smallest: int = 0, rows_per_file: int = 2048) -> DataFrame:
    """Writes a record a page in monolithic ``part-N.warc.gz`` files; returns ``path, records``.

    Null html is an empty payload. Of payloads that are equal (SHA-1, XXH64 and length) and of at least
    ``smallest`` bytes, the row with the largest page_id (then the smallest row number) is the response and all
    others revisit it; null identifiers lose to all others. Copies are found from digests alone; a page's
    answer comes by a lookup that no group of copies can overload, keyed by row number.
    """
    spark = pages.sparkSession
    slim = pages.select(F.col(f"`{row}`").alias("row"), F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    table = written(slim.select("row", "page_id", "html").mapInArrow(_payloads, "row long, page_id long, digest binary, probe long, bytes long"))
    # of a group only its best row meets: the maximum is combined before the shuffle
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("a"), F.col("page_id").alias("b"), (-F.col("row")).alias("c"))).alias("best")
    groups = table.filter(F.col("bytes") >= smallest).groupBy(*KEY).agg(best, F.count("*").alias("copies")).filter("copies > 1")
    groups = written(groups.select(*KEY, "copies", F.col("best.b").alias("to_page"), (-F.col("best.c")).alias("to_row")))
    n = table.count()
    marks = lookup(table, groups, KEY, "copies", n).select("row", "digest", "bytes", "to_page", F.when(F.col("to_row") != F.col("row"), F.col("to_row")).alias("to_row"))
    files_ = max(1, -(-n // rows_per_file))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = store(folder)
        files.create_dir(top, recursive=True)
        made, part, sink, gz, tmp, n = [], None, None, None, "", 0

        def finish():
            sink.write(gz.flush())
            sink.close()
            files.move(tmp, f"{top}/part-{part:05d}.warc.gz")
            made.append((f"{folder}/part-{part:05d}.warc.gz", n))

        mark = None  # of the next row; a row's mark comes before its page
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(9)]
            for file, r, is_page, page, target, size, to_page, to_row, sha, payload in zip(*cols, texts_of(batch.column(9))):
                if not is_page:
                    mark = r, size, to_page, to_row, sha
                    continue
                if file != part:
                    if sink:
                        finish()
                    part, n, tmp = file, 0, f"{top}/.{file}-{uuid.uuid4().hex}"
                    sink, gz = files.open_output_stream(tmp, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                if mark is None or mark[0] != r:
                    raise ValueError(f"row {r} has no mark")
                _, size, to_page, to_row, sha = mark
                original = None if to_row is None else (to_row, to_page)
                sink.write(gz.compress(record(r, page, target, payload, size, base64.b32encode(sha).decode(), original)))
                n += 1
        if sink:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["path", "records"])

    # pages and marks meet in the writer, by one shuffle
    file = F.pmod(F.xxhash64("row"), F.lit(files_)).cast("int").alias("file")
    none = lambda kind: F.lit(None).cast(kind)
    these = slim.select(file, "row", F.lit(True).alias("is_page"), "page_id", "url", none("long").alias("bytes"), none("long").alias("to_page"), none("long").alias("to_row"), none("binary").alias("digest"), "html")
    those = marks.select(file, "row", F.lit(False).alias("is_page"), none("long").alias("page_id"), none("string").alias("url"), "bytes", "to_page", "to_row", "digest", none("string").alias("html"))
    rows = these.unionByName(those)
    tasks = min(files_, MAX_TASKS)  # a task writes its files one after the other
    return rows.repartitionById(tasks, F.pmod("file", F.lit(tasks))).sortWithinPartitions("file", "row", "is_page").mapInArrow(write, "path string, records long")


def normalised(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """Normalises each archive of ``path``; returns ``path, index, records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                got = normalise(path)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in got], ["path", "index", "records"])

    return spread(archives).mapInArrow(run, "path string, index string, records long")


def spread(paths: DataFrame) -> DataFrame:
    """A written table with a row a file, a task for each few rows."""
    return paths.repartition(max(1, min(paths.count(), 4096)), *paths.columns[:1])


def read_archives(archives: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, target`` of each indexed record.

    A response's digest and size are taken from its payload and must agree with its headers.
    """
    form = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, at = store(path)
                rows = []
                with files.open_input_file(at) as source:
                    for entry in read_index(index):
                        head, block = read_member(source, entry)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response" and (len(payload) != size or digest32(payload) != digest):
                            raise ValueError(f"{path}: the record at {entry['offset']} isn't what its headers say")
                        rows.append((number(head.get("x-page-id")), size, digest, head["warc-type"], number(head.get("x-refers-to-page")), head.get("warc-target-uri")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target"])

    return spread(archives).mapInArrow(run, form)


def archive(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes, normalises and reads back ``pages``: one row a page, from the archives.

    Handles null in any column, empty and repeated pages and an empty table; other columns are ignored. ``pages`` is read
    twice and must give its rows in the same order both times, as a table does.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark) + "/warc"
    row = fresh(pages, "_row")
    tagged = pages.withColumn(row, F.monotonically_increasing_id())
    made = written(write_archives(tagged, row, folder, **columns))
    done = written(normalised(spark, made.filter("path is not null")))
    return read_archives(done)
