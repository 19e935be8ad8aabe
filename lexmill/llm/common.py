"""What the corpus operators share: the shared folder, written tables, skew-safe lookups, components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.memo import tidied

#: A lookup broadcasts only keys that hold at least this share of all rows, so never more than so many keys.
MAX_HOT_KEYS = 4096
#: Row numbers to drop are kept in files of a file's (or partition's) next so many rows, as a power of two.
PART_BITS = 20
ARROW, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a local master gets a temporary folder; any other master is an error,
    as executors could not see it. The folder goes when the driver's interpreter ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/lexmill-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    Where the session has no value of its own for it, Arrow batches are set to ``ARROW_ROWS`` rows: whole texts make larger ones costly.
    """
    if df.sparkSession.conf.get(ARROW, "10000") == "10000":
        df.sparkSession.conf.set(ARROW, str(ARROW_ROWS))
    path = path or shared_dir(df.sparkSession) + "/table"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a column of row numbers that are the same whenever the result is read.

    Rows of Parquet files are numbered by file and place in it, without a copy of them; the files have to stay as they are while the
    result is in use. File names reach the driver and are broadcast. Any other frame is written once with its numbers.
    """
    if "_metadata" not in {c.lower() for c in docs.columns} and docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        file, place = fresh(docs, "_file"), fresh(docs, "_place")
        with contextlib.suppress(AnalysisException):  # only Parquet has row_index
            placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
            files = placed.groupBy(file).agg(F.count("*").alias("n"), F.max(place).alias("last")).collect()
            if all(f.n == f.last + 1 for f in files):  # a file that is named twice has each row twice
                part = docs.sparkSession.createDataFrame([(name, i << 33) for i, name in enumerate(sorted(f[0] for f in files))], f"{file} string, {row} long")
                return placed.join(F.broadcast(part), file).select(*(f"`{c}`" for c in docs.columns), (F.col(row) + F.col(place)).alias(row))
    return written(docs.withColumn(row, F.monotonically_increasing_id()))


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more; else they stay in the shared folder until the interpreter ends."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            _remove(table.sparkSession, folder)


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of queries that nothing refers to any more; else they stay until the driver's next collection.

    Events of a query's end refer to it, so those that listeners have not seen yet are waited for, two seconds at most. What the
    gateway's threads held at the first collection is free at the second.
    """
    gc.collect()
    with contextlib.suppress(Exception):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(2000)
    for pause in (0.2, 0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def store(uri: str):
    """pyarrow's file system for a folder of the shared store, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def without(tagged: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """``tagged`` without the rows that ``gone`` (one column of row numbers) has, and without the column ``row``; texts aren't shuffled.

    Row numbers are those of :func:`numbered` or ``monotonically_increasing_id``, so they say which file or partition a row is from. The
    numbers to drop are written to a folder for each million rows of it; a task loads those of the parts it meets, one at a time.
    """
    spark = tagged.sparkSession
    base = f"{shared_dir(spark)}/gone"
    numbers = gone.toDF("n").filter("n is not null").distinct().withColumn("part", F.shiftright("n", PART_BITS))
    numbers.repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(base)
    form, names = tagged.drop(row).schema, [c for c in tagged.columns if c != row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, drop = None, np.zeros(0, np.int64)
        for batch in batches:
            at = batch.schema.get_field_index(row)
            numbers = batch.column(at).to_numpy(zero_copy_only=False)
            parts, keep = numbers >> PART_BITS, np.ones(len(numbers), bool)
            for part in np.unique(parts).tolist():
                if part != now:
                    now, drop = part, _numbers(f"{base}/part={part}")
                keep &= ~np.isin(numbers, drop)
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(kept.columns) if i != at], names)

    return tagged.mapInArrow(tidied(run), form)


def _numbers(folder: str) -> np.ndarray:
    """The column ``n`` of the Parquet files in a folder of the shared store, if it is there."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    files, path = store(folder)
    if files.get_file_info(path).type != fs.FileType.Directory:
        return np.zeros(0, np.int64)
    found = [f.path for f in files.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
    return np.concatenate([pq.ParquetFile(files.open_input_file(f)).read(["n"])["n"].to_numpy() for f in found] or [np.zeros(0, np.int64)])


def as_long(name: str) -> Column:
    return F.col(f"`{name}`").cast("long")


def lookup(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, hashed: bool = False) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row a key) without sending a hot key to one task.

    ``weight`` of ``table`` is the number of rows with the key; ``total`` their sum or more. Keys with
    at least max(total / 4096, 64) rows are broadcast: there can't be more than 4096 of them, whatever
    the input. All others are joined by shuffle, and none of them is large. ``rows`` is read twice and
    should be a written table. Null keys match nothing. With ``hashed`` the shuffled rows aren't sorted; a partition's share of
    ``table`` then has to fit in memory.
    """
    least = max(total // MAX_HOT_KEYS, 64)
    values = [c for c in table.columns if c not in on]
    mark = fresh(rows, "_hot")
    hot = table.filter(F.col(weight) >= least).withColumn(mark, F.lit(True))
    cold = table.filter(F.col(weight) < least)
    cold = cold.hint("shuffle_hash") if hashed else cold
    marked = rows.join(F.broadcast(hot), on, "left")
    rest = marked.filter(F.col(mark).isNull()).drop(mark, *values).join(cold, on, "left")
    return marked.filter(F.col(mark)).drop(mark).unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (two long columns): ``node``, ``component`` (smallest node).

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each a pre-aggregated minimum
    and a join that adaptive execution can split; the edge list is written to the shared folder after each
    round. Ends when a round changes nothing. Only DataFrame operations; nothing but counts reaches the driver.
    """
    spark = edges.sparkSession
    base = shared_dir(spark)
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v and u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(now, f"{base}/0")
    nodes = now.select(F.col("u").alias("node")).union(now.select(F.col("v").alias("node"))).distinct()
    before = None
    for turn in range(1, max_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, f"{base}/{turn}")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def batches_of(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about ``most`` bytes at most, so that working arrays stay small."""
    parts = max(1, min(batch.num_rows, -(-batch.nbytes // most)))
    step = -(-batch.num_rows // parts) if batch.num_rows else 1
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def crc_of_id(name: str) -> Column:
    """CRC-32 of an identifier written as decimal text."""
    return F.crc32(F.col(f"`{name}`").cast("string").cast("binary"))
