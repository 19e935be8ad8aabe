"""Sources and sinks: manifests, corpora, label files, logs."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import AUDIO_COLUMNS, TEXT_COLUMNS
from lexmill.operators.ordering import running_total


class SourceError(ValueError):
    """A source lacks what it must have, or more than one was named [G5, S17]."""


def column_for(df: DataFrame, role: str, candidates: list[str], explicit: str | None = None, exact: bool = False) -> str:
    """The column for a role: the explicit name, else the first candidate there is, in their order [S2].

    Names are compared without case and outer blanks unless ``exact``.
    """
    if explicit:
        if explicit not in df.columns:
            raise SourceError(f"no {role} column {explicit!r} among {df.columns}")
        return explicit
    have = {c if exact else c.strip().lower(): c for c in df.columns}
    found = next((have[c] for c in candidates if c in have), None)
    if found is None:
        raise SourceError(f"no {role} column among {df.columns}; one of {candidates} is needed")
    return found


def manifest(spark: SparkSession, path: str, audio: str | None = None, text: str | None = None) -> DataFrame:
    """A CSV manifest: all strings, blanks stay empty, columns ``audio_path`` and ``text`` first [S1, D1]."""
    return named(spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path), audio, text)


def named(df: DataFrame, audio: str | None = None, text: str | None = None) -> DataFrame:
    """A table as a manifest [D2]; extra columns follow."""
    a, t = column_for(df, "audio", AUDIO_COLUMNS, audio), column_for(df, "text", TEXT_COLUMNS, text)
    if a == t:
        raise SourceError(f"column {a!r} can't be both audio and text")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (a, t) and c not in ("audio_path", "text")]
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return df.select(blank(a).alias("audio_path"), blank(t).alias("text"), *rest)


def translations(spark: SparkSession, path: str, candidates: list[str], last: bool = True, label: str | None = None) -> DataFrame:
    """One text column of a CSV: a candidate, else the last or first column; blank rows go [S18, S19, S23]."""
    df = spark.read.option("header", True).csv(path)
    try:
        name = column_for(df, "text", candidates)
    except SourceError:
        name = df.columns[-1 if last else 0]
    out = df.select(F.trim(F.col(f"`{name}`")).alias("line")).filter("line <> ''")
    return out.withColumn("label", F.lit(label)) if label else out


def parse_spec(spec: str, default: str = "train") -> tuple[str, str]:
    """``name[:split]``, divided at the last colon; an empty split is the default [S7]."""
    name, colon, split = spec.rpartition(":")
    return (name, split or default) if colon else (spec, default)


def corpus(spark: SparkSession, spec: str, folder: str, default: str = "train") -> DataFrame:
    """A corpus split stored as Parquet below ``folder/<name>/<split>``, "/" in a name as "__" [S8, D3]."""
    name, split = parse_spec(spec, default)
    path = f"{folder.rstrip('/')}/{name.replace('/', '__')}/{split}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise SourceError(f"{spec}: nothing at {path}")
    return spark.read.parquet(path)


def corpora(spark: SparkSession, specs: list[str], folder: str, default: str = "train") -> list[DataFrame]:
    """[S9]"""
    return [corpus(spark, s, folder, default) for s in specs]


def combined(parts: list[DataFrame]) -> DataFrame:
    """Bag union with the order of parts as ``corpus_ord``; columns that a part lacks are null [U1, D4]."""
    if not parts:
        raise SourceError("no corpus")
    tagged = [p.withColumn("corpus_ord", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def dataset(spark: SparkSession, folder: str, specs: list[str] | None = None, csv: str | None = None, limit: int | None = None) -> DataFrame:
    """Exactly one source, named by the caller [S10, S17]; ``limit`` takes evenly spaced rows [F3]."""
    if bool(specs) == bool(csv):
        raise SourceError("name one source: corpora or a CSV manifest")
    df = manifest(spark, csv) if csv else combined(corpora(spark, specs, folder))
    if limit:
        from lexmill.operators.ordering import evenly_spaced

        key = "_row"
        df = evenly_spaced(df.withColumn(key, F.monotonically_increasing_id()), limit, key).drop(key)
    return df


def files(spark: SparkSession, folder: str, suffix: str = ".wav") -> DataFrame:
    """Files of a folder tree by suffix: ``path, length, content``; content is read only if used [S16, S15]."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "length", "content")


def audio_bytes(df: DataFrame, audio: str = "audio", by_path: DataFrame | None = None) -> DataFrame:
    """Adds ``content``: the struct's bytes, else those of the file at its path [S14]."""
    inline = df.withColumn("_inline", F.col(f"{audio}.bytes"))
    if by_path is None:
        return inline.withColumnRenamed("_inline", "content")
    table = by_path.select(F.col("path").alias("_path"), F.col("content").alias("_file"))
    return inline.join(table, inline[f"{audio}.path"] == table["_path"], "left").withColumn("content", F.coalesce("_inline", "_file")).drop("_inline", "_file", "_path")


def rows_at(df: DataFrame, key: str, wanted: list, content: str = "content") -> DataFrame:
    """The rows with the wanted keys [S6], with ``error``: why a wanted row can't be used, null if it can.

    A key that isn't there gives a row of nulls, a row without content says so; neither ends the run. The keys
    are a literal list, pushed to the scan as a filter.
    """
    kind = dict(df.dtypes)[key]
    keys = list(dict.fromkeys(wanted))
    asked = df.sparkSession.createDataFrame([(k,) for k in keys], f"`_wanted` {kind}")
    found = F.broadcast(asked).join(df.filter(F.col(key).isin(keys)), F.col("_wanted") == F.col(key), "left")
    error = F.when(F.col(key).isNull(), "no such row").when(F.col(content).isNull(), "no audio")
    return found.withColumn("error", error).withColumn(key, F.col("_wanted")).drop("_wanted")


def preview(df: DataFrame, order: str, n: int = 3, text: str | None = None) -> DataFrame:
    """The text column and the first ``n`` rows of it [S30]; their number is the feature."""
    name = column_for(df, "text", TEXT_COLUMNS, text)
    return df.select(order, F.lit(name).alias("text_column"), F.col(f"`{name}`").alias("text")).orderBy(order).limit(n)


def sheet(cells: DataFrame, wanted: list[str], row: str = "row_no", values: str = "cells") -> DataFrame:
    """Columns by header name from a sheet given as rows of cells [S25]: the first row that has all names is the header.

    Names are compared without case and outer blanks; rows before the header and blank rows go; a sheet without such a row is an error.
    """
    clean = F.transform(values, lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    names = [w.strip().lower() for w in wanted]
    found = cells.filter(F.size(F.array_intersect(clean, F.array(*map(F.lit, names)))) == len(set(names))).agg(F.min(F.struct(F.col(row).alias("at"), clean.alias("header"))).alias("x")).first()["x"]
    if found is None:
        raise SourceError(f"no row of the sheet has all of {wanted}")
    at = {name: list(found["header"]).index(name) for name in names}
    out = cells.filter(F.col(row) > found["at"]).select(row, *(F.trim(F.get(F.col(values), at[n])).alias(w) for w, n in zip(wanted, names)))
    blank = reduce(lambda x, y: x & y, [F.coalesce(F.col(f"`{w}`"), F.lit("")) == "" for w in wanted])
    return out.filter(~blank)


def conll(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of ``token TAG`` lines with blank lines between them [S20, D25].

    Lines end in any way, and a line of white space is blank. A sentence's number is the running count of blank
    lines in its file, so a file is read in as many splits as it has.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")]
    rows = spark.read.text(path).select(*place, F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))
    rows = rows.withColumn("blank", (F.col("line") == "").cast("long"))
    told = running_total(rows, "blank", "block", "n", name="sentence", partition=["file"]).filter("blank = 0")
    word = F.struct("block", "n", F.split("line", r"\s+")[0].alias("token"))
    found = told.groupBy("file", "sentence").agg(F.sort_array(F.collect_list(word)).alias("words"))
    return found.select(F.array_join(F.transform("words", lambda x: x["token"]), " ").alias("line"))


def labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(results, skipped) of a label file; lines that aren't JSON go [D21, S34]."""
    rows = spark.read.schema("index long, path string, teacher string, text string, score double, seconds double, skipped string").option("mode", "DROPMALFORMED").json(path)
    return rows.filter("teacher is not null").drop("skipped"), rows.filter("teacher is null and skipped is not null").select("index", "path", "skipped")


def run_index(spark: SparkSession, path: str) -> DataFrame:
    """The log of runs; malformed lines are skipped and columns may appear over time [S40, D20]."""
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows with the union of their columns [S38, D19]."""
    return spark.read.json(path)


def save_split(df: DataFrame, folder: str, split: str = "split") -> None:
    """Parquet by split, in the loader's layout; a target that isn't empty is refused [S32, S33]."""
    df.write.mode("errorifexists").partitionBy(split).parquet(folder)


def save_manifest(df: DataFrame, folder: str, columns: list[str]) -> None:
    """CSV of chosen columns [S35, S42]."""
    df.select(*columns).write.mode("errorifexists").option("header", True).csv(folder)


def append_labels(df: DataFrame, folder: str, key: str = "path") -> int:
    """Appends rows whose key isn't there yet, as JSON lines; returns how many [S34, J6, Z1]."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    new = df
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        done = spark.read.schema(df.schema).json(folder).select(key).distinct()
        new = df.join(done, key, "left_anti")
    n = new.count()
    if n:
        new.write.mode("append").json(folder)
    return n


def save_ngrams(ngrams: DataFrame, folder: str) -> None:
    """[S37]"""
    ngrams.write.mode("errorifexists").parquet(folder)


def ngrams_json(ngrams: DataFrame) -> DataFrame:
    """One JSON object a context: ``{"context": ..., "counts": {ch: n}}`` [S37]."""
    table = ngrams.groupBy("context").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ch", "n")))).alias("counts"))
    return table.select(F.to_json(F.struct("context", "counts")).alias("value"))


def report(df: DataFrame, path: str) -> None:
    """A small summary as a JSON file, put in place at once [S36, S41]; the table must be an aggregate."""
    rows = [r.asDict(recursive=True) for r in df.limit(10_000).collect()]
    put(path, json.dumps(rows, ensure_ascii=False, indent=2, default=str))


def put(path: str, text: str) -> None:
    """Writes a file of the driver by a temporary name and a rename [S39, S41]."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(part, path)


class RunLog:
    """Metrics and artifacts of a run in a folder of the driver; as a context, a failure is recorded [G21, S38, S39, S40]."""

    def __init__(self, folder: str, run_id: str, **params):
        from datetime import datetime

        self.folder, self.run_id, self.began = f"{folder}/{run_id}", run_id, datetime.now()
        self.index = f"{folder}/runs.jsonl"
        self.put("params.json", json.dumps(redacted(params), ensure_ascii=False, default=str))

    def put(self, name: str, text: str) -> None:
        put(f"{self.folder}/{name}", text)

    def log(self, **row) -> None:
        with open(f"{self.folder}/metrics.jsonl", "a", encoding="utf-8") as f:
            f.write(json.dumps(row, ensure_ascii=False, default=str) + "\n")

    def finish(self, status: str = "finished") -> None:
        from datetime import datetime

        row = {"run_id": self.run_id, "status": status, "seconds": round((datetime.now() - self.began).total_seconds(), 3)}
        with open(self.index, "a", encoding="utf-8") as f:
            f.write(json.dumps(row) + "\n")

    def __enter__(self) -> RunLog:
        return self

    def __exit__(self, kind, *rest) -> None:
        self.finish("failed" if kind else "finished")


def redacted(params: dict) -> dict:
    """Parameters without secrets, at any depth [F22]."""
    import re

    from lexmill.functions.text import REDACTED, SECRET_NAMES, SECRET_VALUES

    def clean(v):
        if isinstance(v, dict):
            return redacted(v)
        if isinstance(v, (list, tuple)):
            return type(v)(map(clean, v))
        return re.sub(SECRET_VALUES, REDACTED, v) if isinstance(v, str) else v

    return {k: REDACTED if v and not isinstance(v, dict) and re.search(SECRET_NAMES, k.lower()) else clean(v) for k, v in params.items()}


def blocks(df: DataFrame, n: int) -> Iterator[list]:
    """Rows of a table in lists of ``n``, one list on the driver at a time."""
    held = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held
