"""Published versions, promotions and what may be removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def score(wer: str = "wer", cer: str = "cer", loss: str = "val_loss"):
    """The first metric there is [W26, T21]."""
    return F.coalesce(wer, cer, loss)


def numbered(publications: DataFrame, arch: str, *order: str) -> DataFrame:
    """``version`` v001, v002, ... in order of publication [W21]."""
    rn = F.row_number().over(W.partitionBy(arch).orderBy(*order))
    return publications.withColumn("version", F.format_string("v%03d", rn))


def next_version(versions: DataFrame, arch: str, version: str = "version") -> DataFrame:
    """The highest numeric suffix plus one [W21]."""
    number = F.when(F.col(version).rlike(r"^v\d+$"), F.substring(version, 2, 20).cast("long"))
    return versions.groupBy(arch).agg(F.format_string("v%03d", F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_version"))


def auto_promoted(publications: DataFrame, arch: str, score: str, *order: str) -> DataFrame:
    """Adds ``promoted``: the first version, then those with a score strictly below all before [W22].

    An unscored version never beats a scored one; a score beats an unscored current version.
    """
    before = W.partitionBy(arch).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    first = F.count("*").over(before) == 0
    best = F.min(score).over(before)
    return publications.withColumn("promoted", first | F.coalesce(F.col(score) < best, F.lit(False)) | (F.col(score).isNotNull() & best.isNull() & ~first))


def state(promoted: DataFrame, arch: str, version: str, *order: str) -> DataFrame:
    """``current``, ``previous`` and number of promotions of each architecture [W23, W24]."""
    rows = promoted.filter("promoted").groupBy(arch).agg(F.max_by(F.struct(version), F.struct(*order)).alias("c"), F.count("*").alias("promotions"))
    ranked = promoted.filter("promoted").withColumn("_r", F.row_number().over(W.partitionBy(arch).orderBy(*(F.desc(o) for o in order))))
    second = ranked.filter("_r = 2").select(arch, F.col(version).alias("previous"))
    return rows.select(arch, F.col(f"c.{version}").alias("current"), "promotions").join(second, arch, "left")


def best(versions: DataFrame, score: str, version: str, by: list[str] | None = None) -> DataFrame:
    """Version with the least score; the first of equals [A31]."""
    return versions.filter(F.col(score).isNotNull()).groupBy(*(by or [])).agg(F.min_by(version, F.struct(score, version)).alias("best"))


def epochs(rows: DataFrame, run: str, epoch: str, score: str, *order: str) -> DataFrame:
    """``run, best_epoch, mean, logged``: the epoch of the least score (the first of equals), the mean score and the number of even epochs [A37, A38, W30].

    The mean adds up in the order of ``order``, which tells rows apart: partial sums differ in the last digit with the partitions.
    """
    upto = W.partitionBy(run).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumn("_sum", F.sum(score).over(upto)).withColumn("_n", F.count("*").over(upto))
    least = F.when(F.col(epoch).isNotNull(), F.struct(F.col(score).isNull(), F.col(score), F.col(epoch)))
    mean = F.max_by("_sum", "_n") / F.count(score)
    return summed.groupBy(run).agg(F.min_by(epoch, least).alias("best_epoch"), F.when(F.count(score) > 0, mean).alias("mean"), F.count(F.when(F.col(epoch) % 2 == 0, 1)).alias("logged"))


def resolve(current: DataFrame, versions: DataFrame, arch: str, score: str, version: str) -> DataFrame:
    """One row: the promoted version of the first architecture in name order, else the best [W25, T24]."""
    promoted = current.filter("current is not null").agg(F.min_by("current", arch).alias("p"))
    return promoted.crossJoin(best(versions, score, version)).select(F.coalesce("p", "best").alias("served"))  # one row each


def fold_history(events: list[tuple[str, str | None]], versions: set[str]) -> tuple[str | None, list[str]]:
    """Applies ('promote', version) and ('rollback', None) in order; returns the current version and the history [W23, T23].

    A promotion that repeats the last is not entered again. A rollback serves the last version before that still
    exists, but takes only one entry off.
    """
    current, history = None, []
    for what, version in events:
        if what == "promote":
            current = version
            if not history or history[-1] != version:
                history.append(version)
        else:
            target = next((v for v in reversed(history[:-1]) if v in versions), None)
            if target is None:
                raise LookupError("no earlier promoted version")
            history.pop()
            current = target
    return current, history


def incompatible(recorded: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """Settings that differ; null on either side is compatible [J20]."""
    a, b = recorded.withColumnRenamed(value, "recorded"), wanted.withColumnRenamed(value, "wanted")
    return a.join(b, key).filter("recorded <> wanted")


def duplicate_files(files: DataFrame, published: DataFrame, protected: DataFrame) -> DataFrame:
    """Files of protected runs whose digest is that of a published version [J12, G8]."""
    return files.join(protected.select("run_id").distinct(), "run_id", "left_semi").join(published.dropDuplicates(["digest"]), "digest")


def resolve_checkpoint(explicit: str | None, promoted: str | None, runs: DataFrame | None = None, default: str | None = None) -> str | None:
    """The checkpoint to load: the named one, else the promoted, else the newest of ``runs`` (path, modified, is_best), else a default [W27].

    Of files of one time a run's best goes before its last.
    """
    if explicit or promoted:
        return explicit or promoted
    newest = runs.agg(F.max_by("path", F.struct("modified", "is_best"))).first()[0] if runs is not None else None
    return newest or default


def removal_plan(runs: DataFrame, protected: DataFrame, keep: DataFrame) -> DataFrame:
    """``run_id, reason, bytes`` of runs that may go: disposable names, then runs without a result [A32, U5, C6]. Nothing is deleted.

    ``runs`` has run_id, status and bytes; protected and kept runs never appear.
    """
    from lexmill.functions.text import DISPOSABLE

    held = protected.select("run_id").union(keep.select("run_id")).distinct()
    reason = F.when(F.col("run_id").rlike(DISPOSABLE), "disposable").when(F.col("status") != "finished", "unfinished")
    return runs.join(held, "run_id", "left_anti").withColumn("reason", reason).filter("reason is not null").select("run_id", "reason", "bytes")


EVENTS = "arch string, event string, version string, score double, at long"


def events(spark, folder: str) -> DataFrame:
    """The history of a registry kept as a folder of Parquet files, a row an event; empty where there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(EVENTS).parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], EVENTS)


def _entered(spark, folder: str, arch: str, event: str, version: str, score: float | None, at: int) -> None:
    spark.createDataFrame([(arch, event, version, score, at)], EVENTS).coalesce(1).write.mode("append").parquet(folder)


def _of(spark, folder: str, arch: str) -> tuple[list, str | None, list[str]]:
    """Events of an architecture in order (a model family has few), its current version and the promotions that hold."""
    rows = events(spark, folder).filter(F.col("arch") == arch).orderBy("at").collect()
    published = {r.version for r in rows if r.event == "publish"}
    current, history = fold_history([(r.event, r.version if r.event == "promote" else None) for r in rows if r.event != "publish"], published)
    return rows, current, history


def publish(spark, folder: str, arch: str, score: float | None = None) -> str:
    """Enters the next version [W21] and promotes it if it is the first or beats all scores before [W22]; returns its name."""
    rows, current, _ = _of(spark, folder, arch)
    before = [r for r in rows if r.event == "publish"]
    version = f"v{1 + max((int(r.version[1:]) for r in before), default=0):03d}"
    at = rows[-1]["at"] + 1 if rows else 0
    _entered(spark, folder, arch, "publish", version, score, at)
    known = [r.score for r in before if r.score is not None]
    if not before or score is not None and (not known or score < min(known)):
        _entered(spark, folder, arch, "promote", version, None, at + 1)
    return version


def promote(spark, folder: str, arch: str, version: str) -> None:
    """Serves a published version; an unknown one is an error."""
    rows, _, _ = _of(spark, folder, arch)
    if version not in {r.version for r in rows if r.event == "publish"}:
        raise LookupError(f"{arch} has no version {version!r}")
    _entered(spark, folder, arch, "promote", version, None, rows[-1]["at"] + 1)


def rollback(spark, folder: str, arch: str) -> str:
    """Serves the version promoted before [W23, T23]; an error if there is none."""
    rows, _, history = _of(spark, folder, arch)
    published = {r.version for r in rows if r.event == "publish"}
    target = next((v for v in reversed(history[:-1]) if v in published), None)
    if target is None:
        raise LookupError(f"{arch} has no earlier promoted version")
    _entered(spark, folder, arch, "rollback", target, None, rows[-1]["at"] + 1)
    return target


def shown(spark, folder: str, arch: str) -> dict:
    """Current version, promotions that hold and all versions with their scores."""
    rows, current, history = _of(spark, folder, arch)
    return {"arch": arch, "current": current, "history": history, "versions": {r.version: r.score for r in rows if r.event == "publish"}}
