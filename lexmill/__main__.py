"""python -m lexmill COMMAND: reports over corpora, decoding, diarization, scores, gold sheets and a registry [C1, C2, C3, C6, G18, G25].

Training and export of networks stay outside the engine.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import cer, rounded, wer
from lexmill.operators import gold, kernels, language_model, quality, registry
from lexmill.sources import audio, manifests


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexmill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("probe", "what a corpus holds and which gates it breaks"), ("feasibility", "whether utterances have the frames that CTC needs"), ("lm", "a pruned character n-gram table")):
        s = sub.add_parser(name, help=what)
        s.add_argument("--csv")
        s.add_argument("--corpus", action="append")
        s.add_argument("--folder", default=".")
        s.add_argument("--limit", type=int)
        s.add_argument("--out")
        s.add_argument("--order", type=int, default=6)
    s = sub.add_parser("models", help="versions, current, previous and best of each architecture")
    s.add_argument("action", choices=["list", "show", "publish", "promote", "rollback"])
    s.add_argument("folder", help="list: a Parquet table of arch, published, score; all others: the registry's folder")
    s.add_argument("--architecture")
    s.add_argument("--version")
    s.add_argument("--score", type=float)
    s = sub.add_parser("transcribe", help="texts of a Parquet table of frames (utt, frame, logp)")
    s.add_argument("posteriors")
    s.add_argument("--symbols", required=True, help="characters in the order of their numbers; the blank follows them")
    s.add_argument("--decoder", choices=["greedy", "beam"], default="beam")
    s.add_argument("--out")
    s = sub.add_parser("diarize", help="who speaks when in a folder of WAV files")
    s.add_argument("folder")
    s.add_argument("--speakers", type=int)
    s.add_argument("--out")
    s = sub.add_parser("evaluate", help="error rates of a Parquet or JSON table (reference, hypothesis)")
    s.add_argument("table")
    s.add_argument("--by")
    s.add_argument("--out")
    s = sub.add_parser("gold", help="clips to transcribe by hand, their sheet, and scores of drafts")
    s.add_argument("action", choices=["select", "sheet", "score"])
    s.add_argument("clips", help="Parquet table: select: rec, idx, clip; sheet: clip; score: reference, hypothesis")
    s.add_argument("--first")
    s.add_argument("--second")
    s.add_argument("--n", type=int, default=100)
    s.add_argument("--scratch", type=int, default=0)
    s.add_argument("--out")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lexmill").getOrCreate()
    if args.command == "models" and args.action == "list":
        rows = registry.auto_promoted(registry.numbered(spark.read.parquet(args.folder), "arch", "published"), "arch", "score", "published")
        if args.architecture:
            rows = rows.filter(F.col("arch") == args.architecture)
        show(registry.state(rows, "arch", "version", "published").join(registry.best(rows, "score", "version", ["arch"]), "arch", "left"))
        return 0
    if args.command == "models":
        if args.action == "publish":
            registry.publish(spark, args.folder, args.architecture, args.score)
        elif args.action == "promote":
            registry.promote(spark, args.folder, args.architecture, args.version)
        elif args.action == "rollback":
            registry.rollback(spark, args.folder, args.architecture)
        print(json.dumps(registry.shown(spark, args.folder, args.architecture)))
        return 0
    if args.command in BODIES:
        out = BODIES[args.command](spark, args)
        if args.out:
            out.write.mode("overwrite").json(args.out)
        else:
            show(out)
        return 0
    df = manifests.dataset(spark, args.folder, args.corpus, args.csv, args.limit)
    if args.command == "lm":
        from lexmill.functions.text import folded

        table = language_model.pruned(language_model.counts(df.select(folded(F.col("text")).alias("line")).filter("line <> ''"), order=args.order))
        if args.out:
            manifests.save_ngrams(table, args.out)
        show(language_model.describe(table))
        return 0
    seconds = df if "seconds" in df.columns else df.withColumn("seconds", F.lit(0.0))
    seconds = seconds.withColumn("seconds", F.col("seconds").cast("double"))
    out = quality.probe(seconds) if args.command == "probe" else quality.feasibility_report(seconds)
    show(out)
    if args.command == "probe":
        show(quality.gates(out))
    if args.out:
        manifests.report(out, args.out)
    return 0


def transcribe(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    decode = kernels.decoder(args.decoder, dict(enumerate(args.symbols)), len(args.symbols))
    return kernels.decoded(spark.read.parquet(args.posteriors), decode)


def diarize(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    clips = audio.decoded(manifests.files(spark, args.folder).select("path", "content")).filter("clip.error is null")
    found = kernels.diarized(clips.select(F.col("path").alias("rec_id"), F.lit(16000).alias("sample_rate"), F.col("clip.samples").alias("samples")), speakers=args.speakers)
    return found.select("rec_id", "speaker", *rounded({"start_s": 3, "end_s": 3}))


def evaluate(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    rows = spark.read.json(args.table) if args.table.endswith((".json", ".jsonl")) else spark.read.parquet(args.table)
    rows = rows.withColumn("w", wer(F.col("reference"), F.col("hypothesis"))).withColumn("c", cer(F.col("reference"), F.col("hypothesis")))
    return rows.groupBy(*([args.by] if args.by else [])).agg(F.count("*").alias("clips"), F.bround(F.avg("w"), 4).alias("wer"), F.bround(F.avg("c"), 4).alias("cer"))


def gold_commands(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    clips = spark.read.parquet(args.clips)
    if args.action == "select":
        return gold.select(clips, "rec", "idx", "clip", args.n, scratch=args.scratch)
    if args.action == "sheet":
        return gold.sheet(clips, spark.read.parquet(args.first), spark.read.parquet(args.second), "clip")
    return gold.score(clips, {"ALL": F.lit(True)})


BODIES = {"transcribe": transcribe, "diarize": diarize, "evaluate": evaluate, "gold": gold_commands}


def show(df) -> None:
    for row in df.limit(1000).collect():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))


if __name__ == "__main__":
    raise SystemExit(main())
