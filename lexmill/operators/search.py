"""Which of many strings stand in which texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items up to so many characters in all are matched by one automaton a worker; more take turns.
MOST_CHARS = 16 << 20


def contained(docs: DataFrame, items: DataFrame, key: str, text: str, item: str) -> DataFrame:
    """``key, item``: each pair of a text and a distinct item within it, once a row of ``docs`` [J21].

    An Aho-Corasick automaton finds all items in one reading of a text. Items are dealt to blocks of MOST_CHARS characters by hash;
    each block is broadcast and reads the texts once. Null texts hold nothing; the empty item stands in every text.
    """
    spark = docs.sparkSession
    words = items.filter(F.col(item).isNotNull() & (F.col(item) != ""))
    size = words.agg(F.sum(F.length(item))).first()[0] or 0
    parts = -(-size // MOST_CHARS) or 1
    slim = docs.filter(F.col(text).isNotNull()).select(key, text)
    form = f"`{key}` {dict(docs.dtypes)[key]}, `{item}` string"
    out = slim.select(key, F.lit("").alias(item)) if not items.filter(F.col(item) == "").isEmpty() else None
    for part in range(parts):
        block = words.filter(F.pmod(F.xxhash64(item), F.lit(parts)) == part).select(item).distinct()
        shared = spark.sparkContext.broadcast([r[0] for r in block.collect()])  # MOST_CHARS on average

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            finder = ahocorasick.Automaton()
            for word in shared.value:
                finder.add_word(word, word)
            if not len(finder):
                return
            finder.make_automaton()
            for batch in batches:
                at, found = [], []
                for i, value in enumerate(batch.column(1).to_pylist()):
                    here = {word for _, word in finder.iter(value)}
                    at += [i] * len(here)
                    found += here
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], [key, item])

        out = slim.mapInArrow(run, form) if out is None else out.unionByName(slim.mapInArrow(run, form))
    return out
