"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has a word of bits at each position, one bit a language. An n-gram (three characters,
the middle one a letter, all that isn't a letter as a blank) enters the bits of its languages at ``HASHES``
positions; the AND of the words at its positions gives all languages that have it. Of a text, the n-grams
of each language are counted, the counts are corrected by the language's rate of false positives, and the
language with the largest corrected share decides.

An n-gram belongs to a language if its frequency there is at least ``SHARE`` of its largest frequency in any.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import batches_of, crc_of_id
from lexmill.llm.memo import tidied

HASHES = 3
SHARE = 0.1
LEAST = 3  # occurrences of an n-gram in a language's sample
UNKNOWN = "und"
U = np.uint64
SEED = 20240115  # of the rows to learn from
SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@functools.cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of lower-cased texts as 63-bit keys, and the bounds of each text's among them."""
    data = np.frombuffer("\n".join(["", *((t or "").lower() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[data]
    ends = np.flatnonzero(data == 10)
    if len(ends) != len(texts) + 1:  # texts with line ends of their own
        sizes = [len((t or "").lower()) + 1 for t in texts]
        ends = np.concatenate([[0], np.cumsum(sizes)])
    c = np.where(letter, data, 32).astype(np.uint64)
    keys = (c[:-2] << U(42) | c[1:-1] << U(21) | c[2:])[letter[1:-1]]
    return keys, np.concatenate([[0], np.cumsum(letter)])[ends]


def positions(keys: np.ndarray, i: int, size: int) -> np.ndarray:
    h = (keys ^ keys >> U(29)) * U(SALTS[i])
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    return ((h >> U(32)) * U(size) >> U(32)).astype(np.int64)


@dataclass
class LanguageFilter:
    """``slices``: for each group of up to 64 languages the words by position; ``rates``: false positives by language."""

    languages: list[str]
    slices: list[np.ndarray]
    rates: np.ndarray

    @classmethod
    def of(cls, languages: list[str], keys: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> LanguageFilter:
        """From the occurrences ``counts`` of n-grams ``keys`` in ``languages[owner]``."""
        if not languages:
            return cls([], [], np.zeros(0))
        totals = np.bincount(owner, counts, len(languages))
        frequency = counts / np.maximum(totals[owner], 1)
        grams, at = np.unique(keys, return_inverse=True)
        best = np.zeros(len(grams))
        np.maximum.at(best, at, frequency)
        keep = (counts >= LEAST) & (frequency >= SHARE * best[at])
        at, owner = at[keep], owner[keep]
        size = max(1 << 10, 1 << int(np.ceil(np.log2(max(1, len(grams)) * 2 * HASHES))))
        slices, rates = [], []
        for low in range(0, len(languages), 64):
            n = min(64, len(languages) - low)
            kind = next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if n <= bits)
            words, mine = np.zeros(size, kind), (owner >= low) & (owner < low + n)
            bits = np.left_shift(np.ones(mine.sum(), kind), (owner[mine] - low).astype(kind))
            for i in range(HASHES):
                np.bitwise_or.at(words, positions(grams[at[mine]], i, size), bits)
            slices.append(words)
            rates += [(words >> kind(j) & kind(1)).mean() ** HASHES for j in range(n)]
        return cls(languages, slices, np.array(rates))

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each text's n-grams that each language has, and the number of n-grams."""
        keys, bounds = ngrams(texts)
        n = np.diff(bounds)
        out = np.zeros((len(texts), len(self.languages)))
        for s, words in enumerate(self.slices):
            mask = words[positions(keys, 0, len(words))]
            for i in range(1, HASHES):
                mask &= words[positions(keys, i, len(words))]
            for j in range(min(64, len(self.languages) - 64 * s)):
                hit = np.concatenate([[0], np.cumsum(mask >> words.dtype.type(j) & words.dtype.type(1), dtype=np.int64)])
                out[:, 64 * s + j] = hit[bounds[1:]] - hit[bounds[:-1]]
        n_ = np.maximum(n, 1)[:, None]
        return np.clip((out - n_ * self.rates) / (n_ * (1 - self.rates)), 0, 1), n


def held_out(doc_id: str) -> Column:
    """CRC-32 of the identifier as text leaves 1 when divided by 3; false for a null identifier."""
    return F.coalesce(crc_of_id(doc_id) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", per_language: int = 2000) -> LanguageFilter:
    """Fits on whole texts of about ``per_language`` rows a language, each chosen by a number of its own (not by its identifier, which rows may share).

    Rows with null text or language teach nothing. The driver gets the n-grams of that bounded sample.
    """
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).filter("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter([], [], np.zeros(0))
    spark, scale = docs.sparkSession, 1 << 30
    table = spark.createDataFrame([(x, i, min(scale, scale * per_language // sizes[x] + 1)) for i, x in enumerate(languages)], "lang string, owner int, least long")
    chosen = rows.join(F.broadcast(table), "lang").filter(F.rand(SEED) * scale < F.col("least")).select("owner", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, 2 << 20):
                owner = batch.column(0).to_numpy(zero_copy_only=False)
                keys, bounds = ngrams(batch.column(1).to_pylist())
                of = np.repeat(owner, np.diff(bounds))
                for o in np.unique(owner):
                    k, n = np.unique(keys[of == o], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), o, np.int32)), pa.array(k.view(np.int64)), pa.array(n, pa.int64())], ["owner", "gram", "n"])

    grams = chosen.mapInArrow(tidied(count), "owner int, gram long, n long").groupBy("owner", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST).toArrow()
    owner, keys, n = (grams.column(c).to_numpy() for c in ("owner", "gram", "n"))
    return LanguageFilter.of(languages, keys.view(U), owner.astype(np.int64), n.astype(np.float64))


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and the share of n-grams that it has (0 to 1).

    ``und`` with 0 for a null text or one without a letter, or if no language was learnt. Of equal shares the
    first language in order of name wins. The filter is broadcast; its size is bounded by the sample's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    form = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, 2 << 20):
                share, n = shared.value.shares(batch.column(at).cast(pa.string()).to_pylist())
                best = share.argmax(axis=1) if share.shape[1] else np.zeros(len(n), np.int64)
                known = (n > 0) & bool(share.shape[1])
                names_ = np.array([*shared.value.languages, UNKNOWN], object)
                pred = names_[np.where(known, best, len(names_) - 1)]
                score = np.where(known, share[np.arange(len(n)), best] if share.shape[1] else 0.0, 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, *names])

    at = docs.columns.index(text)
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return docs.mapInArrow(tidied(run), StructType([*form.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def identify(docs: DataFrame, per_language: int = 2000) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; learns only from rows that aren't held out.

    Of documents only text is an input of a prediction. Null identifiers are not held out; repeated rows are
    predicted each; an empty table gives an empty table.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(slim.filter(~held_out("doc_id")), per_language=per_language)
    return predict(slim.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model).drop("text")


def accepted(docs: DataFrame, least: float = 0.2, per_language: int = 2000, text: str = "text") -> DataFrame:
    """``docs`` without those whose language isn't known: no letters, or less than ``least`` of their n-grams in the best language.

    Learns from all rows with a language (a bounded sample of them). Columns stay as they were.
    """
    from lexmill.llm.common import fresh

    pred, score = fresh(docs, "_lang"), fresh(docs, "_score")
    model = fit(docs, per_language=per_language, text=text)
    return predict(docs, model, text, (pred, score)).filter((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).drop(pred, score)
