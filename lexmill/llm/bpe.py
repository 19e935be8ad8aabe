"""BPE by an index from each pair to all its positions.

The words of a batch that aren't known yet lie in one linked list of symbols. An index maps the rank of each
adjacent pair that can merge to the positions where it stands, and a heap has the active ranks. The lowest
rank is taken with all its positions, from left to right; each merge links its neighbours anew and enters the
two pairs it makes. A word in which a merge makes a pair of lower rank waits: its further positions of the
present rank go back to the index. So every word sees its merges in the order of the plain algorithm.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import batches_of
from lexmill.llm.memo import Memo, divided, gathered

MAX_CHUNKS, MAX_WORDS = 200_000, 400_000
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = regex.compile(f"[{SPACE}]+")
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LETTERS = regex.compile(f"[{LATIN}]+")  # composed already, and lowered letter by letter
ODD = r"[\x1c-\x1f\x{85}\x{180e}\x{200b}-\x{200d}\x{2060}\x{feff}]"  # white space to some, not to others


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Merges:
    """The merges of a vocabulary: ``ranks`` has pair (left << 32 | right) to (rank, merged symbol)."""

    def __init__(self, ranks: dict[int, tuple[int, int]]):
        self.rank = {pair: rank for pair, (rank, _) in ranks.items()}
        self.parts = {rank: (pair >> 32, pair & 0xFFFFFFFF, merged) for pair, (rank, merged) in ranks.items()}
        self.pairs = np.array(sorted(self.rank), np.int64)
        self.rank_of = np.array([self.rank[p] for p in self.pairs.tolist()], np.int64)

    def first(self, symbols: np.ndarray, last: np.ndarray) -> dict[int, list[int]]:
        """Positions by the rank of the pair that stands there; none begins at the end of a word."""
        if not len(self.pairs) or len(symbols) < 2:
            return {}
        pairs = symbols[:-1] << 32 | symbols[1:]
        distinct, code = np.unique(pairs, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pairs, distinct), len(self.pairs) - 1)
        rank = np.where(self.pairs[at] == distinct, self.rank_of[at], -1)[code]
        rank[last[last < len(rank)]] = -1
        places = np.flatnonzero(rank >= 0)
        order = np.argsort(rank[places], kind="stable")
        places, rank = places[order], rank[places][order]
        begins = np.flatnonzero(np.diff(rank, prepend=-1))
        ends = [*begins[1:].tolist(), len(rank)]
        flat = places.tolist()
        return {r: flat[i:j] for r, i, j in zip(rank[begins].tolist(), begins.tolist(), ends)}

    def apply(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges words that lie one after the other, as BPE does: all their symbols, and how many each has."""
        rank_of, parts = self.rank.get, self.parts
        bounds = np.cumsum(sizes)
        some = sizes > 0
        last = bounds[some] - 1
        places = self.first(symbols, last)
        links = np.arange(1, len(symbols) + 1)
        links[last] = -1
        after = links.tolist()
        links = np.arange(-1, len(symbols) - 1)
        links[(bounds - sizes)[some]] = -1
        before = links.tolist()
        owners = np.repeat(np.arange(len(sizes)), sizes)
        owner = owners.tolist()
        symbol = symbols.tolist()
        symbol.append(-2)  # what follows the end of a word
        heap = list(places)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            at_rank = places.pop(rank, None)
            if not at_rank:
                continue
            left_symbol, right_symbol, merged = parts[rank]
            high = merged << 32
            waiting: set[int] = set()
            back = []
            at_rank.sort()
            for at in at_rank:
                right = after[at]
                if symbol[at] != left_symbol or symbol[right] != right_symbol:
                    continue
                if waiting and owner[at] in waiting:
                    back.append(at)
                    continue
                symbol[at] = merged
                symbol[right] = -1
                after[at] = follow = after[right]
                if follow >= 0:
                    before[follow] = at
                    r = rank_of(high | symbol[follow])
                    if r is not None:
                        if r in places:
                            places[r].append(at)
                        else:
                            places[r] = [at]
                            heapq.heappush(heap, r)
                        if r < rank:
                            waiting.add(owner[at])
                previous = before[at]
                if previous >= 0:
                    r = rank_of(symbol[previous] << 32 | merged)
                    if r is not None:
                        if r in places:
                            places[r].append(previous)
                        else:
                            places[r] = [previous]
                            heapq.heappush(heap, r)
                        if r < rank:
                            waiting.add(owner[at])
            if back:
                if rank in places:
                    places[rank] += back
                else:
                    places[rank] = back
                    heapq.heappush(heap, rank)
        symbol.pop()
        left = np.array(symbol, np.int64)
        kept = left >= 0  # a merged symbol stands where its first part did
        return left[kept], np.bincount(owners[kept], minlength=len(sizes))


def merge_words(words: list[list[int]], ranks: dict[int, tuple[int, int]]) -> list[list[int]]:
    """Applies ``ranks`` to each word."""
    flat, sizes = Merges(ranks).apply(np.array([x for w in words for x in w], np.int64), np.array([len(w) for w in words], np.int64))
    ends = np.cumsum(sizes)
    return [flat[i:j].tolist() for i, j in zip((ends - sizes).tolist(), ends.tolist())]


class WordBPE:
    """A lower-casing word BPE with an end-of-word suffix, from a tokenizer's JSON file.

    Text: the strings of added tokens are cut out first; the rest is composed (NFC), divided at white space,
    lowered character by character and divided into words by the file's pattern.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or model["type"] != "BPE" or spec["decoder"]:
            raise ValueError(f"{path} isn't a word BPE of the kind this class reads")
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"].replace(r"[^\s", f"[^{SPACE}"))
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet])
        self.final = np.array([vocab[c + suffix] for c in alphabet])
        ranks: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.merges = Merges(ranks)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = token.encode()
        self.names = pa.array(self.tokens, pa.large_binary())
        self.added = {k: np.array([v], "<u4").tobytes() for k, v in added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        every = "".join(filter(LETTERS.fullmatch, map(chr, range(256)))).lower()
        self.whole = LETTERS.fullmatch if self.pattern.findall(every) == [every] else lambda _: None
        self.memo, self.words = Memo(self._learn, MAX_CHUNKS), Memo(self._merge, MAX_WORDS)

    def _chunks(self, text: str) -> list[str]:
        return [x for x in SPACES.split(text) if x]

    def _words(self, chunk: str) -> list[str]:
        if self.whole(chunk):
            return [chunk.lower()]
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        chunk = "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()
        return self.pattern.findall(chunk)

    def _learn(self, chunks: list[str]) -> list[bytes]:
        return self.words.joined([self._words(c) for c in chunks])

    def _merge(self, words: list[str]) -> list[bytes]:
        # a symbol is a byte; the byte that ends the word has the suffix
        coded = list(map(str.encode, words))
        data = np.frombuffer(b"".join(coded), np.uint8)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        symbols, last = self.inner[data], np.cumsum(sizes) - 1
        symbols[last] = self.final[data[last]]
        ids, sizes = self.merges.apply(symbols, sizes)
        data, ends = ids.astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
        return [data[i:j] for i, j in zip([0, *ends], ends)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        out: list = [b""] * len(texts)
        plain = []
        odd = pc.match_substring_regex(pa.array(texts, pa.string()), ODD).to_pylist()
        for i, t in enumerate(texts):
            if t and self.cut and "<|" in t and len(parts := self.cut.split(t)) > 1:
                out[i] = b"".join(self.added.get(x) or b"".join(self.memo.values(self._chunks(x))) for x in parts)
            elif t and odd[i]:
                out[i] = b"".join(self.memo.values(self._chunks(t)))
            elif t:
                plain.append(i)
        if plain:
            # a word never crosses from a letter to a mark, and white space is dropped
            cut = pc.replace_substring_regex(pa.array([texts[i] for i in plain], pa.string()), r"([A-Za-z])([.,!?;:])", r"\1 \2")
            pieces, codes, bounds = divided(pc.utf8_split_whitespace(cut))
            values = [b"" if x == "" else None for x in pieces]
            known = iter(self.memo.values([x for x in pieces if x]))
            for i, ids in zip(plain, gathered([next(known) if v is None else v for v in values], codes, bounds)):
                out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens joined by spaces (the file has no decoder), in UTF-8; added tokens are kept."""
        return self.decoded([ids.astype("<u4").tobytes()])[0]

    def decoded(self, coded: list[bytes]) -> list[bytes]:
        """What :meth:`encode` gives, as :meth:`decode` has it."""
        bounds = np.cumsum([0, *map(len, coded)]) // 4
        ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int64)
        rows = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), self.names.take(pa.array(ids)))
        return pc.binary_join(rows, pa.scalar(b" ", pa.large_binary())).to_pylist()


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


def encode_decode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", keep_output: bool = False) -> DataFrame:
    """One row a document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; with ``keep_output`` also ``ids`` and ``decoded``.

    Null and empty texts have no tokens and decode to the empty string. Rows are independent: repeated rows
    and null identifiers pass through, and there is no shuffle. The pair index covers the new words of a
    batch of the partition; a bounded cache has what was encoded before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_bpe(tokenizer)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for whole in batches:
            for batch in batches_of(whole, 1 << 22):
                coded = model.encode(batch.column(1).to_pylist())
                decoded = model.decoded(coded)
                cols = [batch.column(0), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(map(sha, coded), pa.string()), pa.array(map(sha, decoded), pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_output:
                    cols += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in coded], pa.list_(pa.int32())), pa.array([x.decode() for x in decoded], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_output)
