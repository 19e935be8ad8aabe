"""The tokenizers library behind a bounded cache of pieces, for byte-level BPE."""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from lexmill.llm.bpe import byte_alphabet
from lexmill.llm.memo import Memo, divided, gathered

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

from tokenizers import Tokenizer  # noqa: E402

MAX_PIECES, MAX_WORDS = 1_300_000, 700_000
JOINED = 200  # new pieces that the library gets as one text
SETTLED = "\u052f"
ALPHABET = dict(enumerate(byte_alphabet()))
#: Fixed: the words of byte-level pre-tokenisation, here of pieces with a NUL between them.
PATTERN = regex.compile(r"\0|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\0]+|\s+(?![^\s\0])|\s+")
#: A space before white space, a control or format character, or the end: there a text isn't cut; or a NUL.
UNSAFE = r"\x00| (?:[\s\x00-\x20\x7f-\x{a0}\x{ad}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]|$)"

#: Further cuts, by a NUL: between a letter and a mark, and around a line end between visible characters. Words never cross them.
CUTS = ((r"([A-Za-z])([.,!?;:])", "\\1\0\\2"), (r"([!-~])\n([!-~])", "\\1\0\n\0\\2"))


class PieceEncoder:
    """Encodes texts as the library does, each distinct piece once.

    Byte-level pre-tokenisation attaches a single space to what follows it, so a cut before a space that
    is followed by a visible character never divides a token. Texts with other spaces, or with the string
    of an added token, go to the library whole. A new piece is divided into words by the pattern of byte-level
    pre-tokenisation, and the library's model encodes each new word; pieces with characters beyond SETTLED,
    whose classes differ between Unicode versions, go through all of the library instead.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        names = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.unsafe = "|".join([UNSAFE, *names])  # in RE2's syntax
        plain = [(i, t.content) for i, t in self.library.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.fence = plain[0] if plain else None
        spec = json.loads(self.library.to_str())
        front = spec["pre_tokenizer"]
        self.by_word = spec["normalizer"] is None and front == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": front.get("trim_offsets"), "use_regex": True}
        if self.by_word and hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # words come here once
        self.memo, self.words = Memo(self._learn, MAX_PIECES), Memo(self._encode_words, MAX_WORDS)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Pieces have no added token in them, so one of these between them keeps them apart in a longer text."""
        if not self.fence:
            return self._library(pieces)
        out, (fence, between) = [], self.fence
        for ids in self._library([between.join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)]):
            ids = np.frombuffer(ids, "<u4")
            data, at = ids.tobytes(), 0
            for end in (*np.flatnonzero(ids == fence).tolist(), len(ids)):
                out.append(data[4 * at : 4 * end])
                at = end + 1
        return out

    def _learn(self, pieces: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._pieces(pieces)
        rare = [i for i, x in enumerate(pieces) if not x.isascii() and max(x) > SETTLED]
        odd = set(rare)
        found = PATTERN.findall("\0".join(["" if i in odd else x for i, x in enumerate(pieces)] if rare else pieces))
        coded = pa.array(found, pa.string()).dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.flatnonzero(codes == words.index("\0")) if "\0" in words else np.zeros(0, np.int64)
        values = iter(self.words.values([w for w in words if w != "\0"]))
        out = gathered([b"" if w == "\0" else next(values) for w in words], codes, np.concatenate([[0], ends, [len(codes)]]))
        for i, ids in zip(rare, self._pieces([pieces[i] for i in rare]) if rare else []):
            out[i] = ids
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        encode = self.library.model.tokenize
        mapped = "\0".join(words).encode().decode("latin-1").translate(ALPHABET).split(ALPHABET[0])
        return [array("I", [t.id for t in encode(w)]).tobytes() for w in mapped]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        unsafe = pc.match_substring_regex(texts, self.unsafe)
        out: list = [b""] * len(texts)
        odd = np.flatnonzero(unsafe.to_numpy(zero_copy_only=False)).tolist()
        for i, ids in zip(odd, self._library(texts.take(pa.array(odd)).to_pylist()) if odd else []):
            out[i] = ids
        plain = np.flatnonzero(~unsafe.to_numpy(zero_copy_only=False)).tolist()
        if plain:
            marked = texts.filter(pc.invert(unsafe)) if odd else texts
            if self.by_word:
                for pattern, cut in CUTS:
                    marked = pc.replace_substring_regex(marked, pattern, cut)
            parts, codes, bounds = divided(pc.split_pattern(pc.replace_substring(marked, " ", "\0 "), "\0"))
            for i, ids in zip(plain, gathered(self.memo.values(parts), codes, bounds)):
                out[i] = ids
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
