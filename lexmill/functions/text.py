"""Column functions over transcripts. Row ids of the inventory are in brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The vocabulary of the acoustic labels, blank last.
BASE_SYMBOLS = [" ", "'", "ɛ", "ɔ", *"abcdefghijklmnopqrstuvwxyz"]
DIGITS = list("0123456789")
#: Typographic marks and what they fold to; letters that look like those of the alphabet.
FOLD_FROM, FOLD_TO = "’‘ʼ´–— ", "''''-- "
LOOKALIKE_FROM, LOOKALIKE_TO = "ↄↃℇ", "ɔƆɛ"
#: Prefixes of run names that may be discarded; columns by role, in order of preference.
DISPOSABLE = "^(smoke|verify|demo|download)-"
TEXT_COLUMNS = ["text", "sentence", "transcription", "transcript", "label"]
AUDIO_COLUMNS = ["audio_path", "audio", "path", "file", "filename", "wav", "filepath"]
#: Parts of names whose values are secret, the pattern of secret values and what replaces them.
SECRET_NAMES = "token|hf_token|auth_token|api_key|secret|password|access_token"
SECRET_VALUES = r"\b(?:hf_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_\-]{20,}|gh[pousr]_[A-Za-z0-9]{20,})"
REDACTED = "[REDACTED]"

#: Spellings that mark the other dialect; a sentence that drafts hallucinate; marks of a scored sheet;
#: parts of messages about access, and where such a message names a repository.
DIALECT_MARKERS = r"dz|\bebien|\benyim|\bekyir|\bebiasa|\bebaasa"
HALLUCINATIONS = ["na sane firi wɔn so kɔ soro"]
SKIP_MARK, UNSURE_MARK = "[skip]", "[?]"
ACCESS_ERRORS = "401|403|gated|authenticat|not accessible|unauthorized"
GATED = [r"Access to model ([\w\-.]+/[\w\-.]+) is restricted", r"huggingface\.co/([\w\-.]+/[\w\-.]+)/resolve/"]


def symbols(digits: bool = True) -> list[str]:
    """The symbols without the blank, whose index is their number [D6, G2]."""
    return BASE_SYMBOLS + (DIGITS if digits else [])


def fold(text: Column) -> Column:
    """Typographic marks to plain ones [X1]."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def spoken(text: Column, digits: bool = True) -> Column:
    """Folded, lower-cased, without characters beyond the vocabulary [X2, before the lookup]."""
    return F.regexp_replace(F.lower(fold(text)), f"[^a-z{'0-9' if digits else ''}ɛɔ' ]", "")


def characters(text: Column) -> Column:
    """The characters of a text; none of an empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def encode(text: Column, digits: bool = True) -> Column:
    """Label array of a text [X2, J14]."""
    alphabet = F.lit("".join(symbols(digits)))
    return F.transform(characters(spoken(text, digits)), lambda c: F.instr(alphabet, c) - 1)


def decode(labels: Column, digits: bool = True) -> Column:
    """Text of a label array; blanks and unknown labels are dropped [X3]."""
    alphabet = F.array(*map(F.lit, symbols(digits)))
    n = len(symbols(digits))
    return F.array_join(F.transform(F.filter(labels, lambda i: (i >= 0) & (i < n)), lambda i: F.element_at(alphabet, i + 1)), "")


def folded(text: Column, digits: bool = True) -> Column:
    """The round trip through the vocabulary, trimmed [X4]."""
    return F.trim(spoken(text, digits))


def code_switch(text: Column) -> Column:
    """Quotes and lookalikes folded, other marks to blanks, stray apostrophes out, blanks collapsed [X5]."""
    plain = F.regexp_replace(F.lower(F.translate(fold(text), LOOKALIKE_FROM, LOOKALIKE_TO)), "[^a-z0-9ɛɔ' ]", " ")
    inner = F.regexp_replace(F.regexp_replace(plain, "(?<![a-z0-9ɛɔ])'+", " "), "'+(?![a-z0-9ɛɔ])", " ")
    return F.trim(F.regexp_replace(inner, " +", " "))


def dedup_key(text: Column) -> Column:
    """Stripped, lower-cased, white space collapsed [X6]."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), " +", " ")


def lookalikes(text: Column) -> Column:
    """Number of lookalike letters [X7]."""
    return F.length(text) - F.length(F.translate(text, LOOKALIKE_FROM, ""))


def words(text: Column) -> Column:
    """Words between white space; none of a blank text."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def adjacent_equal(items: Column) -> Column:
    """Number of neighbours that are equal."""
    n = F.size(items)
    return F.when(n > 1, F.size(F.filter(F.zip_with(F.slice(items, 1, n - 1), F.slice(items, 2, n - 1), lambda a, b: a == b), lambda x: x))).otherwise(0)


def minimum_frames(items: Column) -> Column:
    """Frames that CTC needs: one an item and a blank between equal neighbours [W11]."""
    return F.size(items) + adjacent_equal(items)


def minimum_frames_of(text: Column) -> Column:
    """The same of a text's characters, without making an array of them [W11]."""
    return F.length(text) + F.regexp_count(text, F.lit(r"(?s)(.)(?=\1)"))


def encoder_frames(seconds: Column, rate: int = 16000, hop: int = 160, subsampling: int | Column = 4) -> Column:
    """Frames truncated first, then subsampled by floor division [X11]."""
    step = F.lit(subsampling) if isinstance(subsampling, int) else subsampling
    return F.floor(F.floor(seconds * rate / hop) / step).cast("int")


def frames_to_seconds(frames: Column, rate: int = 16000, hop: int = 160, subsampling: int = 4) -> Column:
    """[X12]; its inverse at one frame is X13."""
    return frames * (hop * subsampling / rate)


def subsampling(architecture: Column) -> Column:
    """Subsampling factor by architecture [K16]."""
    return F.when(architecture.startswith("conformer"), 4).otherwise(2)


def timestamp(seconds: Column) -> Column:
    """mm:ss.s [X14]; null stays null."""
    whole = F.floor(seconds / 60)
    return F.when(seconds.isNotNull(), F.format_string("%02d:%04.1f", whole.cast("long"), seconds - whole * 60))


def transcript_line(speaker: Column, text: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """A line of a transcript, with times or without [X15]."""
    if start is None:
        return F.concat(speaker, F.lit(": "), text)
    return F.concat(F.lit("["), timestamp(start), F.lit(" - "), timestamp(end), F.lit("] "), speaker, F.lit(": "), text)


def rounded(fields: dict[str, int]) -> list[Column]:
    """Columns by name to so many digits, halves to even [X16, T8]: seconds of segments and turns, scores of utterances."""
    return [F.bround(F.col(name), digits).alias(name) for name, digits in fields.items()]


def chars_per_second(text: Column, seconds: Column) -> Column:
    """[X26]; 0 for no time."""
    return F.when(seconds > 0, F.length(text) / seconds).otherwise(0.0)


def implausible_rate(rate: Column, low: float = 2.0, high: float = 25.0) -> Column:
    """[F7]"""
    return ~rate.between(low, high)


def human_bytes(size: Column, largest: str = "TB") -> Column:
    """[X22] in units up to ``largest``; halves to even, as C and Python print them. Null stays null."""
    units = [("KB", 10), ("MB", 20), ("GB", 30), ("TB", 40)]
    units = units[: [u for u, _ in units].index(largest) + 1]
    out = None
    for unit, power in reversed(units):
        some = F.format_string(f"%.1f {unit}", F.bround(size / 2.0**power, 1))
        out = some if out is None else F.when(size < 2.0 ** (power + 10), some).otherwise(out)
    return F.when(size < 1024, F.format_string("%d B", size.cast("long"))).when(size.isNotNull(), out)


def log_sum_exp(a: Column, b: Column) -> Column:
    """[X17]; minus infinity is neutral."""
    high, low = F.greatest(a, b), F.least(a, b)
    none = F.lit(float("-inf"))
    return F.when(low == none, high).otherwise(high + F.log1p(F.exp(low - high)))


def levenshtein_words(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of word arrays [X8]: each distinct word of the pair becomes one character."""
    names = F.array_distinct(F.concat(reference, hypothesis))
    # from U+4E00 up to the surrogates, and past them from U+E000
    code = lambda i: F.when(i < 35000, i + 19968).otherwise(i - 35000 + 57344)
    coded = lambda ws: F.decode(F.unhex(F.array_join(F.transform(ws, lambda w: F.lpad(F.hex(code(F.array_position(names, w))), 4, "0")), "")), "UTF-16BE")
    return F.levenshtein(coded(reference), coded(hypothesis))


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word error rate of two texts; an empty reference gives 0 or 1 [X9]."""
    r, h = words(reference), words(hypothesis)
    return F.when(F.size(r) == 0, (F.size(h) > 0).cast("double")).otherwise(levenshtein_words(r, h) / F.size(r))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate of two texts, trimmed [X10]."""
    r, h = F.trim(reference), F.trim(hypothesis)
    return F.when(F.length(r) == 0, (F.length(h) > 0).cast("double")).otherwise(F.levenshtein(r, h) / F.length(r))


def agreement(greedy: Column, beam: Column) -> Column:
    """[X27]"""
    return F.when(F.length(F.trim(beam)) == 0, 0.0).otherwise(1 - F.least(F.lit(1.0), cer(beam, greedy)))


def redacted(params: Column) -> Column:
    """A map without secrets, by name and by value [F22]."""
    hidden = lambda k, v: F.lower(k).rlike(SECRET_NAMES) & (v != "")
    return F.transform_values(params, lambda k, v: F.when(hidden(k, v), F.lit(REDACTED)).otherwise(F.regexp_replace(v, SECRET_VALUES, REDACTED)))


def dialect_marker(text: Column) -> Column:
    """[F18]"""
    return F.lower(text).rlike(DIALECT_MARKERS)


def usable_draft(text: Column, least: int = 3) -> Column:
    """Enough words and no known hallucination [F6]."""
    none = F.lit(True)
    for h in HALLUCINATIONS:
        none = none & ~F.contains(F.lower(text), F.lit(h))
    return (F.size(words(text)) >= least) & none


def scoreable(text: Column) -> Column:
    """Not skipped and not empty after folding; unsure marks are blanks [F13]."""
    return ~F.contains(text, F.lit(SKIP_MARK)) & (folded(F.replace(text, F.lit(UNSURE_MARK), F.lit(" "))) != "")


def access_error(message: Column) -> Column:
    """[G14]"""
    return F.lower(message).rlike(ACCESS_ERRORS)


def gated_repositories(message: Column) -> Column:
    """Repositories that a message about access names, each once [X28]."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(message, F.lit(p), F.lit(1)) for p in GATED)))


def speaker_key(value: Column) -> Column:
    """328.0 as 328 [F20]."""
    return F.regexp_replace(F.trim(value.cast("string")), r"\.0$", "")


def basename(path: Column) -> Column:
    """Last part of a path with either separator [J11, J13]."""
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def parent(path: Column) -> Column:
    """Name of the folder that holds a file [J13]."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def resolved(path: Column, folder: str) -> Column:
    """Relative paths below a folder [S3]."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))


def spec_name(spec: Column) -> Column:
    """The repository of ``name[:split]``; the last colon divides [S7]."""
    return F.when(F.instr(spec, ":") > 0, F.regexp_extract(spec, "^(.*):[^:]*$", 1)).otherwise(spec)


def spec_split(spec: Column, default: str = "train") -> Column:
    """The split of ``name[:split]``; the default if empty [S7]."""
    found = F.regexp_extract(spec, ":([^:]*)$", 1)
    return F.when(found == "", F.lit(default)).otherwise(found)


def cosine(a: Column, b: Column) -> Column:
    """[X25]"""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(a: Column) -> Column:
    """A vector divided by its length."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    return F.transform(a, lambda v: v / norm)


def greedy_ctc(best: Column, blank: int) -> Column:
    """Collapses repeats, then drops blanks [W9]."""
    kept = F.filter(best, lambda x, i: (i == 0) | (x != F.element_at(best, F.greatest(i, F.lit(1)))))
    return F.filter(kept, lambda x: x != blank)


def arg_max(posteriors: Column) -> Column:
    """Index of the first maximum [W10]."""
    return (F.array_position(posteriors, F.array_max(posteriors)) - 1).cast("int")


def padded(labels: Column, length: Column, fill: int = 0) -> Column:
    """[K14]"""
    return F.concat(labels, F.array_repeat(F.lit(fill), F.greatest(length - F.size(labels), F.lit(0)).cast("int")))


def decibels(mean_square: Column) -> Column:
    """[X24]"""
    return 20 * F.log10(F.sqrt(F.greatest(mean_square, F.lit(1e-12))))
