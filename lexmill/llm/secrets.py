"""Secret scans: fixed patterns, and a battery of randomness tests for what the patterns miss.

All of it is DataFrame operations. The positions of a pattern's matches come from marks: each match is put
between two marks, the text is divided at the first, and lengths add up. (Marks that a text has itself are first
exchanged for another character that no pattern knows.)

Battery. A candidate is a maximal run of at least ``LEAST`` characters of the base64 alphabets that has a digit
and a letter, or of at least ``LEAST_LETTERS`` without a digit. Its encoding is the smallest alphabet that holds all of it. Under the hypothesis that its symbols
are uniform and independent there are three p-values: chi-squared over the alphabet, runs above and below the
middle of the alphabet, and serial correlation at lag one, combined by Fisher's method. Random strings have
uniform p-values, ordinary ones small p-values, the smaller the longer they are. So in each class of encoding and length the number of random
strings follows from the p-values above a bound (``TAILS``, lower for longer strings), and with it the share of ordinary ones among those at or above
any threshold; the lowest threshold at which that false-discovery rate is at most ``rate`` decides, whether or not a string has
just that p-value. A class with few strings leans on all lengths of its encoding (as if ``LEAN`` strings more). What has a
p-value in the lowest bin is never reported. A class is known by a histogram of ``BINS`` p-values, combined before any shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.llm.common import fresh, written

#: Fixed patterns and what a match must have, by kind.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the maximal runs of [0-9a-f] that are long enough
KINDS = ["assign", "access", "hex", "random"]

LEAST, LEAST_LETTERS, BINS, LEAN = 16, 24, 100, 2
#: With padding only where no further run follows: '=' also divides a name from its value.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:=+(?![A-Za-z0-9+/_=-]))?"
LENGTHS = [24, 32, 48, 64, 128]  # bounds of the length classes
TAILS = [0.5, 0.3, 0.1, 0.05, 0.05, 0.05]  # by length class: ordinary strings hardly ever have a p-value above

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet on; the order of symbols is that of their values.
ENCODINGS = {
    "hex": DIGITS + LOWER[:6],
    "HEX": DIGITS + UPPER[:6],
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "mixed": UPPER + LOWER + DIGITS + "+/-_",
}
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"


def matches(text: Column, pattern: str) -> Column:
    """Array of (n, m): lengths between marks and the matched strings; the first entry is the length before a first match."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}"))
    parts = F.split(marked, OPEN)
    found = F.transform(parts, lambda x, i: F.struct(F.length(x).alias("n"), F.when(i > 0, F.substring_index(x, CLOSE, 1)).alias("m")))
    return F.when(F.size(parts) > 1, found)


def spans(rows: DataFrame, column: str) -> DataFrame:
    """``row, start, end, m`` of each match in an array of :func:`matches`."""
    parts = rows.filter(F.col(column).isNotNull()).select("row", F.posexplode(column).alias("i", "x"))
    # a piece after the first has one mark more than text
    taken = F.col("x.n") - (F.col("i") > 0).cast("int")
    before = F.sum(taken).over(W.partitionBy("row").orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    return parts.select("row", "i", before.cast("long").alias("start"), F.col("x.m").alias("m")).filter("i > 0").select("row", "start", (F.col("start") + F.length("m")).alias("end"), "m")


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a logistic of a cubic (error under 0.0002)."""
    x = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return 1 / (1 + F.exp(1.5976 * x + 0.070565992 * x * x * x))


def both_tails(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * upper_tail(F.abs(z)))


def battery(candidates: DataFrame) -> DataFrame:
    """``candidates`` (column ``m``) with ``encoding``, ``length``, ``p_chi``, ``p_runs``, ``p_serial`` and ``p`` (Fisher); other columns stay."""
    names = {x: fresh(candidates, f"_{x}") for x in ("body", "alphabet", "size", "chars", "values")}
    body, alphabet, chars, values = (F.col(f"`{names[x]}`") for x in ("body", "alphabet", "chars", "values"))
    kinds = [(name, f"^[{a.replace('-', '')}{'-' * ('-' in a)}]+$") for name, a in ENCODINGS.items()]
    encoding = reduce(lambda rest, k: F.when(body.rlike(k[1]), F.lit(k[0])).otherwise(rest), reversed(kinds), F.lit(None).cast("string"))
    letters = reduce(lambda rest, k: F.when(F.col("encoding") == k, F.lit(ENCODINGS[k])).otherwise(rest), ENCODINGS, F.lit(None).cast("string"))
    out = candidates.withColumn(names["body"], F.regexp_replace("m", "=+$", "")).withColumn("encoding", encoding).withColumn(names["alphabet"], letters)
    out = out.withColumn("length", F.length(body)).withColumn(names["size"], F.length(alphabet)).withColumn(names["chars"], F.filter(F.split(body, ""), lambda c: c != ""))
    out = out.withColumn(names["values"], F.transform(chars, lambda c: F.instr(alphabet, c).cast("double")))
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow((F.col("length") - F.length(F.replace(body, c, F.lit("")))).cast("double"), F.lit(2.0)))
    n, k = F.col("length").cast("double"), F.col(f"`{names['size']}`").cast("double")
    chi = k / n * squares - n
    out = out.withColumn("p_chi", upper_tail((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))))
    first, second = F.slice(values, 1, F.col("length") - 1), F.slice(values, 2, F.col("length") - 1)
    high = lambda x: x > (k + 1) / 2
    changes = F.size(F.filter(F.zip_with(first, second, lambda x, y: high(x) != high(y)), lambda x: x))
    n1 = F.size(F.filter(values, high)).cast("double")
    n2 = n - n1
    mean = 2 * n1 * n2 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    out = out.withColumn("p_runs", F.when(var > 0, both_tails((changes + 1 - mean) / F.sqrt(F.when(var > 0, var)))).otherwise(F.lit(1e-12)))
    middle = (k + 1) / 2
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    spread = (k * k - 1) / 12
    serial = total(F.zip_with(first, second, lambda x, y: (x - middle) * (y - middle))) / (spread * F.sqrt(n - 1))
    out = out.withColumn("p_serial", both_tails(serial))
    logs = -(F.log(F.greatest("p_chi", F.lit(1e-12))) + F.log(F.greatest("p_runs", F.lit(1e-12))) + F.log(F.greatest("p_serial", F.lit(1e-12))))
    fisher = F.exp(-logs) * (1 + logs + logs * logs / 2)
    return out.withColumn("p", fisher).drop(*names.values())


def thresholds(tested: DataFrame, rate: float) -> DataFrame:
    """``encoding, size_class, least``: the lowest bin, above the first, at which the false-discovery rate holds, if there is one."""
    group = ["encoding", "size_class"]
    counts = tested.groupBy(*group, "bin").agg(F.count("*").alias("n"))
    tail = F.element_at(F.array(*map(F.lit, TAILS)), F.col("size_class") + 1)
    above = F.sum(F.when(F.col("bin") >= F.round(BINS * tail), F.col("n")).otherwise(0) / (1 - tail))
    # all that follows has a row a class or a bin of one: len(ENCODINGS) * (len(LENGTHS) + 1) * BINS at most
    classes = counts.groupBy(*group).agg(above.alias("random"), F.sum("n").alias("all"))
    kind = W.partitionBy("encoding")
    pooled = F.least(F.sum("random").over(kind) / F.sum("all").over(kind), F.lit(1.0))
    share = F.least((F.col("random") + LEAN * pooled) / (F.col("all") + LEAN), F.lit(1.0))
    classes = classes.select(*group, (share * F.col("all")).alias("random"), F.explode(F.sequence(F.lit(1), F.lit(BINS - 1))).alias("bin"))
    grid = classes.join(counts, [*group, "bin"], "left")
    found = grid.withColumn("at_or_above", F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy(*group).orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)))
    false_rate = 1 - F.col("random") * (1 - F.col("bin") / BINS) / F.col("at_or_above")
    return found.filter((F.col("at_or_above") > 0) & (false_rate <= rate)).groupBy(*group).agg(F.min("bin").alias("least"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: float = 0.1) -> DataFrame:
    """One row a document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Spans are kind:start:end in code points, end exclusive, ordered by start and then by kind (assign, access,
    hex, random). Null text is empty: no spans, and the hash of the empty string. A random span is reported if
    no base span contains it. Repeated rows and null identifiers get a row each. What is shuffled is matches.
    """
    clean = F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), OPEN + CLOSE, OTHER + OTHER)
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), clean.alias("t"))
    rows = written(slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", matches(F.col("t"), ASSIGN).alias("assign"), matches(F.col("t"), ACCESS).alias("access"), matches(F.col("t"), HEX).alias("hex"), matches(F.col("t"), RUN).alias("random")))
    value = F.regexp_extract("m", ASSIGN, 2)
    found = spans(rows, "assign").filter(F.length(value) >= 6).withColumn("kind", F.lit(0))
    found = found.unionByName(spans(rows, "access").filter(F.length("m") >= 20).withColumn("kind", F.lit(1)))
    found = found.unionByName(spans(rows, "hex").withColumn("kind", F.lit(2))).select("row", "start", "end", "kind")
    candidates = spans(rows, "random").filter(F.col("m").rlike("[A-Za-z]") & (F.col("m").rlike("[0-9]") | (F.length("m") >= LEAST_LETTERS)))
    size_class = sum((F.col("length") >= x).cast("int") for x in LENGTHS)
    tested = battery(candidates).withColumn("size_class", size_class).withColumn("bin", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int"))
    tested = written(tested.select("row", "start", "end", "encoding", "size_class", "bin").filter("encoding is not null"))
    # a row a class: at most len(ENCODINGS) * (len(LENGTHS) + 1)
    passed = tested.join(F.broadcast(thresholds(tested, rate)), ["encoding", "size_class"]).filter("bin >= least").select("row", "start", "end", F.lit(3).alias("kind"))
    both = found.unionByName(passed).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("x"))
    base = F.filter("x", lambda s: s["kind"] < 3)
    both = both.withColumn("base", base)
    inside = lambda s: F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    both = both.withColumn("x", F.filter("x", lambda s: (s["kind"] < 3) | ~inside(s)))
    name = F.array(*map(F.lit, KINDS))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    both = both.select("row", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), joined("base").alias("base"), joined("x").alias("spans"))
    out = rows.select("row", "doc_id").join(both, "row", "left")
    zero, none = F.lit(0).cast("long"), F.lit("")
    return out.select("doc_id", F.coalesce("n_assign", zero).alias("n_assign"), F.coalesce("n_access", zero).alias("n_access"), F.coalesce("n_hex", zero).alias("n_hex"), F.sha2(F.coalesce("base", none), 256).alias("base_sha256"), F.coalesce("spans", none).alias("spans"))
