"""Batches, caps, quotas and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.operators.ordering import ranked, running_total, shuffle_key


class LeakError(ValueError):
    """Two sides that must be disjoint share keys, or a rule that must remove rows removed none."""


def bucketed_batches(df: DataFrame, key: str, length: str, batch_size: int, pool_factor: int = 64, seed: int = 0, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """Adds ``pool`` and ``batch``: shuffled by hash, cut into pools, sorted by length in a pool, cut into batches [W14, P8].

    ``batch_order`` is the shuffled order of batches. The epoch is explicit (T20). A pool is bounded by its
    size, so its window is too.
    """
    pool = max(batch_size, batch_size * pool_factor)
    keyed = df.withColumn("_k", shuffle_key(key, f"{seed}.{epoch}"))
    at = ranked(keyed, "_k", key).withColumn("pool", F.floor(F.col("rn") / pool))
    rank = F.row_number().over(W.partitionBy("pool").orderBy(length, "rn")) - 1
    out = at.withColumn("batch", (F.col("pool") * -(-pool // batch_size) + F.floor(rank / batch_size)).cast("long"))
    if drop_last:
        out = out.withColumn("_n", F.count("*").over(W.partitionBy("batch"))).filter(F.col("_n") == batch_size).drop("_n")
    return out.withColumn("batch_order", shuffle_key("batch", f"{seed}.{epoch}")).drop("_k", "rn")


def sequential_batches(df: DataFrame, key: str, batch_size: int) -> DataFrame:
    """Batches in the given order, which is no shuffle (T19) [W15]."""
    return ranked(df, key).withColumn("batch", F.floor(F.col("rn") / batch_size)).drop("rn")


def capped(df: DataFrame, group: str, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows a group, in shuffled order [W16].

    A group is cut to candidates in slices of the hash before its rank is taken, so a hot group
    isn't sorted by one task: a slice passes on its first ``most`` rows.
    """
    keyed = df.withColumn("_k", shuffle_key(key, seed)).withColumn("_s", F.substring("_k", -2, 2))
    some = keyed.withColumn("_r", F.row_number().over(W.partitionBy(group, "_s").orderBy("_k", key))).filter(F.col("_r") <= most)
    return some.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy("_k", key))).filter(F.col("_r") <= most).drop("_k", "_s", "_r")


def shuffled_head(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The first ``n`` rows of the shuffled order [W16]."""
    return df.withColumn("_k", shuffle_key(key, seed)).orderBy("_k", key).limit(n).drop("_k")


def top_fraction(df: DataFrame, score: str, key: str, fraction: float) -> DataFrame:
    """The int(n * fraction) best rows [W17]."""
    n = int(df.count() * fraction)
    return ranked(df.withColumn("_s", -F.col(score)), "_s", key).filter(F.col("rn") < n).drop("_s", "rn")


def square_root_quota(sizes: DataFrame, group: str, count: str, n: int) -> DataFrame:
    """Quotas in proportion to the square root of group sizes, by largest remainder; ties by name [A20]. A row a group."""
    total = sizes.agg(F.sum(F.sqrt(count)).alias("w"))
    raw = sizes.crossJoin(F.broadcast(total)).withColumn("raw", n * F.sqrt(count) / F.col("w")).withColumn("base", F.floor("raw"))  # one row
    left = raw.agg((F.lit(n) - F.sum("base")).alias("left"))
    open_ = raw.crossJoin(F.broadcast(left)).withColumn("_by", -F.round(F.col("raw") - F.col("base"), 9))  # one row
    out = ranked(open_, "_by", group, name="_r")
    return out.select(group, count, (F.col("base") + (F.col("_r") < F.col("left")).cast("long")).alias("quota"))


def speaker_split(df: DataFrame, speaker: str, dev: float, test: float, seed: int = 0) -> DataFrame:
    """Adds ``split``: whole speakers to test, then dev, then train, in shuffled order [W19, T30].

    A split takes a speaker if it stays within 1.25 of its quota and isn't full. Speakers of up to a quarter of the
    quota always fit while it isn't full, so a running total decides on them; the others are at most 4 / share in
    number, and only they reach the driver.
    """
    sizes = df.groupBy(speaker).agg(F.count("*").alias("n")).withColumn("_k", shuffle_key(speaker, seed))
    total = df.count()
    parts = []
    for name, share in (("test", test), ("dev", dev)):
        told = _taken(sizes, speaker, share * total)
        parts.append(told.filter("taken").select(speaker, F.lit(name).alias("split")))
        sizes = told.filter("not taken").drop("taken")
    return df.join(parts[0].unionByName(parts[1]), speaker, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def _taken(sizes: DataFrame, speaker: str, quota: float) -> DataFrame:
    """Adds ``taken`` to speakers (``n`` rows, order ``_k``): whether they enter a split of so many rows."""
    small = F.col("n") <= quota / 4
    run = running_total(sizes.withColumn("_w", F.when(small, F.col("n")).otherwise(0)), "_w", "_k", speaker, name="_upto")
    run = run.withColumn("_before", F.col("_upto") - F.col("_w"))
    large = run.filter(~small).select(F.col(speaker).alias("who"), "_k", "n", "_before").orderBy("_k", "who").collect() if quota > 0 else []
    inside, extra = [], 0
    for r in large:
        if r["_before"] + extra < quota and r["_before"] + extra + r["n"] <= quota * 1.25:
            inside.append(r)
            extra += r["n"]
    later = [F.when((F.col("_k") > r["_k"]) | ((F.col("_k") == r["_k"]) & (F.col(speaker) > r["who"])), F.lit(r["n"])).otherwise(0) for r in inside]
    before = reduce(lambda x, y: x + y, later, F.col("_before"))
    named = reduce(lambda x, y: x | y, [F.col(speaker).eqNullSafe(F.lit(r["who"])) for r in inside], F.lit(False))
    return run.withColumn("taken", F.when(small, before < quota).otherwise(named)).drop("_w", "_upto", "_before")


def treatments(df: DataFrame, key: str, scratch: int, seed: int = 0) -> DataFrame:
    """Fixed counts in random order: ``scratch`` rows none, half of the rest whisper, the others conformer [W20]."""
    n = df.count()
    rest = n - scratch
    at = ranked(df.withColumn("_k", shuffle_key(key, seed)), "_k", key)
    return at.withColumn("treatment", F.when(F.col("rn") < scratch, "none").when(F.col("rn") < scratch + rest // 2, "whisper").otherwise("conformer")).drop("_k", "rn")


def frozen_split(df: DataFrame, clip: str, speaker: str, old: DataFrame) -> DataFrame:
    """Adds ``split`` from an earlier build (``clip, speaker, split``) [J10].

    A clip of the old dev or test stays there; else a clip goes to train unless its speaker was in dev or
    test: such clips are excluded. Missing frozen clips are an error.
    """
    frozen = old.filter("split <> 'train'").select(F.col("clip").alias(clip), F.col("split").alias("_clip_split")).distinct()
    # the later of a speaker's splits in the order train, dev, test holds
    rank = F.when(F.col("split") == "test", 2).when(F.col("split") == "dev", 1).otherwise(0)
    held = old.groupBy(F.col("speaker").alias(speaker)).agg(F.max(rank).alias("_held"))
    out = df.join(frozen, clip, "left").join(held, speaker, "left")
    split = F.when(F.col("_clip_split").isNotNull(), F.col("_clip_split")).when(F.coalesce("_held", F.lit(0)) == 0, "train").otherwise("excluded")
    out = out.withColumn("split", split)
    want, got = frozen.count(), out.filter("_clip_split is not null").select(clip).distinct().count()
    if want != got:
        raise LeakError(f"the frozen splits have {want} clips, of which {got} are here")
    return out.drop("_clip_split", "_held")


def excluded(df: DataFrame, other: DataFrame, on: list[str], must_remove: bool = False) -> DataFrame:
    """Rows without a partner [J4, J5, J6, U3]; with ``must_remove`` it is an error if none goes."""
    if must_remove and df.join(other, on, "left_semi").isEmpty():
        raise LeakError(f"excluding by {on} removed no row")
    return df.join(other.select(*on).distinct(), on, "left_anti")


def shared_keys(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Keys on both sides [J9, J19, U2]."""
    return a.select(*on).intersect(b.select(*on))


def disjoint(a: DataFrame, b: DataFrame, on: list[str]) -> None:
    """An error if a key is on both sides [J9]."""
    if not shared_keys(a, b, on).isEmpty():
        raise LeakError(f"both sides have rows with the same {on}")


def complete(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    """``df``, or an error if a looked-up column is null [J2, J3]."""
    missing: Column = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    if not df.filter(missing).isEmpty():
        raise LeakError(f"{what}: rows without {columns}")
    return df


def spaced(pdf, index: str, order: str, quota: int, gap: int):
    """Greedy choice of rows in ``order`` whose ``index`` is at least ``gap`` from all chosen, up to ``quota`` [W18]."""
    import bisect

    taken, rows = [], []
    for at, i in enumerate(pdf.sort_values(order)[index]):
        if len(rows) >= quota:
            break
        k = bisect.bisect_left(taken, i)
        if (k == len(taken) or taken[k] - i >= gap) and (k == 0 or i - taken[k - 1] >= gap):
            taken.insert(k, i)
            rows.append(at)
    return pdf.sort_values(order).iloc[rows]
