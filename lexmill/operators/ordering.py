"""Order made explicit: ranks and shuffles without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICES = 256


def shuffle_key(key: Column | str, seed: int | str = 0) -> Column:
    """A pseudo-random order that any engine reproduces: MD5 of seed and key [T-6]."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def _cuts(df: DataFrame, by: str) -> list:
    return df.agg(F.percentile_approx(by, [i / SLICES for i in range(1, SLICES)], 4 * SLICES).alias("c")).first()["c"] or []


def _range_of(cuts: list, by: str) -> Column:
    """The range of a value: how many of the cuts are below it."""
    cuts = sorted(set(cuts))
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(by))) if cuts else F.lit(0)


def _ranges(df: DataFrame, by: str, *then: str) -> Column:
    """A number that grows with (``by``, ``then``) and divides the rows into ranges of about equal size.

    Where a value of ``by`` holds two ranges or more, its rows are divided by the next key, if that is a number. Null is first.
    """
    kinds = dict(df.dtypes)
    if kinds[by] == "string":
        return F.coalesce(F.conv(F.substring(by, 1, 3), 16, 10).cast("long"), F.lit(-1))
    cuts = _cuts(df, by)
    part = _range_of(cuts, by).cast("long") * (SLICES + 1)
    heavy = sorted({x for x, y in zip(cuts, cuts[1:]) if x == y})
    if heavy and then and kinds[then[0]].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        tied = F.col(by).isin(heavy)
        part = part + F.when(tied, _range_of(_cuts(df.filter(tied), then[0]), then[0]) + F.when(F.col(then[0]).isNull(), 0).otherwise(1)).otherwise(0)
    return F.coalesce(part, F.lit(-1))


def running_total(df: DataFrame, weight: str, by: str, *then: str, name: str = "upto", partition: list[str] | None = None) -> DataFrame:
    """Adds the sum of ``weight`` up to and with each row, in the order of ``by`` (a number or an MD5 in hex), then ``then``.

    Ranges of the order are summed each on their own and shifted by the sums of the ranges before, so no task
    sees all rows. The offsets are a row a range. With ``partition`` the sum is within each group, which may be as large as the table.
    """
    group = partition or []
    cut = df.withColumn("_part", _ranges(df, by, *then))
    sizes = cut.groupBy(*group, "_part").agg(F.sum(weight).alias("_n"))
    order = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    within = W.partitionBy(*group, "_part").orderBy(by, *then).rowsBetween(W.unboundedPreceding, 0)
    placed = cut.withColumn("_in", F.sum(weight).over(within))
    if group:
        keys = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
        joined = placed.alias("l").join(offsets.alias("r"), _all([*keys, F.col("l._part") == F.col("r._part")]))
        return joined.select(*(f"l.{c}" for c in df.columns), (F.col("_in") + F.col("_before")).alias(name))
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_in") + F.col("_before")).alias(name))


def ranked(df: DataFrame, by: str, *then: str, name: str = "rn", partition: list[str] | None = None) -> DataFrame:
    """Adds the 0-based rank in the order of ``by``, then ``then`` (which should tell rows apart), as :func:`running_total` does."""
    one = running_total(df.withColumn("_one", F.lit(1).cast("long")), "_one", by, *then, name="_upto", partition=partition)
    return one.select(*df.columns, (F.col("_upto") - 1).cast("long").alias(name))


def lookup(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row a key) without sending a hot key to one task.

    ``weight`` of ``table`` is the number of rows with the key, ``total`` their sum or more. Keys with at least
    max(total / 4096, 64) rows are broadcast, so never more than 4096; all others are joined by shuffle.
    """
    hot = F.col(weight) >= max(total // 4096, 64)
    values = [c for c in table.columns if c not in on]
    marked = rows.join(F.broadcast(table.filter(hot).withColumn("_hot", F.lit(True))), on, "left")
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot", *values).join(table.filter(~hot), on, "left")
    return marked.filter("_hot").drop("_hot").unionByName(rest)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def evenly_spaced(df: DataFrame, limit: int, by: str, *then: str) -> DataFrame:
    """At most ``limit`` rows at places int(i * (n / limit)) of the order [F3]."""
    n = df.count()
    if limit >= n:
        return df
    wanted = df.sparkSession.range(limit).select(F.floor(F.col("id") * F.lit(n / limit)).alias("rn"))
    return ranked(df, by, *then).join(wanted, "rn", "left_semi").drop("rn")


def strided(df: DataFrame, k: int, by: str, *then: str) -> DataFrame:
    """Every n // k-th row of the order, at most k rows [F4]."""
    step = max(1, df.count() // k)
    return ranked(df, by, *then).filter((F.col("rn") % step == 0) & (F.col("rn") < step * k)).drop("rn")


def tail(df: DataFrame, n: int, by: str, *then: str) -> tuple[DataFrame, DataFrame]:
    """(all but the last ``n`` rows, the last ``n``); the first is empty if there are no more than ``n`` [W28]."""
    total, out = df.count(), ranked(df, by, *then)
    return out.filter(F.col("rn") < total - n).drop("rn"), out.filter(F.col("rn") >= total - n).drop("rn")


def first_seen(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key [W29]; the minimum is combined before the shuffle."""
    row = F.struct(*order, *(c for c in df.columns if c not in (*order, key)))
    out = df.groupBy(key).agg(F.min(row).alias("_row"))
    return out.select(*(F.col(key) if c == key else F.col(f"_row.{c}") for c in df.columns))
