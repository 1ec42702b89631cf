"""Filters, joins, set operations, ranking and sampling over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import io

BROADCAST_ROWS = 1_000_000
#: Rows that running sums take in one pass, a key a task; beyond it a key is cut into ranges.
WHOLE_KEYS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_box(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows with ``lon`` and ``lat`` inside (xmin, xmax, ymin, ymax); plain comparisons, so they reach the scan."""
    return df.where(F.col(lon).between(box[0], box[1]) & F.col(lat).between(box[2], box[3]))


def changed(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """(key, before, after) of the rows whose ``column`` differs between releases; null is a value."""
    a, b = before.select(key, F.col(column).alias("before")), after.select(key, F.col(column).alias("after"))
    return a.join(b, key).where(~F.col("before").eqNullSafe(F.col("after")))


def missing_from(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key isn't in ``right``."""
    return left.join(right.select(key), key, "left_anti")


def present_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_semi")


def not_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """As SQL's NOT IN: nothing if the right side holds a null, and no row whose own key is null (unless right is empty)."""
    keys = right.select(key)
    nulls = keys.agg(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
    if nulls["n"] == 0:
        return left
    return left.where(F.col(key).isNotNull() & F.lit(nulls["nulls"] == 0)).join(keys, key, "left_anti")


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """Adds ``value`` from a table of one row a key; ``default`` where the key isn't there."""
    return rows.join(small(table.select(key, value)), key, "left").withColumn(value, F.coalesce(value, default))


def side_by_side(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows; name a unique column last, so that ties don't decide."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rn", place).where(F.col("rn") <= n)


def top_of_top_groups(df: DataFrame, group: str, groups: int, n: int, *order: Column) -> DataFrame:
    """The first n rows of each of the largest groups."""
    largest = top(df.where(F.col(group).isNotNull()).groupBy(group).count(), groups, F.desc("count"), F.asc(group)).select(group)
    return top_per_group(df.join(F.broadcast(largest), group, "left_semi"), group, n, *order)


def best_per_key(df: DataFrame, key: str, rank: Column) -> DataFrame:
    """One row a key, the one with the greatest ``rank``; a partial aggregate, no sort of a key's rows."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("_b")).select(key, "_b.*")


def seeded(*key: str, seed: int | str = 42) -> Column:
    """A pseudo-random order that any engine with md5 repeats."""
    return F.md5(F.concat(*[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def seeded_rank(df: DataFrame, group: str, key: str, seed: int | str = 42, name: str = "rank") -> DataFrame:
    """Adds the rank, from 1, of each row in its group by the seeded order.

    Rows are ranked within the 4,096 ranges of the order's first digits and shifted by the counts of the ranges before,
    so a group of any size is spread over as many tasks.  Rows of a null group are left out.
    """
    rows = df.where(F.col(group).isNotNull()).withColumn("_h", seeded(key, seed=seed)).withColumn("_range", F.coalesce(F.substring("_h", 1, 3), F.lit("")))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy(group, "_range").agg(F.count("*").alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy("_h", key))
    return rows.join(shift, [group, "_range"]).withColumn(name, inside + F.col("_shift")).drop("_h", "_range", "_shift")


def cuts_of(df: DataFrame, column: str, ranges: int = 256) -> list:
    """Values, at most ``ranges`` - 1, that cut the column into ranges of about as many rows; only they reach the driver."""
    found = df.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    return sorted({x for x in found or [] if x == x})


def running_sums(df: DataFrame, key: str, by: str, values: list[str]) -> DataFrame:
    """Adds before_<value>: the sum over the key's rows with a smaller ``by``; one row for each key and ``by``.

    Beyond ``WHOLE_KEYS`` rows, counted first, sums run within ranges of ``by`` and are shifted by those of the ranges
    before, so no task holds a whole key; ``df`` is written once then, and its ranges are found in what was written.
    """
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, w: F.coalesce(F.sum(c).over(earlier(w)), F.lit(0))
    if df.limit(WHOLE_KEYS + 1).count() <= WHOLE_KEYS:
        return df.withColumns({f"before_{v}": over(v, Window.partitionBy(key).orderBy(by)) for v in values})
    df = io.written(df, "sums")
    cuts = cuts_of(df, by)
    rows = df.withColumn("_range", F.size(F.filter(F.lit(cuts), lambda c: c < F.col(by))) if cuts else F.lit(0))
    totals = rows.groupBy(key, "_range").agg(*[F.sum(v).alias(v) for v in values])
    shifts = totals.select(key, "_range", *[over(v, Window.partitionBy(key).orderBy("_range")).alias(f"_{v}") for v in values])
    inside = Window.partitionBy(key, "_range").orderBy(by)
    out = rows.join(shifts, [key, "_range"])
    return out.withColumns({f"before_{v}": over(v, inside) + F.col(f"_{v}") for v in values}).drop("_range", *[f"_{v}" for v in values])


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all, if fewer), chosen by the seeded order; ``n`` may grow with the data, no task holds them."""
    return seeded_rank(df.withColumn("_all", F.lit(1)), "_all", key, seed, "_place").where(F.col("_place") <= n).drop("_all", "_place")


def sample_per_group(df: DataFrame, group: str, n: int, key: str, seed: int = 42) -> DataFrame:
    return top_per_group(df, group, n, seeded(key, seed=seed), F.col(key)).drop("rn")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(seeded(key, seed=seed), key)


def with_rank(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """Rank by size regardless of sign; for short tables such as profiles."""
    return df.withColumn(name, F.rank().over(Window.orderBy(F.desc(F.abs(column)))))


def tagged_union(frames: dict[str, DataFrame], tag: str = "release") -> DataFrame:
    out = None
    for name, df in frames.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out
