"""Counts, rates, histograms and profiles, each in one aggregation pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .relational import running_sums


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def share(df: DataFrame, *by: str) -> DataFrame:
    """Group counts with their percentage of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return counts(df, *by).crossJoin(F.broadcast(total)).withColumn("pct", F.round(100 * F.col("n") / F.col("total"), 4)).drop("total")


def distribution(df: DataFrame, by: str) -> DataFrame:
    """Fraction of rows in each group."""
    total = df.agg(F.count("*").alias("total"))
    return counts(df, by).crossJoin(F.broadcast(total)).select(by, (F.col("n") / F.col("total")).alias("fraction"))


def label_totals(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.sum(label).cast("bigint").alias("ones"), (F.count("*") - F.sum(label)).cast("bigint").alias("zeros"))


def conditional_counts(df: DataFrame, by: str, conditions: dict[str, Column]) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def summary(df: DataFrame, by: list[str], column: str, scale: int = 4) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(column), scale).alias("avg"), F.round(F.min(column), scale).alias("min"), F.round(F.max(column), scale).alias("max"))


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"{c}_distinct") for c in columns])


def top_values(df: DataFrame, column: str, n: int, with_null: bool = True) -> DataFrame:
    rows = df if with_null else df.where(F.col(column).isNotNull())
    return counts(rows, column).orderBy(F.desc("n"), F.asc_nulls_first(column)).limit(n)


def group_rate(df: DataFrame, by: str, label: str, support: int = 10, n: int = 15) -> DataFrame:
    """Rate of ``label`` in groups of at least ``support`` rows, the highest first."""
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(label).cast("bigint").alias("ones")).where(F.col("n") >= support)
    return out.withColumn("rate", F.round(F.col("ones") / F.col("n"), 6)).orderBy(F.desc("rate"), by).limit(n)


def long(df: DataFrame, values: dict[str, dict[str, Column]], name: str = "feature") -> DataFrame:
    """One aggregation with a named group of aggregates for each feature, as a row for each feature."""
    wide = df.agg(*[F.struct(*[v.alias(k) for k, v in cols.items()]).alias(f) for f, cols in values.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias(name), F.col(f"`{f}`").alias("v")) for f in values])).alias("x")).select(f"x.{name}", "x.v.*")


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    n = F.count("*")
    out = {c: {"nulls": F.count_if(S.is_blank(F.col(c).cast("string"))), "filled": n - F.count_if(S.is_blank(F.col(c).cast("string")))} for c in columns}
    return long(df, out, "field")


def presence(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Share of rows in which each field says something: overall, in open and in closed rows."""
    said = {c: F.coalesce(S.is_present(F.col(c).cast("string")), F.lit(False)).cast("double") for c in columns}
    return long(df, {c: {"overall": F.round(F.avg(s), 6), "in_open": F.round(F.avg(F.when(F.col(label) == 1, s)), 6), "in_closed": F.round(F.avg(F.when(F.col(label) == 0, s)), 6)} for c, s in said.items()}, "field")


def effect_sizes(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Means of both classes and their distance in units of the standard deviation of all rows."""
    out = {}
    for c in columns:
        a, b = F.avg(F.when(F.col(label) == 0, F.col(c))), F.avg(F.when(F.col(label) == 1, F.col(c)))
        out[c] = {"mean_closed": F.round(a, 6), "mean_open": F.round(b, 6), "effect": F.round(F.try_divide(F.abs(a - b), F.stddev_samp(c)), 6)}
    return long(df, out)


QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def exact_quantiles(rows: DataFrame, key: str, value: str, fractions: list[float]) -> DataFrame:
    """(key, total, q): quantiles with linear interpolation, from counts of values that run within ranges; nulls are left out."""
    each = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("n"))
    counts = running_sums(each, key, "_v", ["n"]).join(each.groupBy(key).agg(F.sum("n").alias("total")), key)
    at = lambda p: (F.col("total") - 1) * F.lit(float(p))
    there = lambda i: F.max(F.when((F.col("before_n") <= i) & (i < F.col("before_n") + F.col("n")), F.col("_v")))
    ends = [F.struct(there(F.floor(at(p))).alias("low"), there(F.ceil(at(p))).alias("high"), F.max(at(p) - F.floor(at(p))).alias("part")) for p in fractions]
    got = counts.groupBy(key).agg(F.max("total").alias("total"), F.array(*ends).alias("q"))
    return got.withColumn("q", F.transform("q", lambda x: x["low"] + (x["high"] - x["low"]) * x["part"]))


def quantiles(df: DataFrame, column: str, approximate: int = 0) -> DataFrame:
    """p10 to p90 with linear interpolation, mean and greatest; ``approximate`` is an accuracy for a faster answer."""
    got = df.agg(F.round(F.avg(column), 6).alias("mean"), F.max(column).alias("max"), *([F.percentile_approx(column, list(QUANTILES), approximate).alias("q")] if approximate else []))
    if not approximate:
        exact = exact_quantiles(df.select(F.lit(0).alias("k"), column), "k", column, list(QUANTILES))
        got = got.withColumn("k", F.lit(0)).join(F.broadcast(exact), "k", "left")
    return got.select(*[F.round(F.get("q", F.lit(i)), 6).alias(f"p{int(100 * p)}") for i, p in enumerate(QUANTILES)], "mean", "max")


def class_stats(df: DataFrame, column: str, label: str, missing: float = -1.0) -> DataFrame:
    """Statistics of the rows with a value, and their share, for each class."""
    x = F.when(F.col(column) != missing, F.col(column))
    rest = df.groupBy(label).agg(F.round(F.avg(x), 6).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.count(x) / F.count("*"), 6).alias("share"))
    middle = exact_quantiles(df.select(F.col(label).alias("_k"), x.alias("_x")), "_k", "_x", [0.5])
    out = rest.join(middle, F.col(label).eqNullSafe(F.col("_k")), "left")
    return out.select(label, "mean", F.round(F.get("q", F.lit(0)), 6).alias("median"), "min", "max", "share")


def left_closed(c: Column, edges: list[float]) -> Column:
    """Number of the bin [e, f) that holds the value, the last one closed; null outside."""
    last = len(edges) - 2
    return reduce(lambda w, i: w.when((c >= edges[i]) & ((c < edges[i + 1]) if i < last else (c <= edges[i + 1])), i), range(1, last + 1), F.when((c >= edges[0]) & ((c < edges[1]) if last else (c <= edges[1])), 0))


def right_closed(c: Column, edges: list[float]) -> Column:
    """Number of the first bin whose edge isn't below the value; the last bin takes what is above."""
    out = F.when(c.isNull(), None)
    for i, e in enumerate(edges[:-1]):
        out = out.when(c <= e, i)
    return out.otherwise(len(edges) - 1)


def histogram(df: DataFrame, bin_: Column, by: str | None = None) -> DataFrame:
    """Rows in each bin, and their percentage (of each class, if ``by`` is given)."""
    keys = [by] if by else []
    rows = df.withColumn("bin", bin_).where("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    return rows.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 4))


def year_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.year(column).alias("year")).agg(F.count("*").alias("n"), F.min(column).alias("first"), F.max(column).alias("last"))


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """min, the element at n // 2 of the sorted values, max and mean."""
    total = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("total"), F.min(column).alias("min"), F.max(column).alias("max"), F.round(F.avg(column), 6).alias("mean"))
    # the n // 2-th value from counts of equal values
    each = df.where(F.col(column).isNotNull()).groupBy(F.lit(0).alias("_k"), F.col(column).alias("v")).agg(F.count("*").alias("n"))
    mid = running_sums(each, "_k", "v", ["n"]).crossJoin(F.broadcast(total.select("total"))).where("before_n + n > floor(total / 2)").agg(F.min("v").alias("upper_median"))
    return total.crossJoin(mid).select("min", "upper_median", "max", "mean")


def rate_of_largest(df: DataFrame, by: str, flag: str, n: int = 15) -> DataFrame:
    """Rate of ``flag`` in the n largest groups, all groups counted in one pass.

    Rows of a null group are left out by their count, behind the aggregation: as a filter before it, the test can reach a join
    below, become its condition and turn it into a nested loop.
    """
    groups = df.groupBy(by).agg(F.count(by).alias("n"), F.round(F.avg(F.col(flag).cast("double")), 6).alias("rate")).where("n > 0")
    return groups.orderBy(F.desc("n"), F.asc(by)).limit(n).orderBy(F.desc("rate"), by)


def exploded_sources(places: DataFrame) -> DataFrame:
    """Datasets that contribute: how many entries and how many places."""
    return places.select("id", F.explode("sources").alias("s")).groupBy(F.col("s.dataset").alias("dataset")).agg(F.count("*").alias("entries"), F.count_distinct("id").alias("places"))


def strategy_counts(df: DataFrame, strategies: list[str]) -> DataFrame:
    """Rows each label strategy calls closed, and how far pairs of strategies agree."""
    pairs = [(a, b) for i, a in enumerate(strategies) for b in strategies[i:]]
    return long(df, {f"{a}|{b}": {"both": F.count_if(F.col(a) & F.col(b)), "agree": F.count_if(F.col(a) == F.col(b))} for a, b in pairs}, "pair")


def threshold_sweep(df: DataFrame, score: str, thresholds: list[float], key: str, agree: Column) -> DataFrame:
    """Kept and dropped rows, distinct keys and agreement at each cut. The thresholds are a short literal list."""
    cuts = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    rows = df.select(F.col(score).alias("_s"), F.col(key).alias("_k"), agree.alias("_a"), cuts)
    kept = F.col("_s") >= F.col("threshold")
    return rows.groupBy("threshold").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), F.count_distinct(F.when(kept, F.col("_k"))).alias("keys"), F.count_if(kept & F.col("_a")).alias("agree"))


def bucket_agreement(df: DataFrame, score: str, edges: list[float], agree: Column) -> DataFrame:
    """Label agreement in each bucket [lo, hi) of the score."""
    c = F.col(score)
    out = F.when(c.isNull(), None)
    for i in range(len(edges) - 1):
        out = out.when((c >= edges[i]) & (c < edges[i + 1]), i)
    return df.withColumn("bucket", out).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(agree).alias("agree")).withColumn("rate", F.round(F.col("agree") / F.col("n"), 6))


def match_pivot(df: DataFrame, label: str, kind: str, kinds: list[str]) -> DataFrame:
    return df.groupBy(label).pivot(kind, kinds).agg(F.count(F.lit(1))).na.fill(0)


def null_tally(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).isNull().alias("open")).agg(F.count("*").alias("n"))


def size_projection(df: DataFrame, label: str, targets: list[int]) -> DataFrame:
    """Rows needed so that the closed ones are 10, 15, ... percent."""
    closed = df.agg(F.count_if(F.col(label) == 0).alias("closed"))
    return closed.select("closed", F.explode(F.array(*map(F.lit, targets))).alias("target")).withColumn("total", F.floor(F.col("closed") * 100 / F.col("target")).cast("bigint"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    rest = long(df, {c: {"count": F.count(c), "nulls": F.count_if(F.col(c).isNull()), "mean": F.round(F.avg(c), 6), "std": F.round(F.stddev_samp(c), 6), "min": F.round(F.min(c).cast("double"), 6), "max": F.round(F.max(c).cast("double"), 6)} for c in columns})
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    out = rest.join(exact_quantiles(each, "feature", "v", [0.25, 0.5, 0.75]), "feature", "left")
    q = lambda i: F.round(F.get("q", F.lit(i)), 6)
    return out.select("feature", "count", "nulls", "mean", "std", "min", q(0).alias("p25"), q(1).alias("p50"), q(2).alias("p75"), "max")


def join_feasibility(registry: DataFrame) -> DataFrame:
    city = F.coalesce(S.clean_text(F.col("city")) == "san francisco", F.lit(False))
    return registry.agg(F.count("*").alias("n"), F.count_if(~S.is_blank(F.col("dba_name"))).alias("with_name"), F.count_if(~S.is_blank(F.col("city"))).alias("with_city"), F.count_if(city).alias("in_city"), F.count_if(city & F.col("closed_a")).alias("closed_in_city"))


def presumed_open(registry: DataFrame) -> DataFrame:
    """Signs of an end among records without an end date."""
    rows = registry.where("end_day IS NULL")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("location_end_day").isNotNull()).alias("location_end"), F.count_if(~S.is_blank(F.col("admin_closed"))).alias("admin"), F.count_if(F.col("closed_d")).alias("any"))


def durations(df: DataFrame, start: str, end: str) -> DataFrame:
    """Quantiles of the years from start to end."""
    at = lambda c: F.col(c).cast("timestamp")
    return quantiles(df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("years", S.years(at(start), at(end))), "years")
