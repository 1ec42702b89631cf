"""Survival of places: person-period tables, hazards, Kaplan-Meier curves, concordance and the Brier score.

A place is watched release by release.  Windows hold the sightings of one place, at most as many as there are releases;
risk sets are counts of equal times, summed up within ranges; pairs are never formed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import io
from .relational import running_sums, small


def spells(sightings: DataFrame, key: str, time: str, closed: str, max_gap: int = 4) -> DataFrame:
    """(key, spell, entry, end, duration, event): how long each place was watched without a break, and whether it closed.

    ``time`` is the number of a release.  Releases that lack the place don't end a spell up to ``max_gap`` of them from one
    sighting to the next; after a longer gap, or after a closure, the next open sighting starts a new one, entered late.
    A spell without a closure is censored at its last sighting.  Of several rows of a release a closure wins; rows with a
    null are left out.
    """
    seen = sightings.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(closed).isNotNull()).groupBy(key, F.col(time).cast("bigint").alias("_t")).agg(F.max(F.col(closed).cast("int")).alias("_c"))
    order = Window.partitionBy(key).orderBy("_t")
    before, was = F.lag("_t").over(order), F.lag("_c").over(order)
    marked = seen.withColumn("_new", (before.isNull() | (was == 1) | (F.col("_t") - before > max_gap)).cast("int"))
    numbered = marked.withColumn("spell", F.sum("_new").over(order))
    found = numbered.groupBy(key, "spell").agg(F.min("_t").alias("entry"), F.max("_t").alias("end"), F.max("_c").alias("event"), F.min_by("_c", "_t").alias("_first"))
    # a place that is closed when it comes into view was never at risk
    return found.where("_first = 0").select(key, "spell", "entry", "end", (F.col("end") - F.col("entry")).alias("duration"), "event")


def person_periods(spells_: DataFrame) -> DataFrame:
    """A row for each release interval of a spell: age from 1, the release it ends with, and event in the closing one."""
    each = spells_.where("duration > 0").withColumn("age", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("duration"))))
    return each.withColumn("release", F.col("entry") + F.col("age")).withColumn("event", F.when(F.col("age") == F.col("duration"), F.col("event")).otherwise(0))


def hazards(periods: DataFrame, *by: str) -> DataFrame:
    """(by, age, at_risk, events, hazard, survival): h = events / at risk, and the running product of 1 - h."""
    counted = periods.groupBy(*by, "age").agg(F.count("*").alias("at_risk"), F.sum("event").cast("bigint").alias("events"))
    order = Window.partitionBy(*by).orderBy("age").rowsBetween(Window.unboundedPreceding, 0) if by else Window.orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    h = F.col("events") / F.col("at_risk")
    return counted.withColumn("hazard", h).withColumn("survival", F.product(1 - F.col("hazard")).over(order))


def expected_survival(features: DataFrame, hazard: str, key: str, age: str) -> DataFrame:
    """(key, age, survival): the product of 1 - hazard over each row's ages, for hazards that a model has given."""
    order = Window.partitionBy(key).orderBy(age).rowsBetween(Window.unboundedPreceding, 0)
    return features.withColumn("survival", F.product(1 - F.col(hazard)).over(order)).select(key, age, "survival")


def kaplan_meier(rows: DataFrame, by: str, time: str, event: str) -> DataFrame:
    """(by, time, at_risk, events, censored, before, survival, variance), a row for each distinct time of a stratum.

    ``before`` is the survival just before the time, ``variance`` Greenwood's.  Events come before censorings of the same
    time.  A stratum with many times is summed up within ranges of the time.
    """
    known = rows.where(F.col(by).isNotNull() & F.col(time).isNotNull() & F.col(event).isNotNull())
    counts = known.groupBy(by, F.col(time).alias("time")).agg(F.sum(F.col(event).cast("bigint")).alias("events"), F.sum(1 - F.col(event).cast("bigint")).alias("censored"))
    counts = io.written(counts.withColumn("n", F.col("events") + F.col("censored")), "times")
    totals = counts.groupBy(by).agg(F.sum("n").alias("total"))
    risk = running_sums(counts, by, "time", ["n"]).join(small(totals), by).withColumn("at_risk", F.col("total") - F.col("before_n"))
    left = F.col("at_risk") - F.col("events")
    # at the last time all at risk may go: their logarithm is kept apart
    terms = risk.withColumns({"log": F.when(left > 0, F.ln(left / F.col("at_risk"))).otherwise(0.0), "gone": (left == 0).cast("int"), "green": F.when(left > 0, F.col("events") / (F.col("at_risk") * left)).otherwise(0.0)})
    run = running_sums(terms.drop("before_n", "total", "n"), by, "time", ["log", "gone", "green"])
    before = F.when(F.col("before_gone") > 0, 0.0).otherwise(F.exp("before_log"))
    now = F.when(F.col("before_gone") + F.col("gone") > 0, 0.0).otherwise(F.exp(F.col("before_log") + F.col("log")))
    out = run.withColumn("before", before).withColumn("survival", now)
    return out.select(by, "time", "at_risk", "events", "censored", "before", "survival", (F.col("survival") * F.col("survival") * (F.col("before_green") + F.col("green"))).alias("variance"))


def dominated(x: np.ndarray, y: np.ndarray, asks: np.ndarray, weight: np.ndarray) -> int:
    """The sum over rows i of asks_i times the weights of rows with greater x and smaller y, by merge counts."""
    if not len(x):
        return 0
    x, y = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    order = np.argsort(y, kind="stable")
    x, y, asks, weight = x[order], y[order], asks[order].astype(np.int64), weight[order].astype(np.int64)
    total = 0
    for bit in range(int(x.max()).bit_length()):
        # two rows meet at the highest bit in which their x differ; inside a group that agrees above it rows go by y
        by_group = np.argsort(x >> (bit + 1), kind="stable")
        group, upper, level = (x >> (bit + 1))[by_group], (x >> bit & 1)[by_group] == 1, y[by_group]
        sums = np.concatenate([[0], np.cumsum(np.where(upper, weight[by_group], 0))])
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new_level = new_group | np.concatenate([[True], level[1:] != level[:-1]])
        place = np.arange(len(x))
        first = np.maximum.accumulate(np.where(new_level, place, 0))
        start = np.maximum.accumulate(np.where(new_group, place, 0))
        total += int(((sums[first] - sums[start]) * np.where(upper, 0, asks[by_group])).sum())
    return total


def concordance(rows: DataFrame, time: str, event: str, risk: str, range_rows: int = 500_000, ranges: int = 2000) -> DataFrame:
    """One row (concordant, tied, comparable, c_index): how often the place that closes first has the higher risk.

    A pair is comparable if the earlier time is a closure, or the times are equal and one is a closure, the other censored.
    Rows with a null don't count.  Distinct (time, event, risk) are sorted into ranges of time and, again, of risk.  Pairs in
    different ranges of both come from the table of counts by both ranges, at most ``ranges`` squared; those that share a
    range are counted inside it by merging.  Ties and comparable pairs are running sums over time.
    """
    known = rows.where(F.col(time).isNotNull() & F.col(event).isNotNull() & F.col(risk).isNotNull())
    distinct = known.groupBy(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(risk).cast("double").alias("r")).agg(F.count("*").alias("n"))
    distinct = io.written(distinct, "distinct")
    parts = int(min(ranges, max(1, -(-distinct.count() // range_rows))))
    timed = io.written(distinct.repartitionByRange(parts, "t", F.desc("e"), "r").withColumn("p", F.spark_partition_id()), "timed")
    both = io.written(timed.repartitionByRange(parts, "r", "t", F.desc("e")).withColumn("q", F.spark_partition_id()), "both")
    cells = both.groupBy("p", "q").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("e")).alias("asks")).toPandas()
    grid, asks = np.zeros((parts, parts)), np.zeros((parts, parts))
    grid[cells["p"], cells["q"]], asks[cells["p"], cells["q"]] = cells["n"], cells["asks"]
    later = np.zeros((parts + 1, parts + 1))
    later[:parts, 1:] = np.cumsum(np.cumsum(grid[::-1], axis=0)[::-1], axis=1)
    apart = float((asks * later[1:, :parts]).sum())

    def within(shared: str, other: bool):
        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            # behind an event are the later times and the censored rows of its own
            x = pdf["p"].to_numpy() if other else np.unique(np.column_stack([pdf["t"], 1 - pdf["e"]]), axis=0, return_inverse=True)[1].ravel()
            return pd.DataFrame({"n": [float(dominated(x, pdf["r"].to_numpy(), (pdf["n"] * pdf["e"]).to_numpy(), pdf["n"].to_numpy()))]})

        return both.groupBy(shared).applyInPandas(count, "n double")

    near = within("q", True).unionByName(within("p", False)).agg(F.sum("n")).first()[0] or 0.0
    sides = lambda df, key: df.groupBy(key, "t").agg(F.sum(F.col("n") * F.col("e")).alias("closing"), F.sum("n").alias("n"))

    def behind(df: DataFrame, key: str) -> DataFrame:
        counts = sides(df, key)
        totals = counts.groupBy(key).agg(F.sum("n").alias("total"))
        run = running_sums(counts, key, "t", ["n"]).join(totals, key)
        return run.agg(F.sum(F.col("closing").cast("double") * (F.col("total") - F.col("before_n") - F.col("closing"))).alias("pairs"))

    comparable, tied = (behind(df, key).first()[0] or 0.0 for df, key in ((distinct.withColumn("k", F.lit(0)), "k"), (distinct, "r")))
    concordant = apart + near
    return rows.sparkSession.createDataFrame([(concordant, tied, comparable, (concordant + tied / 2) / comparable if comparable else None)], "concordant double, tied double, comparable double, c_index double")


def brier(rows: DataFrame, time: str, event: str, survival: str, horizon: float) -> DataFrame:
    """One row (n, brier): the mean squared error of the probability of being open at ``horizon``.

    Censored rows count through the others: each is weighted by one over the probability of not having been censored, by
    Kaplan-Meier over the censorings, just before its closure or at the horizon.
    """
    known = rows.where(F.col(time).isNotNull() & F.col(event).isNotNull() & F.col(survival).isNotNull()).select(F.col(time).alias("time"), F.col(event).cast("int").alias("event"), F.col(survival).alias("open"), F.lit(0).alias("k"))
    kept = io.written(kaplan_meier(known.withColumn("lost", 1 - F.col("event")), "k", "time", "lost").select("time", "before", "survival"), "censoring")
    at = kept.where(F.col("time") <= horizon).agg(F.max_by("survival", "time")).first()[0]
    at = 1.0 if at is None else float(at)
    closed = (F.col("time") <= horizon) & (F.col("event") == 1)
    error = F.when(closed, F.try_divide(F.col("open") * F.col("open"), F.col("before"))).when(F.col("time") > horizon, (1 - F.col("open")) * (1 - F.col("open")) / at if at else None).otherwise(0.0)
    return known.join(small(kept.select("time", "before")), "time").agg(F.count("*").alias("n"), (F.sum(error) / F.count("*")).alias("brier"))

