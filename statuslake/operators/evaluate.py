"""Evaluation of scores, closed (y = 1) as the positive class.

Ranking measures start from one row for each model and distinct score, with counts, and sum those up within ranges of
the score, so no task holds all scores of a model; ``digits`` rounds scores first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import running_sums


def score_counts(scored: DataFrame, digits: int | None = None) -> DataFrame:
    s = F.col("p_closed") if digits is None else F.round("p_closed", digits)
    return scored.groupBy("model", s.alias("s")).agg(F.sum("y").cast("bigint").alias("pos"), F.sum(1 - F.col("y")).cast("bigint").alias("neg"))


def auc(scored: DataFrame, digits: int | None = None) -> DataFrame:
    """(model, auc): the probability that a closed row scores above an open one, ties half."""
    c = running_sums(score_counts(scored, digits), "model", "s", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    return c.groupBy("model").agg(F.round(F.try_divide(wins, F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def average_precision(scored: DataFrame, digits: int | None = None) -> DataFrame:
    """(model, ap): the sum over thresholds of precision times the gain in recall."""
    counts = score_counts(scored, digits)
    totals = counts.groupBy("model").agg(F.sum("pos").alias("all_pos"), F.sum(F.col("pos") + F.col("neg")).alias("all"))
    c = running_sums(counts, "model", "s", ["pos", "neg"]).join(totals, "model")
    tp, called = F.col("all_pos") - F.col("before_pos"), F.col("all") - F.col("before_pos") - F.col("before_neg")
    return c.groupBy("model").agg(F.round(F.try_divide(F.sum(F.col("pos") * tp / called), F.sum("pos")), 6).alias("ap"))


def confusion(scored: DataFrame, threshold: float, *by: str) -> DataFrame:
    p, y = F.col("p_closed") >= threshold, F.col("y") == 1
    return scored.groupBy(*by).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rates(table: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to confusion counts; 0 where there is nothing to divide by."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return table.withColumns({"precision": F.round(ratio(tp, tp + fp), 6), "recall": F.round(ratio(tp, tp + fn), 6), "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), 6)})


def best_f1(scored: DataFrame) -> DataFrame:
    """(model, threshold, f1): over 0.01, 0.015, ... 1.0, the first maximum; cuts that predict nothing are skipped."""
    cut = F.least(F.floor(F.round((F.col("p_closed") - 0.01) / 0.005, 6)), F.lit(198))
    counted = scored.withColumn("cut", cut).groupBy("model", "cut").agg(F.sum("y").cast("bigint").alias("pos"), F.count("*").alias("n"))
    spark = scored.sparkSession
    grid = scored.select("model").distinct().crossJoin(F.broadcast(spark.range(199).withColumnRenamed("id", "cut")))
    up = Window.partitionBy("model").orderBy(F.desc("cut"))
    total = counted.groupBy("model").agg(F.sum("pos").alias("all_pos"))
    at = grid.join(counted.where("cut >= 0"), ["model", "cut"], "left").na.fill(0, ["pos", "n"]).withColumn("tp", F.sum("pos").over(up)).withColumn("called", F.sum("n").over(up)).join(F.broadcast(total), "model")
    f1 = F.when(F.col("called") > 0, ratio(2.0 * F.col("tp"), F.col("called") + F.col("all_pos")))
    best = at.withColumn("f1", F.round(f1, 6)).groupBy("model").agg(F.max_by(F.struct("cut", "f1"), F.struct(F.coalesce("f1", F.lit(-1.0)), -F.col("cut"))).alias("b"))
    found = F.coalesce(F.col("b.f1"), F.lit(0.0)) > 0
    return best.select("model", F.when(found, F.round(F.col("b.cut") * 0.005 + 0.01, 3)).otherwise(0.5).alias("threshold"), F.when(found, F.col("b.f1")).otherwise(0.0).alias("f1"))


def compare(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row a model: n, auc, ap, best F1 with its threshold, and the rates at ``threshold``."""
    sizes = scored.groupBy("model").agg(F.count("*").alias("n"))
    best = best_f1(scored).select("model", F.col("threshold").alias("best_threshold"), F.col("f1").alias("best_f1"))
    return sizes.join(auc(scored), "model").join(average_precision(scored), "model").join(best, "model").join(rates(confusion(scored, threshold, "model")), "model")


def targets(results: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """(model, metric, value, target, status): PASS or MISS."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("target")) for m, t in wanted.items()])).alias("x")
    return results.select("model", each).select("model", "x.*").withColumn("status", F.when(F.col("value") >= F.col("target"), "PASS").otherwise("MISS"))


def error_types(scored: DataFrame, threshold: float) -> DataFrame:
    p, y = F.col("p_closed") >= threshold, F.col("y") == 1
    return scored.withColumn("error", F.when(p & y, "TP").when(p, "FP").when(y, "FN").otherwise("TN"))


def feature_profile(errors: DataFrame, a: str, b: str, columns: list[str]) -> DataFrame:
    """Feature means of two error groups, ordered by their difference."""
    from .profile import long

    mean = lambda c, e: F.avg(F.when(F.col("error") == e, F.col(c)))
    out = long(errors, {c: {"mean_a": F.round(mean(c, a), 6), "mean_b": F.round(mean(c, b), 6), "diff": F.round(mean(c, a) - mean(c, b), 6)} for c in columns})
    return out.orderBy(F.desc(F.abs("diff")), "feature")


def category_errors(errors: DataFrame, low: int = 5) -> DataFrame:
    """Errors of each category with a closed row; categories of few closed rows are marked."""
    n = {e: F.count_if(F.col("error") == e).alias(e.lower()) for e in ("TP", "FP", "FN", "TN")}
    out = errors.groupBy("category").agg(F.count_if(F.col("y") == 1).alias("closed"), *n.values()).where("closed >= 1")
    return out.withColumn("low_n", F.col("closed") < low)


def category_metrics(scored: DataFrame, threshold: float, reliable: int = 5) -> DataFrame:
    out = rates(confusion(scored, threshold, "model", "category"))
    return out.withColumn("closed", F.col("tp") + F.col("fn")).withColumn("reliable", F.col("tp") + F.col("fn") >= reliable)


def extreme_categories(metrics: DataFrame, least: int = 3) -> DataFrame:
    """Categories whose closed rows are all missed (at least ``least``), or all found (reliable ones)."""
    zero = (F.col("closed") >= least) & (F.col("recall") == 0)
    perfect = F.col("reliable") & (F.col("recall") == 1)
    return metrics.where(zero | perfect).select("model", "category", "closed", F.when(zero, "zero").otherwise("perfect").alias("kind"))


def weighted_loss(scored: DataFrame, closed_weight: float = 1.0, gamma: float = 0.0) -> DataFrame:
    """(model, loss): mean of (1 - p)^gamma * w * -ln p of the true class, p kept inside (0, 1)."""
    p = F.greatest(F.least(F.when(F.col("y") == 1, F.col("p_closed")).otherwise(1 - F.col("p_closed")), F.lit(1 - 1e-7)), F.lit(1e-7))
    w = F.when(F.col("y") == 1, closed_weight).otherwise(1.0)
    return scored.groupBy("model").agg(F.round(F.avg(F.pow(1 - p, F.lit(gamma)) * w * -F.log(p)), 6).alias("loss"))


def stratified_auc(scored: DataFrame, by: str) -> DataFrame:
    """AUC of each model within each stratum."""
    joined = scored.where(F.col(by).isNotNull()).withColumn("model", F.concat_ws("\u0001", "model", by))
    parts = F.split("model", "\u0001")
    return auc(joined).select(F.get(parts, F.lit(0)).alias("model"), F.get(parts, F.lit(1)).alias(by), "auc").where("auc IS NOT NULL")


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(model, ece): mean distance of confidence and frequency over equal-width bins, by size."""
    b = F.least(F.floor(F.col("p_closed") * bins), F.lit(bins - 1))
    per = scored.groupBy("model", b.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("p_closed") - F.avg("y")).alias("gap"))
    return per.groupBy("model").agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))
