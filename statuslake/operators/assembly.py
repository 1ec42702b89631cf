"""Training tables: splits, encodings, weights and augmentation, all repeatable from md5 orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profile import distribution, top_values
from .relational import lookup, missing_from, sample_exact, seeded, seeded_rank, small


def stratified(df: DataFrame, label: str, key: str, percent: int, seed: int = 42) -> DataFrame:
    """Adds ``held``: true for ceil(percent of all rows), shared among the classes by largest remainder.

    Quotas come from class counts alone; a class's rows are then ranked by the seeded order.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy())
    part = sizes.withColumn("_want", F.ceil(total * percent / 100)).withColumn("_share", F.col("_n") * F.col("_want") / total).withColumn("_base", F.floor("_share"))
    left = F.col("_want") - F.sum("_base").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.col("_share") - F.col("_base")), F.asc(label)))
    quota = part.withColumn("_left", left).withColumn("_place", place).select(label, (F.col("_base") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)).alias("_quota"))
    return seeded_rank(df, label, key, seed, "_rank").join(small(quota), label).withColumn("held", F.col("_rank") <= F.col("_quota")).drop("_rank", "_quota")


def append_training(train: DataFrame, held: DataFrame, extra: list[DataFrame], key: str) -> DataFrame:
    """``train`` and the extra rows whose key isn't held out."""
    for more in extra:
        train = train.unionByName(missing_from(more, held, key), allowMissingColumns=True)
    return train


def category_index(train: DataFrame, category: str) -> DataFrame:
    """(category, index): alphabetical over the training rows. The table is as long as there are categories."""
    names = train.where(F.col(category).isNotNull()).select(category).distinct()
    return names.withColumn("index", F.row_number().over(Window.orderBy(category)) - 1)


def apply_index(rows: DataFrame, index: DataFrame, category: str) -> DataFrame:
    """Unseen categories get the size of the vocabulary."""
    size = index.agg(F.count("*").cast("int").alias("_size"))
    return rows.join(small(index), category, "left").crossJoin(F.broadcast(size)).withColumn("index", F.coalesce("index", "_size")).drop("_size")


def decode_index(rows: DataFrame, index: DataFrame, category: str) -> DataFrame:
    return lookup(rows, index, "index", category, F.lit("OOV"))


def closure_rates(train: DataFrame, category: str, label: str) -> DataFrame:
    return train.groupBy(category).agg(F.avg((F.col(label) == 0).cast("double")).alias("closure_rate"))


def target_encode(rows: DataFrame, train: DataFrame, category: str, label: str) -> DataFrame:
    """Adds closure_rate of the category in ``train``; the overall rate for unseen ones."""
    overall = train.agg(F.avg((F.col(label) == 0).cast("double")).alias("_all"))
    return rows.join(small(closure_rates(train, category, label)), category, "left").crossJoin(F.broadcast(overall)).withColumn("closure_rate", F.coalesce("closure_rate", "_all")).drop("_all")


def target_encode_folds(train: DataFrame, category: str, label: str, key: str, folds: int = 5) -> DataFrame:
    """Out-of-fold form: a row's rate leaves its own fold out."""
    fold = F.pmod(F.conv(F.substring(seeded(key), 1, 8), 16, 10).cast("bigint"), F.lit(folds))
    rows = train.withColumn("_fold", fold).withColumn("_c", (F.col(label) == 0).cast("double"))
    per = rows.groupBy(category, "_fold").agg(F.sum("_c").alias("_s"), F.count("*").alias("_n"))
    w = Window.partitionBy(category)
    other = per.withColumn("closure_rate", F.try_divide(F.sum("_s").over(w) - F.col("_s"), F.sum("_n").over(w) - F.col("_n"))).select(category, "_fold", "closure_rate")
    overall = rows.agg(F.avg("_c").alias("_all"))
    return rows.join(small(other), [category, "_fold"], "left").crossJoin(F.broadcast(overall)).withColumn("closure_rate", F.coalesce("closure_rate", "_all")).drop("_fold", "_c", "_all")


def one_hot(rows: DataFrame, index: str = "index", size: int = 300) -> DataFrame:
    """Adds category_vec, the indicator vector of the index; unknown ones and those beyond the cap are all zeros."""
    from pyspark.ml.feature import VectorSizeHint
    from pyspark.ml.functions import array_to_vector

    hot = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == F.col(index)).cast("double"))
    return VectorSizeHint(inputCol="category_vec", size=size, handleInvalid="optimistic").transform(rows.withColumn("category_vec", array_to_vector(hot)))


def balanced_weights(train: DataFrame, label: str) -> DataFrame:
    """Adds weight = n / (classes * n of the class)."""
    sizes = train.groupBy(label).agg(F.count("*").alias("_n"))
    w = Window.partitionBy()
    weights = sizes.select(label, (F.sum("_n").over(w) / (F.count("*").over(w) * F.col("_n"))).alias("weight"))
    return train.join(small(weights), label)


def top_regions(places: DataFrame, n: int) -> DataFrame:
    return top_values(places.where("status IN ('closed', 'permanently_closed')"), "region", n, with_null=False)


def stratified_negatives(pool: DataFrame, shares: DataFrame, n: int, category: str, key: str, seed: int = 42) -> DataFrame:
    """n open rows: four fifths to known categories in proportion (at least 1, half to even), the rest to other ones."""
    quota = shares.select(category, F.greatest(F.bround(F.col("fraction") * (0.8 * n)), F.lit(1.0)).cast("int").alias("_quota"))
    known = seeded_rank(pool, category, key, seed, "_rn").join(small(quota), category).where(F.col("_rn") <= F.col("_quota")).drop("_rn", "_quota")
    other = sample_exact(missing_from(pool.where(F.col(category).isNotNull()), shares, category), n - int(0.8 * n), key, seed)
    return known.unionByName(other.select(*known.columns))


def fixed_ratio(places: DataFrame, labeled: DataFrame, top_n: int, ratio: int) -> DataFrame:
    """Closed places of the top regions and ``ratio`` times as many open ones, with their label."""
    regions = top_regions(places, top_n).select("region")
    inside = places.join(F.broadcast(regions), "region", "left_semi")
    closed = inside.where("status IN ('closed', 'permanently_closed')")
    pool = inside.where("status IS NULL OR status = 'open'")
    n = ratio * closed.count()
    negatives = stratified_negatives(pool, distribution(labeled.where("category IS NOT NULL"), "category"), n, "category", "id")
    return closed.withColumn("open", F.lit(0)).unionByName(negatives.select(*closed.columns).withColumn("open", F.lit(1)))


def open_needed(closed: int, have_open: int, percent: int) -> int:
    return max(0, round(closed * 100 / percent) - closed - have_open)


def percent_target(pool: DataFrame, labeled: DataFrame, label: str, key: str, percent: int) -> DataFrame:
    """Open rows of ``pool``, not labelled yet, that bring the closed share of ``labeled`` down to ``percent``."""
    c = labeled.agg(F.count_if(F.col(label) == 0).alias("closed"), F.count_if(F.col(label) == 1).alias("open")).first()
    return sample_exact(missing_from(pool, labeled, key), open_needed(c["closed"], c["open"], percent), key)


def capped(df: DataFrame, label: str, cap: int, percent: int, key: str) -> DataFrame:
    """At most ``cap`` open rows, and closed ones up to ``percent`` of the result."""
    ones = sample_exact(df.where(F.col(label) == 1), cap, key)
    n = ones.count()
    return ones.unionByName(sample_exact(df.where(F.col(label) == 0), int(n * percent / (100 - percent)), key))


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the vector of the columns in order."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df)


def sanity(features: DataFrame, columns: list[str]) -> DataFrame:
    """Null and not-a-number counts of each feature."""
    from .profile import long

    return long(features, {c: {"nulls": F.count_if(F.col(c).isNull()), "nans": F.count_if(F.isnan(F.col(c).cast("double")))} for c in columns})
