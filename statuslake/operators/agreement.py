"""Agreement of names and addresses across sources: token sets and Jaro-Winkler similarity, both without losing a pair."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..functions.similarity import letter_counts
from ..sources import io
from . import nearby, spatial
from .relational import small


def tokens(text: str) -> Column:
    """The distinct lower-cased letter and digit words of a text, sorted; empty without a text."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")))


def set_overlap(a: Column, b: Column) -> Column:
    """Token Jaccard of two arrays of distinct values, as for sources nested in one record; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def jaccard_join(left: DataFrame, right: DataFrame, text: str, percent: int) -> DataFrame:
    """(left_tokens, right_tokens, n_left, n_right, jaccard): distinct token sets of both sides at ``percent`` or more.

    Tokens are ordered by how many sets hold them.  Two sets that are similar enough share a token among the rarest ones of
    both, so only those meet, further bounded by sizes and by the places of the token; what is left is compared exactly.
    Rows of equal sets are counted, not multiplied: ``tokens`` of a row is its membership.  Texts without tokens agree with
    nothing.
    """
    sides = []
    for name, df in (("left", left), ("right", right)):
        sides.append(df.select(tokens(text).alias("set")).where("size(set) > 0").groupBy("set").agg(F.count("*").alias("n")).withColumn("side", F.lit(name)))
    sets = io.written(sides[0].unionByName(sides[1]), "sets")
    each = sets.select("set", "side", "n", F.explode("set").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("often"))
    ordered = each.join(often, "token").groupBy("side", "set", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("often", "token"))), lambda x: x["token"]).alias("rare"))
    size = F.size("rare")
    # of sets this long, this many tokens must be shared
    kept = size - F.ceil(size * percent / 100.0 - 1e-9).cast("int") + 1
    heads = io.written(ordered.select("side", "set", "n", size.alias("size"), F.posexplode(F.slice("rare", 1, kept)).alias("place", "token")), "heads")
    one = lambda name, mark: heads.where(F.col("side") == name).select("token", *[F.col(c).alias(f"{mark}{c}") for c in ("set", "n", "size", "place")])
    met = one("left", "a_").join(one("right", "b_"), "token")
    least, most = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    possible = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    near = met.where((least * 100 >= most * percent) & (possible * (100 + percent) >= percent * (F.col("a_size") + F.col("b_size"))))
    pairs = near.select("a_set", "b_set", "a_n", "b_n").distinct()
    both = F.size(F.array_intersect("a_set", "b_set"))
    found = pairs.where(both * 100 >= F.size(F.array_union("a_set", "b_set")) * percent)
    return found.select(F.col("a_set").alias("left_tokens"), F.col("b_set").alias("right_tokens"), F.col("a_n").alias("n_left"), F.col("b_n").alias("n_right"), set_overlap(F.col("a_set"), F.col("b_set")).alias("jaccard"))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth of what is missing for each of up to four first characters that agree."""
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [b[j] for j, t in enumerate(taken) if t]
    m, moved = len(mine), sum(x != y for x, y in zip(mine, theirs)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _bound(shared: Column, prefix: Column) -> Column:
    """The greatest Jaro-Winkler similarity of names with so many characters in common and so long a common prefix."""
    jaro = F.when(shared > 0, (shared / F.length("a") + shared / F.length("b") + 1) / 3).otherwise(0.0)
    return jaro + F.least(prefix, F.lit(4)) * 0.1 * (1 - jaro)


def similar_within(left: DataFrame, right: DataFrame, metres: float = 100.0, least: float = 0.85) -> DataFrame:
    """(id, r_id, dist_m, similarity): points within ``metres`` whose normal names have at least this Jaro-Winkler similarity.

    Both sides have id, name, lon and lat.  Names come first: those that can't reach it by the characters they share are
    dropped by built-in functions, each distinct pair is compared once, and only points of similar names meet.
    """
    plain = lambda df: df.select("id", S.normal_name(F.coalesce("name", F.lit(""))).alias("name"), "lon", "lat").where("name <> ''")
    a, b = plain(left), plain(right)
    shared = F.aggregate(F.zip_with("x", "y", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    prefix = sum(((F.substring("a", 1, k) == F.substring("b", 1, k)) & (F.length("a") >= k) & (F.length("b") >= k)).cast("int") for k in range(1, 5))
    open_ = nearby.meeting_names(a, b, "name", metres, letter_counts).where(_bound(shared, prefix) >= least)
    names = io.written(open_.select(F.col("a").alias("name"), F.col("b").alias("r_name"), jaro_winkler_udf("a", "b").alias("similarity")).where(F.col("similarity") >= least), "names")
    return spatial.radius_join(a.join(small(names), "name"), b, metres, ["r_name"]).select("id", "r_id", "dist_m", "similarity")
