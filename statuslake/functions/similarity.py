"""String similarities, vectorised over candidate pairs, and their registration for SQL."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scalar as S

FIRST_WORD_WEIGHT = 0.6


def gestalt(a: str, b: str) -> float:
    """Twice the matching characters over all characters."""
    return SequenceMatcher(None, a, b).ratio()


def indel(a: str, b: str) -> float:
    """100 times the share of characters in the longest common subsequence, found by bits: one step a character of ``b``."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = open_ = (1 << len(a)) - 1
    for y in b:
        hit = open_ & places.get(y, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return 200.0 * (len(a) - open_.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def gestalt_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    return pd.Series([None if x is None or y is None else known.setdefault((x, y), gestalt(x, y)) if (x, y) not in known else known[x, y] for x, y in zip(a, b, strict=True)], dtype="float64")


def codes(texts: list[str], width: int, fill: int) -> np.ndarray:
    """The code points of texts, a row each, filled up to ``width``."""
    raw = b"".join(t.ljust(width, "\0").encode("utf-32-le", "surrogatepass") for t in texts)
    out = np.frombuffer(raw, dtype="<u4").reshape(len(texts), width).astype(np.int64)
    out[np.arange(width) >= np.array([len(t) for t in texts])[:, None]] = fill
    return out


def indels(a: list[str], b: list[str]) -> np.ndarray:
    """``indel`` of many pairs at once: the same recurrence in 64 bits, one step a position of the longer side.

    Of a pair the shorter text gives the bits; pairs in which it has over 64 characters are found one by one.
    """
    short, long_ = ([min(x, y, key=len) for x, y in zip(a, b, strict=True)], [max(x, y, key=len) if len(x) != len(y) else y for x, y in zip(a, b, strict=True)])
    out = np.empty(len(short))
    batch = np.array([i for i, x in enumerate(short) if len(x) <= 64], dtype=int)
    for i in set(range(len(short))) - set(batch.tolist()):
        out[i] = indel(short[i], long_[i])
    order = batch[np.argsort([len(long_[i]) for i in batch], kind="stable")]
    for at in range(0, len(order), 2048):
        rows = order[at : at + 2048]
        xs, ys = [short[i] for i in rows], [long_[i] for i in rows]
        m, n = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
        x, y = codes(xs, max(1, m.max()), -1), codes(ys, max(1, n.max()), -2)
        bits = np.left_shift(np.uint64(1), np.arange(x.shape[1], dtype=np.uint64))
        full = np.array([(1 << k) - 1 for k in m.tolist()], dtype=np.uint64)
        left = full.copy()
        for j in range(y.shape[1]):
            hit = left & np.where(x == y[:, j : j + 1], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
            left = ((left + hit) | (left - hit)) & full
        out[rows] = np.where(m + n == 0, 100.0, 200.0 * (m - np.bitwise_count(left)) / np.maximum(m + n, 1))
    return out


@F.pandas_udf(T.DoubleType())
def indel_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(a), dtype="float64")
    known = np.flatnonzero(a.notna().to_numpy() & b.notna().to_numpy())
    if len(known):
        out.iloc[known] = indels(a.iloc[known].tolist(), b.iloc[known].tolist())
    return out


def sorted_words(c: Column) -> Column:
    return F.concat_ws(" ", F.array_sort(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")))


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_udf(sorted_words(a), sorted_words(b))


#: The characters of a normal name, about from the rarest to the commonest.
ALPHABET = "0123456789qjzxvkwybghfmpduclsntoirae "


def letter_counts(normal: Column) -> Column:
    """How often each character of ``ALPHABET`` occurs."""
    return F.transform(F.lit(list(ALPHABET)), lambda c: F.length(normal) - F.length(F.replace(normal, c, F.lit(""))))


def prepared(name: Column) -> Column:
    """What comparisons need of a name, computed once for each row before any join."""
    normal = S.normal_name(F.coalesce(name, F.lit("")))
    first = S.first_word(normal)
    return F.struct(normal.alias("name"), first.alias("first"), letter_counts(normal).alias("letters"), letter_counts(first).alias("first_letters"))


def may_reach(a: Column, b: Column, least: float, weight: float = FIRST_WORD_WEIGHT) -> Column:
    """Whether two prepared names can be at least so similar; never false for a pair that is.

    Matching characters are at most those of the shorter text, and at most those that both have.
    """
    size = lambda x, y: 2 * F.least(F.length(x), F.length(y)) / (F.length(x) + F.length(y))
    shared = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: F.least(i, j)), F.lit(0), lambda n, i: n + i)
    letters = lambda c, d: 2 * shared(a[d], b[d]) / (F.length(a[c]) + F.length(b[c]))
    mixed = lambda whole, first: (1 - weight) * whole + weight * first >= least - 1e-9
    named = (a["name"] != "") & (b["name"] != "")
    by_size = mixed(size(a["name"], b["name"]), size(a["first"], b["first"]))
    by_letters = mixed(letters("name", "letters"), letters("first", "first_letters"))
    return F.lit(least <= 0) | (named & (S.contains_either(a["name"], b["name"]) | (by_size & by_letters)))


def prepared_similarity(a: Column, b: Column, weight: float = FIRST_WORD_WEIGHT) -> Column:
    """``name_similarity`` of two prepared names.

    The Python part sees only pairs that the built-in tests leave open: for all others both its inputs are null.
    """
    x, y = a["name"], b["name"]
    empty, inside = (x == "") | (y == ""), S.contains_either(x, y)
    ask = ~empty & ~inside
    mixed = (1 - weight) * gestalt_udf(F.when(ask, x), F.when(ask, y)) + weight * gestalt_udf(F.when(ask, a["first"]), F.when(ask, b["first"]))
    return F.when(empty, 0.0).when(inside, 1.0).otherwise(mixed)


def name_similarity(a: Column, b: Column, weight: float = FIRST_WORD_WEIGHT) -> Column:
    """0 if either name is empty, 1 if one holds the other, else a mix of the whole names' and first words' ratios."""
    part = lambda c: F.struct(S.normal_name(F.coalesce(c, F.lit(""))).alias("name"), S.first_word(S.normal_name(F.coalesce(c, F.lit("")))).alias("first"))
    return prepared_similarity(part(a), part(b), weight)


def register(spark: SparkSession) -> None:
    """Makes ``name_ratio`` and ``token_sort_ratio`` available in SQL."""

    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        import re

        def norm(s: str) -> str:
            return re.sub("[^a-z0-9 ]", "", s.lower()).strip()

        def first(s: str) -> str:
            words = s.split()
            return next((w for w in words if w not in ("the", "a", "an")), words[0] if words else "")

        def one(x: str, y: str) -> float:
            x, y = norm(x or ""), norm(y or "")
            if not x or not y:
                return 0.0
            return 1.0 if x in y or y in x else (1 - FIRST_WORD_WEIGHT) * gestalt(x, y) + FIRST_WORD_WEIGHT * gestalt(first(x), first(y))

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    def sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        words = lambda s: " ".join(sorted(s.lower().split()))
        return pd.Series([None if x is None or y is None else indel(words(x), words(y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    spark.udf.register("name_ratio", F.pandas_udf(ratio, T.DoubleType()))
    spark.udf.register("token_sort_ratio", F.pandas_udf(sort_ratio, T.DoubleType()))
