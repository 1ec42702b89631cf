"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is ``window`` consecutive words of a benchmark item, or the whole item if it has fewer words.  Windows and
documents are seen as sets of shingles with places.  Containment must be full, so one shingle of a window is a
necessary prefix; shingles are ordered by rarity and the rarest, the one met at the fewest places of the corpus, is
taken.  Documents meet windows on that shingle alone; the length of the document and the shingle's place in the window
bound where an occurrence can start; a candidate stays if every shingle of the window stands at its place, and is
confirmed by the words themselves.

Texts are not shuffled to find hits: their shingles are matched against the benchmark's, which are broadcast if they are at
most ``BROADCAST_SHINGLES`` (counted first) and joined by a shuffle beyond that; only places that match go on.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; shingles are three words (one or two for
windows that short), compared by 64-bit hashes.  Defined results: null and empty texts have no words and no hits; null
and empty items have no window; a null item id counts as the empty string; repeated rows each keep a row; an empty
benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import durable

#: 24 bytes each: 48 MB.
BROADCAST_SHINGLES = 2_000_000
#: 16 bytes each: 16 MB.
BROADCAST_IDS = 1_000_000
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3


def ascii_lower(text: str) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the fast function."""
    c = F.col(text)
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def words(text: str = "text") -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATOR), ""), F.array().cast("array<string>"))


def shingles(words_: str, n: str, k: int) -> Column:
    """The hashes of the k-word shingles in order."""
    return F.expr(f"IF({n} >= {k}, transform(sequence(1, {n} - {k - 1}), i -> xxhash64({k}, {', '.join(f'get({words_}, i + {j})' for j in range(-1, k - 1))})), array())")


def windows(items: DataFrame, window: int) -> DataFrame:
    """item, w (number of the distinct window), words, size, k (words of its shingles)."""
    cut = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words().alias("words")).withColumn("n", F.size("words")).where("n > 0")
    each = cut.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(n - {window - 1}, 1)), i -> slice(words, i, {window}))")).alias("words")).distinct()
    return each.select("item", F.sha2(F.concat_ws(" ", "words"), 256).alias("w"), "words", F.size("words").alias("size")).withColumn("k", F.least("size", F.lit(SHINGLE)))


def same_row(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")), F.col(f"{a}.row") == F.col(f"{b}.row")]


def confirmed(likely: DataFrame, base: DataFrame, win: DataFrame) -> DataFrame:
    """Those occurrences whose words are the window's; only documents with one have their words split again."""
    ids = durable(likely.select("doc_id", "row").distinct(), "likely_ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = base.alias("a").join(ids.alias("b"), same_row("a", "b"), "left_semi").dropDuplicates(["doc_id", "row"])
    met = likely.alias("a").join(texts.alias("b"), same_row("a", "b")).select("a.*", F.slice("b.words", F.col("a.start").cast("int"), F.col("a.size")).alias("there"))
    return met.join(win.select("w", F.col("words").alias("wanted")).dropDuplicates(["w"]), "w").where("there = wanted").select("doc_id", "row", "w", "size", "k", "start")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items and items (sorted as strings) of each row of ``docs``."""
    win = durable(windows(benchmark, window), "windows")
    parts = None
    sizes = [r["k"] for r in win.select("k").distinct().collect()] or [SHINGLE]  # at most three
    for k in sizes:
        one = win.where(F.col("k") == k).select("item", "w", "size", F.lit(k).alias("k"), F.posexplode(shingles("words", "size", k)).alias("at", "h"))
        parts = one if parts is None else parts.unionByName(one)
    parts = durable(parts, "window_shingles")
    wanted = parts.select("h").distinct()
    few = wanted.count() <= BROADCAST_SHINGLES
    wanted = wanted.withColumn("met", F.lit(True))

    key = F.xxhash64("doc_id", "text").alias("row")
    base = docs.select("doc_id", key, words().alias("words")).withColumn("n_words", F.size("words"))
    found = None
    for k in sorted(sizes, reverse=True):
        # place 0 carries the document itself, once
        first = F.array(F.lit(None).cast("bigint"))
        each = base.select("doc_id", "row", "n_words", F.posexplode(F.concat(first, shingles("words", "n_words", k))).alias("place", "h"))
        if found is not None:
            each = each.where("place > 0")
        met = each.join(F.broadcast(wanted) if few else wanted, "h", "left").where("met OR place = 0").drop("met")
        found = met if found is None else found.unionByName(met)
    found = durable(found, "places")

    seen = found.where("place > 0")
    rarity = seen.groupBy("h").count()
    ranked = parts.join(rarity, "h", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    prefix = ranked.groupBy("w", "size", "k").agg(F.min_by(F.struct("h", "at"), F.struct("count", "at")).alias("p")).select("w", "size", "k", "p.h", "p.at")
    start = seen.join(prefix, "h").select("doc_id", "row", "n_words", "w", "size", "k", (F.col("place") - F.col("at")).alias("start"))
    start = start.where("start >= 1 AND start + size - 1 <= n_words").distinct()
    ordered = parts.select("w", "at", "h").distinct()
    spread = start.join(ordered, "w").select("doc_id", "row", "w", "size", "k", "start", (F.col("start") + F.col("at")).alias("place"), "h")
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), *(F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("row", "place", "h"))]
    there = spread.alias("a").join(seen.select("doc_id", "row", "place", "h").distinct().alias("b"), same).select("a.*")
    likely = durable(there.groupBy("doc_id", "row", "w", "size", "k", "start").count().where("count = size - k + 1"), "likely")
    sure = durable(confirmed(likely, base, win), "occurrences")

    places = sure.select("doc_id", "row", F.explode(F.expr("sequence(start, start + size - 1)")).alias("place")).distinct().groupBy("doc_id", "row").agg(F.count("*").alias("n_hit"))
    held = sure.select("doc_id", "row", "w").distinct().join(win.select("w", "item"), "w").groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    counts = places.alias("a").join(held.alias("b"), same_row("a", "b")).select("a.*", "items")
    every = found.where("place = 0").alias("a").join(counts.alias("b"), same_row("a", "b"), "left")
    none = F.array().cast("array<string>")
    out = every.select("a.doc_id", "a.row", F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", none).alias("items"))
    return out.withColumn("n_items", F.size("items").cast("bigint"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents in which a window of the benchmark occurs.

    The ids of hit documents are broadcast if they are at most ``BROADCAST_IDS`` (counted first); beyond that documents
    are shuffled to meet them.
    """
    bad = durable(hits(docs, benchmark, window).where("n_hit > 0").select("doc_id", "row").distinct(), "hit")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad
    keyed = docs.withColumn("statuslake_row", F.xxhash64("doc_id", "text"))
    return keyed.join(bad.withColumnsRenamed({"doc_id": "statuslake_id", "row": "statuslake_bad"}), F.col("doc_id").eqNullSafe(F.col("statuslake_id")) & (F.col("statuslake_row") == F.col("statuslake_bad")), "left_anti").drop("statuslake_row")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS l, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(list_slice(w, i, i + l - 1), ' ') AS s FROM bi),
dl AS (SELECT doc_id, w, l FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l),
di AS (SELECT doc_id, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i FROM dl),
occ AS (SELECT doc_id, item_id, i, win.l FROM (SELECT doc_id, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS s FROM di) x JOIN win ON x.l = win.l AND x.s = win.s),
pos AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + l - 1)) AS p FROM occ),
h AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s FROM occ GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(it.s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
