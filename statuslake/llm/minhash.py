"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``m`` sub-keys are made of ``t`` minimum hashes each, so ``2 m t`` hashes are computed in all; a
table key joins one sub-key of either collection, which gives ``m * m`` tables of ``2 t`` hashes.  With the defaults
32 hashes serve 64 tables (plain banding would compute 256), and a pair of similarity 0.8 is missed with probability
2 * 0.36**8 < 0.0006.  Every link is confirmed on the full shingle sets.

Equal sets meet first: they form a class that its smallest id stands for.  In the tables a document is compared with
its smallest companion; then, in buckets that still hold several components, with a member of the smallest one; so a
bucket of thousands of copies costs a comparison a document.  In the end all pairs of a bucket that are still in
different components are examined, none is left out.

Before sets are fetched, bitmaps rule pairs out: every item sets one of 1,024 bits, so bits that differ prove items that
differ, and a pair with more of them than its similarity allows can't be a link.  That test never dismisses a link.

Sets hold 64-bit hashes of shingles.  Defined results: null, empty and blank texts have an empty set and are linked
with nothing; a text of fewer words than a shingle has one, the whole sequence; rows with a null id are returned with a
null component and kept; repeated rows share their component, and rows that share an id are one node; other columns are
not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import components, durable, join_members
from .words import MIX, hash_words, mix64, split_words, text_slices

#: 64-bit words of a bitmap.
BITMAP = 16
#: Ids that are broadcast to fetch their texts, 16 bytes each; beyond that the texts are shuffled.
BROADCAST_IDS = 1_000_000
#: Texts whose sets are built at once; their numbers are sorted as 16-bit integers.
MAX_DOCS = 1 << 14


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of at most ``MAX_DOCS`` texts, and the texts' offsets in them."""
    vocabulary, codes, offsets = split_words(column)
    word = hash_words(vocabulary)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    value = mix64(word)
    total = len(word)
    for i in range(1, k):
        nxt = np.zeros(total, np.uint64)
        nxt[: max(total - i, 0)] = word[i:]
        value = mix64(value * MIX + nxt)
    count = np.where(n >= k, n - k + 1, 0)
    owner = np.repeat(np.arange(len(n), dtype=np.uint16), count)
    ends = np.cumsum(count)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[:-1] - (ends - count), count)
    value = value[at]
    for d in np.flatnonzero((n > 0) & (n < k)).tolist():  # the whole sequence, marked by its length
        short = mix64(np.array([int(n[d])], np.uint64))
        for w in word[offsets[d] : offsets[d + 1]]:
            short = mix64(short * MIX + w)
        value, owner = np.append(value, short), np.append(owner, np.uint16(d))
    order = np.argsort(value)
    order = order[np.argsort(owner[order], kind="stable")]
    value, owner = value[order], owner[order]
    if len(value):
        new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
        value, owner = value[new], owner[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).astype(np.int64)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batch, max_bytes=1 << 20):
        for i in range(0, part.num_rows, MAX_DOCS):
            yield part.slice(i, MAX_DOCS)


def sub_keys(values: np.ndarray, starts: np.ndarray, m: int, t: int) -> np.ndarray:
    """2 m sub-keys of each non-empty set; ``starts`` are the sets' first places in ``values``."""
    seed = mix64(np.arange(1, 4 * m * t + 1, dtype=np.uint64) * MIX)
    x = mix64(values)
    out = np.empty((len(starts), 2 * m), np.uint64)
    for j in range(2 * m):
        key = np.full(len(starts), np.uint64(j + 1))
        for i in range(j * t, j * t + t):
            key = mix64(key * MIX + np.minimum.reduceat(x * (seed[2 * i] | np.uint64(1)) + seed[2 * i + 1], starts))
        out[:, j] = key
    return out.view(np.int64)


def signatures(docs: DataFrame, k: int, m: int, t: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set, the sub-keys (none where the set is empty) and the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, offsets = shingle_sets(part.column("text"), k)
                n = np.diff(offsets)
                full = n > 0
                starts = offsets[:-1][full]
                name = np.zeros((part.num_rows, 2), np.int64)
                keys = np.zeros((part.num_rows, 2 * m), np.int64)
                if len(starts):
                    name[full, 0] = np.add.reduceat(mix64(values), starts).view(np.int64)
                    name[full, 1] = np.add.reduceat(mix64(values ^ MIX), starts).view(np.int64)
                    keys[full] = sub_keys(values, starts, m, t)
                wide = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * 2 * m)]), pa.int32()), pa.array(keys[full].reshape(-1)))
                bits = np.zeros(part.num_rows * BITMAP * 64, bool)
                bits[np.repeat(np.arange(part.num_rows), n) * (BITMAP * 64) + (values % np.uint64(BITMAP * 64)).astype(np.int64)] = True
                bitmap = np.packbits(bits).view(np.int64)
                maps = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * BITMAP, pa.int32()), pa.array(bitmap))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(name[:, 0]), pa.array(name[:, 1]), wide, maps], ["doc_id", "n_shingles", "s0", "s1", "keys", "bitmap"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, s0 bigint, s1 bigint, keys array<bigint>, bitmap array<bigint>")


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(id, items) with the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, offsets = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))], ["id", "items"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"id {kind}, items array<bigint>")


def plausible(percent: int) -> str:
    """Whether sets a and b may be similar enough, from sizes (na, nb) and bitmaps (a0, b0, ...)."""
    differ = " + ".join(f"bit_count(a{i} ^ b{i})" for i in range(BITMAP))
    # similarity s allows a symmetric difference of (1 - s) / (1 + s) of both sizes together
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND {100 + percent} * ({differ}) <= {100 - percent} * (na + nb)"


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Only documents of a pair have their sets built.  A document in many pairs is a skewed join key, which adaptive
    execution splits.
    """
    wanted = durable(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    sets = durable(sets_of(docs.join(wanted, "doc_id", "left_semi"), k), "sets")
    side = lambda c, items: sets.select(F.col("id").alias(c), F.col("items").alias(items))
    both = pairs.join(side("b", "items_b"), "b").join(side("a", "items_a"), "a")
    common = F.size(F.array_intersect("items_a", "items_b"))
    return both.where(100 * common >= percent * (F.size("items_a") + F.size("items_b") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, m: int = 8, t: int = 2, rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, one row for each row of ``docs``.

    ``rounds`` is how often members of open buckets meet one of the smallest component before all pairs left are taken.
    """
    docs = docs.select("doc_id", "text")
    signed = durable(signatures(docs, shingle, m, t), "signatures")
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = durable(known.groupBy("s0", "s1", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), "classes")
    copies = join_members(known.select("doc_id", "s0", "s1", "n_shingles"), classes, ["s0", "s1", "n_shingles"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = durable(known.join(classes.select("s0", "s1", "n_shingles", F.col("rep").alias("doc_id")), ["s0", "s1", "n_shingles", "doc_id"], "left_semi").drop("s0", "s1"), "representatives")
    table = F.posexplode(F.expr(f"flatten(transform(slice(keys, 1, {m}), x -> transform(slice(keys, {m + 1}, {m}), y -> xxhash64(x, y))))")).alias("table", "pair")
    rows = reps.select(F.col("doc_id").alias("id"), table).select("id", "table", F.xxhash64("table", "pair").alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", F.col("low").alias("hub"))
    buckets = durable(rows.join(shared, "key"), "buckets")

    def sketch(c: str, keys: bool = False) -> DataFrame:
        """Size and bitmap of each representative under the names of side ``c``, and its sub-keys if asked for."""
        wide = [F.col("keys")[i].alias(f"{c}k{i}") for i in range(2 * m)] if keys else []
        return reps.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), *[F.col("bitmap")[i].alias(f"{c}{i}") for i in range(BITMAP)], *wide)

    def linked(pairs: DataFrame) -> DataFrame:
        likely = pairs.join(sketch("a"), "a").join(sketch("b"), "b").where(plausible(percent)).select("a", "b")
        return confirmed(durable(likely, "likely"), docs, shingle, percent)

    def opened(links: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        """Bucket rows with their component, and a member of the smallest component of buckets that hold several."""
        labels = components(links).select("id", F.col("component").alias("c"))
        named = buckets.select("id", "table", "key").join(labels, "id", "left").withColumn("c", F.coalesce("c", "id"))
        ends = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min_by("id", F.struct("c", F.xxhash64("id", "key", F.lit(number)))).alias("mate"))
        return named, ends.where("low <> high")

    pair = [F.least("id", "mate").alias("a"), F.greatest("id", "mate").alias("b")]
    first = buckets.where("id <> hub").groupBy("id").agg(F.min("hub").alias("mate")).select(*pair)
    links = durable(linked(first), "links")
    for number in range(rounds):
        named, ends = opened(links, number)
        pairs = named.join(ends.select("key", "low", "mate"), "key").where("c <> low").select(*pair).distinct()
        links = durable(links.union(linked(pairs)), "links")
    named, ends = opened(links, rounds)
    left = durable(named.join(ends.select("key"), "key", "left_semi"), "open")
    # a pair is taken in the first table it shares, so it comes up once
    same = [" ".join(f"WHEN ak{i} = bk{i} THEN {i - low}" for i in range(low, low + m)) for low in (0, m)]
    once = f"tablea = {m} * (CASE {same[0]} END) + (CASE {same[1]} END)"

    def side(c: str) -> DataFrame:
        return left.select(F.col("id").alias(c), "key", F.col("table").alias(f"table{c}"), F.col("c").alias(f"c{c}")).join(sketch(c, keys=True), c)

    pairs = side("a").join(side("b"), "key").where(f"ca < cb AND {once} AND {plausible(percent)}").select("a", "b").distinct()
    links = durable(links.union(confirmed(durable(pairs, "pairs"), docs, shingle, percent)), "links")
    found = components(durable(links.union(copies), "edges")).select(F.col("id").alias("doc_id"), F.col("component").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 1) AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
