"""Shards of nearly equal bytes by longest-processing-time scheduling.

Rows of equal text form a group that must stay together.  The scheduler takes all groups from the largest to the smallest
and gives each to the least-loaded shard through a heap.  Groups of one size are interchangeable, so the driver only gets
how many groups there are of each size: at most the square root of twice the bytes, since so many different sizes add up
to more.  A run of equal sizes is dealt at once, with the very outcome of dealing them singly; what comes out is how many
groups of a size each shard gets.  Groups are then numbered within their size, by ranges, and go to the shard of their
number.

Null texts form one group, apart from empty ones.  Size is the UTF-8 bytes of the text (null: none) plus 1, so empty
rows count.  Ties between shards go to the lowest number, groups of a size are in the order of their name, a hash of the
text; repeated rows each have a slot; an empty table gives an empty table; columns other than doc_id and text are not
read.  Rows of a shard are numbered in the order of doc_id, null first, and among equal ids by the checksum of the text.
"""

from __future__ import annotations

import heapq
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import durable, join_members

#: Rows of one range when rows are numbered.
RANGE_ROWS = 1_000_000
#: Sizes that are broadcast, about 100 bytes each; beyond that they are shuffled.
BROADCAST_SIZES = 500_000


def text_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def schedule(sizes: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """For each of ``sizes`` (size, number of items), how many of its items each shard gets.

    Largest first, to the least-loaded shard, the lowest number among equals.  The items of one size take, one after the
    other, the least of all values load + i * size; so those below a level that leaves fewer items than shards are dealt
    at once, and the heap deals the rest.
    """
    loads = [0] * shards
    out = {}
    for size, count in sorted(sizes, reverse=True):
        dealt = [0] * shards
        if count > shards:
            low, high = min(loads), max(loads) + (count + 1) * size
            while high - low > 1:
                level = (low + high) // 2
                if sum(max(0, -((load - level) // size)) for load in loads) <= count:
                    low = level
                else:
                    high = level
            dealt = [max(0, -((load - low) // size)) for load in loads]
        heap = [(load + n * size, i) for i, (load, n) in enumerate(zip(loads, dealt, strict=True))]
        heapq.heapify(heap)
        for _ in range(count - sum(dealt)):
            load, i = heap[0]
            heapq.heapreplace(heap, (load + size, i))
            dealt[i] += 1
        loads = [load + n * size for load, n in zip(loads, dealt, strict=True)]
        out[size] = dealt
    return out


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row."""
    spark = docs.sparkSession
    name = F.coalesce(F.sha2("text", 256), F.lit("null")).alias("name")
    rows = durable(docs.select("doc_id", text_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), name), "rows")
    groups = durable(rows.groupBy("name").agg(F.sum("size").alias("total"), F.count("*").alias("members")), "groups")
    sizes = [tuple(r) for r in groups.groupBy("total").count().collect()]  # at most sqrt(2 * bytes) rows
    ends = [(size, list(itertools.accumulate(dealt))) for size, dealt in schedule(sizes, shards).items()]
    plan = spark.createDataFrame(ends, "total bigint, ends array<bigint>")
    shard = F.size(F.filter("ends", lambda end: end <= F.col("number"))).alias("shard")
    placed = numbered(groups, "total", [F.asc("name")], "number", F.broadcast(plan) if len(ends) <= BROADCAST_SIZES else plan)
    named = durable(placed.select("name", "members", shard), "placed")
    out = join_members(rows, named, ["name"]).select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("tie"))
    return numbered(out, "shard", [F.asc_nulls_first("doc_id"), F.asc_nulls_first("text_crc32"), F.asc("tie")], "slot").drop("tie")


def numbered(rows: DataFrame, key: str, order: list[Column], name: str, more: DataFrame | None = None) -> DataFrame:
    """``rows`` with a column ``name``: 0, 1, ... within each value of ``key`` in the given order.

    Rows are cut into ranges of key and order; a row's number is its place in its range and the counts of the key's
    ranges before it.  No task holds more than a range, however many rows a key has.  ``more`` has further columns for
    each key, which come with the counts.
    """
    rows = durable(rows, "unnumbered")
    count = rows.count()
    ranges = max(1, -(-count // RANGE_ROWS), min(count // 1000, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = durable(rows.repartitionByRange(int(ranges), key, *order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(key, "range").count()  # a key has as many rows as it has ranges
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    if more is not None:
        base = base.join(more, key)
    inside = Window.partitionBy("range", key).orderBy(*order)
    return ranged.withColumn("place", F.row_number().over(inside)).join(base, [key, "range"]).withColumn(name, F.col("base") + F.col("place") - 1).drop("base", "place", "range")
