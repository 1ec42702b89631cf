"""Near-duplicate embeddings: blocks of vectors meet one another, whatever their labels.

In 64 dimensions at a cosine of 0.95 a part of the coordinates rules out few pairs, and sending vectors to all cells of a
grid that they may touch multiplies them.  So vectors lie in blocks of at most ``CELL_ROWS``, written once, and a product
without keys lets each two blocks of one length meet once: it reads blocks again rather than copying them, so what is written
grows with the input, and a task holds the blocks of two partitions.  All pairs are compared, which is quadratic by nature:
one matrix product in single precision for two blocks, double precision where it leaves a pair open.

Pairs never leave the task: it returns how many vectors each of its vectors is linked with, and a spanning forest of the
links.  Exact copies meet first and are one class, joined once, and counted in the links of others.

Matrix products decide wherever they are clear; within ``BAND`` of the threshold the same sums are taken term by term from
the given values, so all tasks decide alike.

Defined results: null vectors, zero vectors, vectors that hold null or non-finite components link with nothing, and so
do vectors of different lengths with each other; rows with a null id keep a row without links, component null, and are
kept; repeated ids are one vector each in the links and share their component; labels are not read; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import components, durable, join_members

#: Vectors of a block at most.
CELL_ROWS = 16_384
#: Blocks of a partition at most, so many in a task's memory on either side.
HELD = 16
#: Rows and columns that are compared at once.
TILE, WIDE = 256, 4096
#: The name of a vector's value: a hash of its components (0.0 and -0.0 are the same).
CLASS_NAME = "unhex(sha2(concat_ws(',', transform(embedding, x -> CAST(x + 0.0D AS STRING))), 256))"
#: What matrix products of unit vectors are trusted to.
BAND = 1e-11
#: The same in single precision, at least and for each dimension.
BAND32, EACH32 = 1e-5, 2e-7


def usable(c: str) -> Column:
    """Whether every component is a finite number and one of them is not zero."""
    finite = F.expr(f"forall({c}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    return F.col(c).isNotNull() & (F.size(c) > 0) & finite & F.expr(f"exists({c}, x -> x <> 0)")


def scaled(x: np.ndarray) -> np.ndarray:
    return x / np.abs(x).max(axis=1, keepdims=True)


def blocks(vectors: DataFrame) -> DataFrame:
    """``vectors`` (id, members, v) as (block, n, ids, members, v): rows of at most ``CELL_ROWS`` vectors of ``n`` components."""
    kind = np.float32 if dict(vectors.dtypes)["v"] == "array<float>" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = TaskContext.get().partitionId() << 24, {}

        def block(n: int, rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            at = lambda c: rows.column(c).combine_chunks()
            ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), at("id"))
            members, v = at("members").to_numpy().tobytes(), at("v").flatten().to_numpy().astype(kind).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n], pa.int32()), ids, pa.array([members]), pa.array([v])], ["block", "n", "ids", "members", "v"])

        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy()
            for n in np.unique(sizes).tolist():
                part = pa.Table.from_batches([batch.take(pa.array(np.flatnonzero(sizes == n)))])
                part = pa.concat_tables([waiting[n], part]) if n in waiting else part
                while len(part) >= CELL_ROWS:
                    yield block(n, part.slice(0, CELL_ROWS))
                    part = part.slice(CELL_ROWS)
                waiting[n] = part
        yield from (block(n, part) for n, part in waiting.items() if len(part))

    return vectors.select("id", "members", "v").mapInArrow(run, "block bigint, n int, ids array<binary>, members binary, v binary")


def labels_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of rows and columns of a link matrix without empty rows and columns."""
    m, none = mask.shape[0], mask.size + sum(mask.shape)
    rows, cols = np.arange(m), np.full(mask.shape[1], none)
    while True:
        cols_new = np.minimum(cols, np.where(mask, rows[:, None], none).min(axis=0))
        rows_new = np.minimum(rows, np.where(mask, cols_new[None, :], none).min(axis=1))
        if (rows_new == rows).all() and (cols_new == cols).all():
            return rows, cols
        rows, cols = rows_new, cols_new


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most ``n`` edges that connect what the edges (a, b) over 0, ..., n - 1 connect: each node and its root."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


class Block:
    """A row of ``blocks``, prepared for products."""

    def __init__(self, n: int, members: bytes, v: bytes):
        self.members = np.frombuffer(members, np.int64).astype(np.float64)
        self.raw = scaled(np.frombuffer(v, np.float32 if len(v) == 4 * n * len(self.members) else np.float64).reshape(-1, n).astype(np.float64))
        self.unit = self.raw / np.sqrt((self.raw * self.raw).sum(axis=1, keepdims=True))
        self.short = self.unit.astype(np.float32)
        self.counts = np.zeros(len(self.unit))


def alike(a: Block, p: np.ndarray, b: Block, q: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows p of ``a`` and q of ``b`` are linked, as a matrix."""
    over = a.unit[p] @ b.unit[q].T - cosine
    out = over >= 0
    i, j = np.nonzero(np.abs(over) <= BAND)
    if len(i):
        x, y = a.raw[p[i]], b.raw[q[j]]
        out[i, j] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)) >= cosine
    return out


def compare(a: Block, b: Block, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Counts the links of two blocks, or of all pairs of one; yields edges (rows, other rows) of ``a``'s, then of ``b``'s rows to ``a``'s."""
    least = cosine - max(BAND32, EACH32 * a.unit.shape[1])
    for at in range(0, len(a.unit), TILE):
        for to in range(at if a is b else 0, len(b.unit), WIDE):
            near = a.short[at : at + TILE] @ b.short[to : to + WIDE].T
            row = np.flatnonzero(near.max(axis=1) >= least)
            near = near[row] >= least
            if a is b:
                near &= np.arange(to, to + near.shape[1])[None, :] > (row + at)[:, None]
            col = np.flatnonzero(near.any(axis=0))
            if not len(col):
                continue
            x, y = row + at, col + to
            found = near[:, col] & alike(a, x, b, y, cosine)
            row, col = found.any(axis=1), found.any(axis=0)
            if not row.any():
                continue
            x, y, found = x[row], y[col], found[row][:, col]
            np.add.at(a.counts, x, found @ b.members[y])
            np.add.at(b.counts, y, a.members[x] @ found)
            rows, cols = labels_of(found)
            yield x, x[rows], y, x[cols]


class Found:
    """What a task finds of the blocks that it sees: links of each vector, and a forest of them."""

    def __init__(self):
        self.starts: dict[int, int] = {}
        self.ids: list[pa.Array] = []
        self.counts, self.a, self.b = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def start(self, block: int, ids: pa.Array) -> int:
        """The number of a block's first vector."""
        if block not in self.starts:
            self.starts[block] = len(self.counts)
            self.ids.append(ids)
            self.counts = np.concatenate([self.counts, np.zeros(len(ids))])
        return self.starts[block]

    def meet(self, i: int, a: Block, j: int, b: Block, cosine: float) -> None:
        edges = [(np.concatenate([x + i, y + j]), np.concatenate([u, w]) + i) for x, u, y, w in compare(a, b, cosine)]
        for start, block in {i: a, j: b}.items():
            self.counts[start : start + len(block.counts)] += block.counts
        if edges:
            self.a, self.b = forest(len(self.counts), *(np.concatenate([old, *new]) for old, new in zip((self.a, self.b), zip(*edges, strict=True), strict=True)))

    def table(self) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(self.counts)
        if len(some):
            ids = pa.concat_arrays(self.ids)
            first = ids.take(pa.array(np.concatenate([some, self.a])))
            other = pa.concat_arrays([pa.nulls(len(some), pa.binary()), ids.take(pa.array(self.b))])
            n = np.concatenate([self.counts[some], np.zeros(len(self.a))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([first, other, pa.array(n)], ["id", "other", "n"])


def linked(vectors: DataFrame, n: int, cosine: float) -> DataFrame:
    """(id, other, n) over ``n`` rows ``vectors`` (id, members, v): ``n`` members of linked vectors, or, with ``other``, an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found()
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda c: batch.column(c)[row]  # noqa: B023, E731
                side = lambda s: (found.start(value(f"{s}block").as_py(), value(f"{s}ids").values.cast(pa.binary())), Block(value("n").as_py(), value(f"{s}members").as_py(), value(f"{s}v").as_py()))  # noqa: B023, E731
                i, a = side("")
                j, b = side("r_") if value("r_block") != value("block") else (i, a)
                found.meet(i, a, j, b, cosine)
        yield from found.table()

    full = math.ceil(n / CELL_ROWS)
    parts = max(1, min(full, max(math.ceil(math.sqrt(8 * vectors.sparkSession.sparkContext.defaultParallelism)), math.ceil(full / HELD))))
    a = durable(blocks(vectors.coalesce(parts)), "blocks").repartition(parts)
    b = a.select(*[F.col(c).alias(f"r_{c}") for c in a.columns])
    # of two blocks one order is taken, by turns; lengths are no key, or all blocks would be one task's
    once = "block = r_block OR (block < r_block) = ((block + r_block) % 2 = 0)"
    pairs = a.join(b.hint("shuffle_replicate_nl"), F.expr(f"abs(n - r_n) < 1 AND ({once})"))
    return pairs.mapInArrow(run, "id binary, other binary, n bigint")


def near_duplicates(rows: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``rows`` (vec_id, embedding), which is read twice."""
    fit, embeddings = F.col("vec_id").isNotNull() & usable("embedding"), rows
    rows = durable(rows.select("vec_id", F.when(fit, F.expr(CLASS_NAME)).alias("name")), "names")
    good = rows.where("name IS NOT NULL")
    ids = durable(good.distinct(), "ids")
    classes = durable(ids.groupBy("name").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members")), "classes")
    values = embeddings.where(fit).groupBy(F.expr(CLASS_NAME).alias("name")).agg(F.first("embedding").alias("v"))
    reps = values.join(classes, "name").select(F.col("name").alias("id"), "members", "v")
    found = durable(linked(reps, classes.count(), cosine), "linked")
    others = found.where("other IS NULL").groupBy(F.col("id").alias("name")).agg(F.sum("n").alias("others"))
    classes = durable(classes.join(others, "name", "left").select("name", "rep", "members", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "counted")
    rep = lambda c, to: classes.select(F.col("name").alias(c), F.col("rep").alias(to))
    edges = found.where("other IS NOT NULL").select("id", "other").join(rep("id", "a"), "id").join(rep("other", "b"), "other").select("a", "b")
    copies = join_members(ids, classes, ["name"]).where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    component = components(durable(edges.unionByName(copies).distinct(), "edges")).select(F.col("id").alias("vec_id"), F.col("component").alias("component_id"))
    known = join_members(good, classes, ["name"]).select("vec_id", "n_links")
    none = rows.where("name IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"))
    out = known.unionByName(none).join(component, "vec_id", "left")
    return out.select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
"""
