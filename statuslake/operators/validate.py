"""Validation of models and embeddings: neighbours, silhouettes, folds, permutations, calibration, normalisation, drift."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import io
from . import classify, evaluate
from .profile import exact_quantiles
from .relational import seeded, seeded_rank

#: Rows of a bin of cells, and of the rows that meet it in one task; fewer if their vectors hold more than so many numbers.
CELL_ROWS = 65_536
CELL_VALUES = 1 << 22
#: Rows that are compared at once: of those that ask, and of a cell.
ASKING, MET = 256, 4096


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _to_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - c) ** 2).sum(1)) for c in centres], 1)


def _few_copies(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``x`` but those with more than k copies of smaller ids, which are among nobody's k nearest."""
    raw = np.ascontiguousarray(x + 0.0)
    _, group = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    place = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    return np.sort(order[place <= k])


class _Best:
    """The k nearest so far of each row that asks, and the squared distance up to which others count."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, bound: np.ndarray, k: int):
        self.q, self.ids, self.k = q, ids, k
        self.limit, self.norm = bound**2, np.sqrt((q * q).sum(1))
        self.distance, self.near = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)

    def meet(self, rows: np.ndarray, x: np.ndarray, x_id: np.ndarray, centre: np.ndarray, rough: np.ndarray) -> None:
        """``rows`` of those that ask meet ``x``; ``rough``: in single precision x - centre, and behind it its square.

        Squared distances in single precision, with their error added to the limit, leave few pairs, whose distances are
        computed in double precision.
        """
        own = self.q[rows] - centre
        square = (own * own).sum(1)
        widest = float(rough[:, -1].max())
        if not max(widest, float(square.max())) < 1e30:  # beyond single precision
            apart = x - centre
            rough, widest = np.column_stack([apart, (apart * apart).sum(1)]), float((apart * apart).sum(1).max())
        # of a sum of so many products in single precision, and of the differences from the centre in double precision
        lost = 1e-15 * (self.norm[rows] + np.sqrt((centre * centre).sum()) + np.sqrt(widest))
        slack = (rough.shape[1] + 16) * 2.4e-7 * (square + widest) + 8 * lost * (np.sqrt(square) + np.sqrt(widest) + lost) + 1e-30
        got = np.column_stack([-2 * own, np.ones(len(own))]).astype(rough.dtype) @ rough.T
        limit = self.limit[rows]
        if np.isinf(limit).any() and len(x) > self.k:  # one more than k, as the row itself may be among them
            limit = np.minimum(limit, np.partition(got, self.k, axis=1)[:, self.k] + square + slack)
        top = np.nextafter((limit + slack - square).astype(rough.dtype), rough.dtype.type(np.inf))
        flat = np.flatnonzero(got <= top[:, None])
        row, col = flat // len(x), flat % len(x)
        other = self.ids[rows[row]] != x_id[col]
        row, col = row[other], col[other]
        for at in range(0, len(row), 1 << 16):  # copies, at equal distances, may be many
            self.add(rows[row[at : at + (1 << 16)]], x, x_id, col[at : at + (1 << 16)])

    def add(self, row: np.ndarray, x: np.ndarray, x_id: np.ndarray, col: np.ndarray) -> None:
        distance = np.sqrt(((self.q[row] - x[col]) ** 2).sum(1))
        counts = distance * distance <= self.limit[row] * (1 + 1e-12)
        row, col, distance = row[counts], col[counts], distance[counts]
        if not len(row):
            return
        met = np.unique(row)
        row, distance, near = np.concatenate([row, np.repeat(met, self.k)]), np.concatenate([distance, self.distance[met].ravel()]), np.concatenate([x_id[col], self.near[met].ravel()])
        order = np.lexsort((near, distance, row))
        row, distance, near = row[order], distance[order], near[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.distance[row[kept], place[kept]], self.near[row[kept], place[kept]] = distance[kept], near[kept]
        self.limit[met] = np.minimum(self.limit[met], self.distance[met, -1] ** 2)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place = np.nonzero(np.isfinite(self.distance))
        return self.ids[row], self.near[row, place], self.distance[row, place]


def _bins(sizes: list[int], centres: np.ndarray, most: int) -> tuple[list[int], list[int], list[list[int]]]:
    """For each cell its first bin and in how many it lies; for each bin its cells.

    Cells of more than ``most`` rows are cut; others, each with the nearest that is left behind it, fill bins.
    """
    start, pieces, bins, room = [0] * len(sizes), [0] * len(sizes), [], 0
    for c in np.flatnonzero(np.array(sizes) > most).tolist():
        start[c], pieces[c] = len(bins), -(-sizes[c] // most)
        bins += [[c]] * pieces[c]
    left = [c for c, n in enumerate(sizes) if 0 < n <= most]
    at = left[0] if left else 0
    while left:
        at = min(left, key=lambda c: ((centres[c] - centres[at]) ** 2).sum())  # noqa: B023
        left.remove(at)
        if sizes[at] > room:
            bins.append([])
            room = most
        room -= sizes[at]
        bins[-1].append(at)
        start[at], pieces[at] = len(bins) - 1, 1
    return start, pieces, bins


_FOUND = "id bigint, near bigint, distance double"


def nearest(rows: DataFrame, key: str, vector: str, k: int = 5, pivots: int = 64, first: int = 3) -> DataFrame:
    """(id, near, distance, rank): the exact k nearest other rows of each row, ties by id.

    Rows belong to the nearest of at most ``pivots`` rows, drawn by the seeded order.  A row first meets the members of its
    own cell and of the next ``first`` ones; the distance to its k-th neighbour so far bounds the rest: by the triangle
    inequality a cell is skipped if the row is farther from its pivot than the bound and the cell's radius together, and
    so is a member whose distance to the pivot differs by more than the bound.  Cells near one another share a bin of up
    to ``CELL_ROWS`` rows, crowded ones are cut into several; a row is sent once to each bin that holds a cell it can't
    skip, where it meets the members of those cells, so what is sent is the rows times the bins at most.  Only the pivots,
    and a row of facts for each cell, are broadcast.  Rows without an id or a vector, or with a null in it, are left out;
    ids are unique.
    """
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x))
    known = rows.where(usable).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    centres = np.array([r["v"] for r in known.orderBy(seeded("id")).limit(pivots).select("v").collect()])
    if not len(centres):
        return known.select("id", F.col("id").alias("near"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))

    def place(batches):
        for batch in batches:
            d = _to_centres(_matrix(pa.chunked_array([batch.column(1)])), centres)
            cells = np.argsort(d, axis=1, kind="stable")[:, : 1 + first].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d[np.arange(len(d)), cells[:, 0]]), pa.array(list(cells), pa.list_(pa.int32()))], ["id", "v", "far", "cells"])

    placed = io.written(known.mapInArrow(place, "id bigint, v array<double>, far double, cells array<int>"), "cells").withColumn("cell", F.get("cells", F.lit(0)))
    facts = {r["cell"]: (r["radius"], r["n"]) for r in placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()}
    sizes, radius = [facts.get(c, (0.0, 0))[1] for c in range(len(centres))], np.array([facts.get(c, (-np.inf, 0))[0] for c in range(len(centres))])
    # some bins for each core, or a few tasks would have it all
    share = -(-sum(sizes) // int(np.ceil(np.sqrt(3 * rows.sparkSession.sparkContext.defaultParallelism))))
    most = min(CELL_ROWS, max(CELL_VALUES // centres.shape[1], 256), max(share, 1024))
    start, pieces, bins = _bins(sizes, centres, most)
    ints = lambda values: F.array(*[F.lit(int(x)) for x in values])
    bin_ = F.get(ints(start), F.col("cell")) + F.pmod(F.xxhash64("id"), F.get(ints(pieces), F.col("cell"))).cast("int")
    members = placed.select(F.col("id").alias("member"), F.col("v").alias("x"), F.col("far").alias("off"), F.col("cell").alias("c"), bin_.alias("bin"))

    def visit(asking: DataFrame, again: bool) -> DataFrame:
        """``asking`` (id, v, cells, bound, bins), a written table, meets the members of ``cells`` or, ``again``, of all others."""
        sent = asking.select("id", "v", "cells", "bound", F.explode("bins").alias("bin"))
        counted = {r["bin"]: r["count"] for r in sent.groupBy("bin").count().collect()}
        parts = [-(-counted.get(b, 0) // most) for b in range(len(bins))]
        tasks = min(4 * sum(parts), 4096) or 1
        part = F.pmod(F.xxhash64("id", F.lit("part")), F.get(ints(parts), F.col("bin"))).cast("int")
        left = sent.withColumn("part", part).repartition(tasks, "bin", "part")
        right = members.where(F.get(ints(parts), F.col("bin")) > 0).withColumn("part", F.explode(F.sequence(F.lit(0), F.get(ints(parts), F.col("bin")) - 1))).repartition(tasks, "bin", "part")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            none = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], ["id", "near", "distance"])
            if not left.num_rows or not right.num_rows:
                return none
            x, x_id, off, c = _matrix(right.column("x")), *(right.column(n).to_numpy() for n in ("member", "off", "c"))
            kept = _few_copies(x, x_id, k)
            kept = kept[np.lexsort((off[kept], c[kept]))]
            x, x_id, off, c = x[kept], x_id[kept], off[kept], c[kept]
            held, begin = np.unique(c, return_index=True)
            end = np.append(begin[1:], len(c))
            rough = np.empty((len(x), x.shape[1] + 1), np.float32)
            for cell, low, high in zip(held, begin, end, strict=True):
                apart = x[low:high] - centres[cell]
                with np.errstate(over="ignore"):
                    rough[low:high, :-1], rough[low:high, -1] = apart, (apart * apart).sum(1)
            q, q_id, bound, cells = _matrix(left.column("v")), left.column("id").to_numpy(), left.column("bound").to_numpy(), _matrix(left.column("cells")).astype(int)
            order, tables = np.argsort(cells[:, 0], kind="stable"), [none]
            for at in range(0, len(q), ASKING):
                own = order[at : at + ASKING]
                best, away = _Best(q[own], q_id[own], bound[own], k), _to_centres(q[own], centres[held])
                for i in np.argsort(away.min(0)):
                    reach = np.sqrt(best.limit) + 1e-9 * (1 + away[:, i] + off[end[i] - 1])
                    asks = (cells[own] == held[i]).any(1) != again
                    asks = np.flatnonzero(asks & (away[:, i] - off[end[i] - 1] <= reach) & (off[begin[i]] - away[:, i] <= reach))
                    if len(asks):
                        span = off[begin[i] : end[i]]
                        low = begin[i] + np.searchsorted(span, (away[asks, i] - reach[asks]).min())
                        high = begin[i] + np.searchsorted(span, (away[asks, i] + reach[asks]).max(), "right")
                        for to in range(low, high, MET):
                            upto = min(to + MET, high)
                            best.meet(asks, x[to:upto], x_id[to:upto], centres[held[i]], rough[to:upto])
                tables.append(pa.table(list(best.found()), ["id", "near", "distance"]))
            return pa.concat_tables(tables)

        return left.groupBy("bin", "part").cogroup(right.groupBy("bin", "part")).applyInArrow(meet, _FOUND)

    def best(found: DataFrame) -> DataFrame:
        # k or fewer from each visit
        return found.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "near"))), 1, k).alias("best"))

    in_bins = F.transform("cells", lambda c: F.when(F.get(ints(pieces), c) > 0, F.sequence(F.get(ints(start), c), F.get(ints(start), c) + F.get(ints(pieces), c) - 1)).otherwise(F.array().cast("array<int>")))
    begun = placed.select("id", "v", "cells", F.lit(float("inf")).alias("bound"), F.array_distinct(F.flatten(in_bins)).alias("bins"))
    early = io.written(best(visit(begun, False)), "early")
    kth = F.when(F.size("best") == k, F.get("best", F.lit(k - 1))["distance"]).otherwise(F.lit(float("inf")))
    bounded = placed.join(early, "id", "left").select("id", "v", "cells", F.coalesce(kth, F.lit(float("inf"))).alias("bound"))

    def unseen(batches):
        """The bins of the cells that a row has not met and can't skip."""
        lies = np.zeros((len(centres), len(bins)), bool)
        for b, held in enumerate(bins):
            lies[held, b] = True
        for batch in batches:
            d, bound = _to_centres(_matrix(pa.chunked_array([batch.column(1)])), centres), batch.column(3).to_numpy()
            open_ = d - radius <= bound[:, None] + 1e-9 * (1 + d + np.maximum(radius, 0))
            np.put_along_axis(open_, _matrix(pa.chunked_array([batch.column(2)])).astype(int), False, axis=1)
            row, b = np.nonzero(open_ @ lies)
            offsets = np.searchsorted(row, np.arange(len(d) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(b.astype(np.int32)))], [*batch.schema.names, "bins"])

    asking = io.written(bounded.mapInArrow(unseen, "id bigint, v array<double>, cells array<int>, bound double, bins array<int>"), "asking")
    every = early.select("id", F.explode("best").alias("x")).select("id", "x.near", "x.distance").unionByName(visit(asking, True))
    return best(every).select("id", F.posexplode("best").alias("rank", "x")).select("id", "x.near", "x.distance", (F.col("rank") + 1).alias("rank"))


def neighbour_purity(rows: DataFrame, key: str, vector: str, label: str, k: int = 5, **parameters) -> DataFrame:
    """(label, n, purity): the share of a row's k nearest neighbours that have its label, averaged over the label's rows."""
    found = nearest(rows, key, vector, k, **parameters)
    labels = rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"))
    met = found.join(labels, "id").join(labels.withColumnsRenamed({"id": "near", "label": "other"}), "near")
    each = met.groupBy("id", "label").agg(F.avg(F.col("label").eqNullSafe(F.col("other")).cast("double")).alias("share"))
    return each.groupBy("label").agg(F.count("*").alias("n"), F.avg("share").alias("purity"))


def silhouettes(rows: DataFrame, state: DataFrame, vector: str, label: str) -> DataFrame:
    """Adds silhouette, for squared distances, from the classes' stored n, mean and scatter.

    The squared distances of a row to a class sum up to the trace of its scatter and n times the squared distance to its
    mean, so no pair is formed.  The only row of a class has 0, as have all if there is one class.  The state is as long as
    there are classes.
    """
    trace = F.aggregate(F.transform("scatter", lambda r, i: F.get(r, i)), F.lit(0.0), lambda a, x: a + x)
    classes = [(r["label"], r["n"], r["mean"], r["trace"]) for r in state.select("label", "n", "mean", trace.alias("trace")).collect()]
    v = F.col(vector).cast("array<double>")
    total = lambda c: F.lit(float(c[3])) + c[1] * F.aggregate(F.zip_with(v, F.lit([float(x) for x in c[2]]), lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x)
    own = functools.reduce(lambda e, c: e.when(F.col(label) == c[0], total(c) / (c[1] - 1) if c[1] > 1 else F.lit(None)), classes, F.when(F.lit(False), 0.0))
    others = F.array_min(F.array(*[F.when(F.col(label) != c[0], total(c) / c[1]) for c in classes]))
    found = rows.withColumns({"_a": own, "_b": others})
    return found.withColumn("silhouette", F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))).drop("_a", "_b")


def da_subtract(total: DataFrame, part: DataFrame, by: list[str]) -> DataFrame:
    """The exact inverse of the merge: the state of the rows of ``total`` that aren't in ``part``, for each ``by`` of it.

    ``part`` has ``by``, label, n, mean and scatter; classes that it holds whole have no row.  Both are as long as classes.
    """
    keys = part.select(*by).distinct()
    whole = total.select("label", F.col("n").alias("n0"), F.col("mean").alias("mean0"), F.col("scatter").alias("scatter0"))
    spread = keys.join(F.broadcast(whole.groupBy().agg(F.collect_list(F.struct("*")).alias("all")))).select(*by, F.explode("all").alias("w")).select(*by, "w.*")
    met = spread.join(part.select(*by, "label", "n", "mean", "scatter"), [*by, "label"], "left")
    rest = F.col("n0") - F.coalesce("n", F.lit(0))
    mean = F.when(F.col("n").isNull(), F.col("mean0")).otherwise(F.zip_with("mean0", "mean", lambda a, b: (F.col("n0") * a - F.col("n") * b) / F.col("rest")))
    out = met.withColumn("rest", rest).where("rest > 0").withColumn("kept", mean).withColumn("apart", F.zip_with("mean", "kept", lambda a, b: a - b)).withColumn("factor", F.col("n") * F.col("rest") / F.col("n0"))
    cell = lambda row, own, d: F.zip_with(F.zip_with(row, own, lambda a, b: a - b), F.transform("apart", lambda e: F.col("factor") * d * e), lambda a, b: a - b)
    inner = F.transform("scatter0", lambda row, i: cell(row, F.get(F.col("scatter"), i), F.get(F.col("apart"), i)))
    return out.select(*by, "label", F.col("rest").alias("n"), F.col("kept").alias("mean"), F.when(F.col("n").isNull(), F.col("scatter0")).otherwise(inner).alias("scatter"))


def fold_states(rows: DataFrame, vector: str, label: str, key: str, folds: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows with a stratified fold from 0, and the state of the rows outside each fold, from one pass over the rows.

    The total is the merge of the folds' states; each fold's is subtracted from it.
    """
    dealt = io.written(seeded_rank(rows, label, key, seed, "_place").withColumn("fold", F.pmod(F.col("_place") - 1, F.lit(folds)).cast("int")).drop("_place"), "folds")
    marked = dealt.withColumn("_both", F.col("fold") + folds * F.col(label).cast("bigint"))
    parts = io.written(classify.da_fit(marked, vector, "_both").select(F.pmod("label", F.lit(folds)).cast("int").alias("fold"), F.expr(f"label div {folds}").alias("label"), "n", "mean", "scatter"), "fold_states")
    return dealt, io.written(da_subtract(classify.da_merge(parts.select("label", "n", "mean", "scatter")), parts, ["fold"]), "rest_states")


def permuted(rows: DataFrame, columns: list[str], key: str, seed: int = 42) -> DataFrame:
    """Adds <column>_permuted: each column's values dealt anew by one seeded permutation a column.

    The row at place i of one seeded order gets the value at place i of another; both orders are ranked in ranges, so no
    task holds a column.
    """
    out = seeded_rank(rows.withColumn("_all", F.lit(1)), "_all", key, f"{seed}:", "_place").drop("_all")
    for c in columns:
        source = seeded_rank(rows.select(F.lit(1).alias("_all"), key, F.col(c).alias(f"{c}_permuted")), "_all", key, f"{seed}:{c}", "_place")
        out = out.join(source.drop("_all", key), "_place")
    return out.drop("_place")


def permutation_importance(rows: DataFrame, columns: list[str], key: str, label: str, score: Column, seed: int = 42) -> DataFrame:
    """(column, auc, drop): how far the AUC of ``score`` falls when one of its columns is permuted; closed (0) is positive.

    All columns are permuted and scored in one pass over the joined rows.
    """
    wide = io.written(permuted(rows.select(key, label, *columns), columns, key, seed), "permuted")
    cases = {"": {}} | {c: {c: F.col(f"{c}_permuted")} for c in columns}
    structs = F.array(*[F.struct(F.lit(name).alias("model"), *[(own.get(c, F.col(c))).alias(c) for c in columns]) for name, own in cases.items()])
    long = wide.select((1 - F.col(label)).alias("y"), F.explode(structs).alias("x")).select("y", "x.*")
    got = evaluate.auc(long.select("model", "y", score.alias("p_closed")))
    base = got.where("model = ''").select(F.col("auc").alias("base"))
    return got.where("model <> ''").crossJoin(F.broadcast(base)).select(F.col("model").alias("column"), "auc", F.round(F.col("base") - F.col("auc"), 6).alias("drop"))


def fit_temperature(rows: DataFrame, logits: str, label: str, steps: int = 50) -> float:
    """The temperature that makes softmax(logits / T) most likely, by Newton's method on 1 / T; one aggregate a step.

    ``label`` is a place in ``logits``, from 0.  Rows with a null are left out; without rows, or where no finite
    temperature is best, what the last step gave.
    """
    data = io.written(rows.where(F.col(logits).isNotNull() & F.col(label).isNotNull()).select(F.col(logits).cast("array<double>").alias("z"), F.col(label).cast("int").alias("y")), "logits")
    beta = 1.0
    for _ in range(steps):
        top = F.array_max("z")
        weighted = data.select("z", "y", F.transform("z", lambda z: F.exp(beta * (z - top))).alias("w"))
        sum_ = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        mean = sum_(F.zip_with("w", "z", lambda w, z: w * z)) / sum_(F.col("w"))
        square = sum_(F.zip_with("w", "z", lambda w, z: w * z * z)) / sum_(F.col("w"))
        g, h = weighted.agg(F.sum(mean - F.get("z", F.col("y"))), F.sum(square - mean * mean)).first()
        if not h:
            break
        step = max(min(g / h, beta / 2), -beta)
        beta -= step
        if abs(step) < 1e-12:
            break
    return 1 / beta


def fit_quantiles(train: DataFrame, columns: list[str], points: int = 100) -> DataFrame:
    """(column, q): each column's quantiles at 0, 1/points, ... 1 over its values; a table to store, one row a column."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    return exact_quantiles(long.where("NOT isnan(value)"), "column", "value", [i / points for i in range(points + 1)]).select("column", "q")


def normalised(rows: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Each column's place, from 0 to 1, among its training quantiles, by linear interpolation.

    A value that several quantiles share gets the middle of their places; values beyond the ends get 0 and 1; null stays.
    """
    fitted = {r["column"]: r["q"] for r in table.where(F.col("column").isin(columns)).collect()}  # a short list a column
    out = {}
    for c in columns:
        q, x = F.lit([float(v) for v in fitted[c]]), F.col(c).cast("double")
        n = len(fitted[c]) - 1
        below, upto = F.size(F.filter(q, lambda v: v < x)), F.size(F.filter(q, lambda v: v <= x))
        low, high = F.get(q, below - 1), F.get(q, below)
        place = F.when(upto > below, (below + upto - 1) / 2.0).when(below == 0, 0.0).when(below > n, float(n)).otherwise(below - 1 + (x - low) / (high - low))
        out[c] = F.when(x.isNotNull(), place / n)
    return rows.withColumns(out)


def gaussian_divergence(before: DataFrame, after: DataFrame, ridge: float = 1e-4) -> DataFrame:
    """(label, kl): divergence of each class's normal distribution in ``after`` from that in ``before``; states are short."""
    old, new = ({r["label"]: r for r in s.collect()} for s in (before, after))
    out = []
    for c in sorted(old.keys() & new.keys()):
        covariance = [np.array(s["scatter"]) / max(s["n"] - 1, 1) + ridge * np.eye(len(s["mean"])) for s in (old[c], new[c])]
        apart = np.array(new[c]["mean"]) - np.array(old[c]["mean"])
        inverse = np.linalg.inv(covariance[0])
        logs = [np.linalg.slogdet(x)[1] for x in covariance]
        out.append((c, float(0.5 * (np.trace(inverse @ covariance[1]) + apart @ inverse @ apart - len(apart) + logs[0] - logs[1]))))
    return before.sparkSession.createDataFrame(out, "label bigint, kl double")


def score_shift(before: DataFrame, after: DataFrame, score: str, bins: int = 10) -> DataFrame:
    """One row (psi): the population stability index of two score histograms over [0, 1]; empty bins count as half a row."""
    cut = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")
    each = before.select(cut, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(after.select(cut, F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = each.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = counts.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    p, q = (F.greatest(F.col(x).cast("double"), F.lit(0.5)) / F.col(f"all_{x}") for x in ("a", "b"))
    return counts.crossJoin(F.broadcast(totals)).agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))


def drift_gate(releases: dict[str, DataFrame], scores: dict[str, DataFrame], reference: str, score: str, most_kl: float = 1.0, most_psi: float = 0.2) -> DataFrame:
    """(release, kl, psi, decision): the greatest divergence of a class, the shift of scores, and what they call for.

    ``keep`` below half of both limits, ``update`` up to them, ``refit`` beyond either.
    """
    spark = next(iter(releases.values())).sparkSession
    out = []
    for name in sorted(releases.keys() - {reference}):
        kl = gaussian_divergence(releases[reference], releases[name]).agg(F.max("kl")).first()[0] or 0.0
        psi = score_shift(scores[reference], scores[name], score).first()[0] or 0.0
        worst = max(kl / most_kl, psi / most_psi)
        out.append((name, kl, psi, "refit" if worst > 1 else "update" if worst >= 0.5 else "keep"))
    return spark.createDataFrame(out, "release string, kl double, psi double, decision string")

