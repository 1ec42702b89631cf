"""Quality scores by co-training a text classifier and a page-metadata classifier.

Two views of a document: its content (distinct words and the last two characters of each) and its metadata (language,
source and layout: lengths, lines, share of punctuation, share of distinct words, in buckets).  Each view has a naive
Bayes scorer.  In every round each scorer labels the pool, and the documents it is surest of, in the proportion of the
classes, join the training set of the *other* view.  In the end both scores are calibrated by cross-fitting: each labelled
row is scored by weights from which the counts of its own fold are subtracted.  The calibrated log-odds are combined by a
logistic model on the same rows, whose weights are never negative and lean towards equal ones, the more so the fewer rows
there are.

Labelled documents are a bounded sample: the first ``max_labelled`` in the order of a hash of doc_id.  The pool is every
other document, so the ids to leave out are bounded as well and nothing is shuffled to find it.  Its features are written
once; in each round one pass counts the scores of both views in fine steps, which gives the cut-offs, and a second one
counts features of the chosen documents by class.  Only such counts and weights, of fixed size, reach the driver.  Where
a cut-off falls within a step, a hash of the row decides which of its rows are taken, so numbers are those asked for up
to the spread of a draw.  Scoring covers every document, slice by slice.

Defined results: null text counts as empty and has metadata only; null language or source is a value of its own;
a table without lang or source counts as one of nulls; if the labels lack a class, every document gets the share of good
ones, or 1 where there are no labels, and is kept then; repeated rows each get the same score; score columns of the input
are replaced; labels that are null are not used; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import durable
from .words import split_words, text_slices, whole_texts

TEXT_SIZE = 1 << 16
META_SIZE = 1 << 12
SIZES = TEXT_SIZE, META_SIZE
#: Bytes of text whose views are built at once; several numbers stand for each of them.
VIEW_BYTES = 1 << 20
#: Steps of a score for each unit of the mean log ratio.
STEPS = 4096
#: Beyond all steps.
NEVER = 1 << 60
#: Added to counts, in the proportion of the classes, so that an unseen feature weighs nothing.
SMOOTH = 1.0
#: Folds of labelled rows, and how strongly (in the units of a row's squared log-odds) the views' weights lean towards equal ones.
FOLDS = 5
EQUAL = 10.0
PUNCT = np.array([33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in range(256)])


def views(part: pa.RecordBatch) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For the text and for the metadata view: features of all rows in one array, and the rows' offsets in it."""
    n = part.num_rows
    vocabulary, codes, offsets = split_words(part.column("text"))
    words = vocabulary.to_pylist()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) % TEXT_SIZE for w in words), np.int64, len(words))
    end = np.fromiter((xxhash.xxh3_64_intdigest("~" + w[-2:]) % TEXT_SIZE for w in words), np.int64, len(words))
    row = np.repeat(np.arange(n), np.diff(offsets))
    both = np.unique(np.concatenate([row * TEXT_SIZE + own[codes], row * TEXT_SIZE + end[codes]]))
    text = both % TEXT_SIZE, np.concatenate([[0], np.cumsum(np.bincount(both // TEXT_SIZE, minlength=n))])

    texts = whole_texts(part.column("text"))
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), np.uint8)
    at = np.repeat(np.arange(n), size)
    lines = np.bincount(at[data == 10], minlength=n) + 1
    punct = np.bincount(at[PUNCT[data]], minlength=n)
    n_words = np.diff(offsets)
    distinct = np.bincount(np.unique(row * max(len(words), 1) + codes) // max(len(words), 1), minlength=n)
    log2 = lambda x: np.floor(np.log2(x + 1)).astype(np.int64)
    given = lambda c: part.column(c) if c in part.schema.names else pa.nulls(n, pa.string())
    columns = {
        "lang": given("lang"),
        "source": given("source"),
        "bytes": log2(size),
        "lines": log2(lines),
        "line": log2(size / lines),
        "words": log2(n_words),
        "punct": np.floor(20 * punct / np.maximum(size, 1)).astype(np.int64),
        "distinct": np.floor(10 * distinct / np.maximum(n_words, 1)).astype(np.int64),
    }
    meta = np.empty((n, len(columns)), np.int64)
    for j, (name, values) in enumerate(columns.items()):
        coded = pa.array(values).dictionary_encode("encode")
        hashed = np.array([xxhash.xxh3_64_intdigest(f"{name}={v}") % META_SIZE for v in coded.dictionary.to_pylist()], np.int64)
        meta[:, j] = hashed[coded.indices.to_numpy()]
    return text, (meta.reshape(-1), np.arange(n + 1) * len(columns))


def means(features: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> np.ndarray:
    """The mean weight of each row's features; 0 without features."""
    flat, offsets = features
    n = np.diff(offsets)
    return np.bincount(np.repeat(np.arange(len(n)), n), weights[flat], len(n)) / np.maximum(n, 1)


def feature_counts(rows: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """How many bad and how many good documents have each feature; the last column counts the documents."""
    out = np.zeros((2, size + 1), np.int64)
    for y in (0, 1):
        own = [r for r, z in zip(rows, labels, strict=True) if z == y]
        out[y, :size] = np.bincount(np.concatenate([np.zeros(0, np.int64), *own]), minlength=size)
        out[y, size] = len(own)
    return out


def fit_weights(counts: np.ndarray) -> np.ndarray:
    """The log ratio of how often a feature occurs in good and in bad documents."""
    n0, n1 = (max(int(n), 1) for n in counts[:, -1])
    share = n1 / (n1 + n0)
    return np.log((counts[1, :-1] + SMOOTH * share) / n1) - np.log((counts[0, :-1] + SMOOTH * (1 - share)) / n0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, centre: float = 0.0) -> np.ndarray:
    """A small logistic model by Newton's method; slopes are at least 0, the last coefficient is the intercept.

    ``ridge`` pulls the slopes towards ``centre``.  A slope that would become negative is held at 0.
    """
    x = np.column_stack([x, np.ones(len(x))])
    goal, pull = np.full(x.shape[1], centre), np.full(x.shape[1], ridge)
    goal[-1], pull[-1] = 0.0, 1e-2
    free = np.ones(len(goal), bool)
    while True:
        w = np.where(free, goal, 0.0)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = (x.T @ (p - y) + pull * (w - goal))[free]
            hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
            step = np.linalg.solve(hess[free][:, free], grad)
            # damped, so that few and well separated rows don't throw it off
            w[free] -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        negative = free & (w < 0)
        negative[-1] = False
        if not negative.any():
            return w
        free &= ~negative


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    calibrate: list[np.ndarray] = field(default_factory=list)
    combine: np.ndarray | None = None
    prior: float = 1.0
    history: list[dict] = field(default_factory=list)

    def scores(self, text: tuple, meta: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view and their combination."""
        if self.combine is None:
            p = np.full(len(text[1]) - 1, self.prior)
            return p, p, p
        z = [np.clip(means(f, w) * c[0] + c[1], -30, 30) for f, w, c in zip((text, meta), (self.text, self.meta), self.calibrate, strict=True)]
        both = np.column_stack([*z, np.ones(len(z[0]))]) @ self.combine
        return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (*z, both))


def feature_rows(rows: DataFrame, others: list[str], kinds: str) -> DataFrame:
    """``others`` of each row, and the features of its views as 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, max_bytes=VIEW_BYTES):
                lists = [pa.array([x.tobytes() for x in np.split(f.astype(np.uint16), o[1:-1])], pa.binary()) for f, o in views(part)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *lists], [*others, "text_features", "meta_features"])

    return rows.mapInArrow(run, f"{kinds}, text_features binary, meta_features binary")


def batch_views(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for name in ("text_features", "meta_features"):
        data = batch.column(name).to_pylist()
        out.append((np.frombuffer(b"".join(data), np.uint16).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) // 2 for x in data])]).astype(np.int64)))
    return out


@dataclass
class Round:
    """Weights of the views, and for each the steps and shares of them from which its scores count as good or as bad."""

    weights: list[np.ndarray]
    cuts: list[tuple[int, float, int, float]] = field(default_factory=list)


def steps(features: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> np.ndarray:
    return np.floor(means(features, weights) * STEPS).astype(np.int64)


def chosen(both: list, draw: np.ndarray, past: list[Round]) -> list[np.ndarray]:
    """For each view, the label that past rounds gave a row of the pool, or -1."""
    label = [np.full(len(draw), -1) for _ in both]
    for r in past:
        for v in (0, 1):
            own = steps(both[v], r.weights[v])
            good, good_share, bad, bad_share = r.cuts[v]
            free = label[1 - v] < 0
            is_good = (own > good) | ((own == good) & (draw < good_share))
            is_bad = (own < bad) | ((own == bad) & (draw >= 1 - bad_share))
            label[1 - v][free & is_bad] = 0
            label[1 - v][free & is_good] = 1
    return label


def pool_steps(pool: DataFrame, past: list[Round], weights: list[np.ndarray]) -> pa.Table:
    """(view, step, n): how many rows that the other view has not got yet score in each step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in text_slices(batch, "text_features")):
            both = batch_views(part)
            label = chosen(both, part.column("draw").to_numpy(), past)
            for v in (0, 1):
                step, n = np.unique(steps(both[v], weights[v])[label[1 - v] < 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(step), v, np.int32)), pa.array(step), pa.array(n.astype(np.int64))], ["view", "step", "n"])

    return pool.mapInArrow(run, "view int, step bigint, n bigint").groupBy("view", "step").agg(F.sum("n").alias("n")).toArrow()


def pool_counts(pool: DataFrame, past: list[Round]) -> list[np.ndarray]:
    """For each view, ``feature_counts`` of the rows of the pool that it has got."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, size + 1), np.int64) for size in SIZES]
        for part in (p for batch in batches for p in text_slices(batch, "text_features")):
            both = batch_views(part)
            label = chosen(both, part.column("draw").to_numpy(), past)
            for v, (flat, offsets) in enumerate(both):
                of = np.repeat(label[v], np.diff(offsets))
                for y in (0, 1):
                    sums[v][y, :-1] += np.bincount(flat[of == y], minlength=SIZES[v])
                    sums[v][y, -1] += int((label[v] == y).sum())
        for v, x in enumerate(sums):
            y, at = np.nonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v, np.int32)), pa.array(y.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(x[y, at])], ["view", "label", "feature", "n"])

    table = pool.mapInArrow(run, "view int, label int, feature int, n bigint").groupBy("view", "label", "feature").agg(F.sum("n").alias("n")).toArrow()
    view, label, feature, n = (table.column(c).to_numpy() for c in ("view", "label", "feature", "n"))
    out = []
    for v, size in enumerate(SIZES):
        counts = np.zeros((2, size + 1), np.int64)
        counts[label[view == v], feature[view == v]] = n[view == v]
        out.append(counts)
    return out


def cut(step: np.ndarray, n: np.ndarray, want: int) -> tuple[int, float]:
    """The step, counted from the first, in which the ``want``-th row falls, and the share of its rows that are wanted."""
    total = np.cumsum(n)
    i = min(int(np.searchsorted(total, want)), len(n) - 1)
    return int(step[i]), float(min(1.0, (want - (total[i] - n[i])) / n[i]))


def cotrain(text: list[np.ndarray], meta: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, pool: DataFrame, rounds: int, share: float) -> Model:
    """``text``, ``meta``, ``labels``, ``fold``: of the labelled rows; ``share``: of the pool, each round."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(TEXT_SIZE), np.zeros(META_SIZE), prior=float(labels.mean()) if len(labels) else 1.0)
    rows = (text, meta)
    pool = durable(pool, "pool")
    good = float(labels.mean())
    take = max(2, int(share * pool.count()))
    base = [feature_counts(rows[v], labels, SIZES[v]) for v in (0, 1)]
    gained = [np.zeros_like(b) for b in base]
    weights, past, history = [fit_weights(c) for c in base], [], []
    for _ in range(rounds):
        table = pool_steps(pool, past, weights)
        now = Round(weights)
        for v in (0, 1):
            own = table.column("view").to_numpy() == v
            step, n = (table.column(c).to_numpy()[own] for c in ("step", "n"))
            if not len(step):
                now.cuts.append((NEVER, 0.0, -NEVER, 0.0))
                continue
            order = np.argsort(step)
            step, n = step[order], n[order]
            n1, n0 = (min(int(n.sum()), max(1, round(take * p))) for p in (good, 1 - good))
            now.cuts.append((*cut(step[::-1], n[::-1], n1), *cut(step, n, n0)))
            history.append({"from": ("text", "metadata")[v], "good": n1, "bad": n0})
        past.append(now)
        gained = pool_counts(pool, past)
        weights = [fit_weights(b + c) for b, c in zip(base, gained, strict=True)]
    model = Model(*weights, history=history, prior=good)
    z = []
    for v in (0, 1):
        m = out_of_fold(rows[v], labels, fold, base[v] + gained[v], SIZES[v])
        c = logistic(m[:, None], labels.astype(float))
        model.calibrate.append(c)
        z.append(np.clip(m * c[0] + c[1], -30, 30))
    model.combine = logistic(np.column_stack(z), labels.astype(float), EQUAL, 0.5)
    return model


def out_of_fold(rows: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The mean weight of each labelled row, under the weights of ``counts`` less those of the row's own fold."""
    out = np.zeros(len(rows))
    for f in np.unique(fold):
        own = np.flatnonzero(fold == f)
        rest = fit_weights(counts - feature_counts([rows[i] for i in own], labels[own], size))
        out[own] = [rest[rows[i]].mean() if len(rows[i]) else 0.0 for i in own]
    return out


def read_columns(docs: DataFrame) -> list[str]:
    """The columns of ``docs`` that the views read, as far as they are there."""
    return [c for c in ("text", "lang", "source") if c in docs.columns]


def fit(docs: DataFrame, labels: DataFrame, rounds: int = 4, share: float = 0.05, max_labelled: int = 6000) -> Model:
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # the only rows that the driver sees
    docs = docs.select("doc_id", *read_columns(docs))
    rows = docs.join(F.broadcast(some), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    table = feature_rows(rows, ["doc_id", "label", "fold"], f"doc_id {dict(docs.dtypes)['doc_id']}, label int, fold int").toArrow()
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    text, meta = ([np.frombuffer(x, np.uint16).astype(np.int64) for x in table.column(c).take(order).to_pylist()] for c in ("text_features", "meta_features"))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("draw")), F.lit(1 << 30)) / (1 << 30)
    # at most max_labelled ids are broadcast
    others = docs.join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti")
    pool = feature_rows(others.withColumn("draw", draw), ["draw"], "draw double")
    return cotrain(text, meta, table.column("label").to_numpy()[order], table.column("fold").to_numpy()[order], pool, rounds, share)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` with text_score, meta_score, quality_score (probabilities) and kept."""
    names = ["text_score", "meta_score", "quality_score"]
    docs = docs.drop(*names, "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, max_bytes=VIEW_BYTES):
                p = model.scores(*views(part))
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, p), pa.array(p[2] >= threshold)], [*part.schema.names, *names, "kept"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in names), T.StructField("kept", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, text_score, meta_score, quality_score and kept of each document."""
    return score(docs.select("doc_id", *read_columns(docs)), fit(docs, labels, **parameters)).select("doc_id", "text_score", "meta_score", "quality_score", "kept")
