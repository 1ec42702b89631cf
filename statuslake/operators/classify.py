"""Classifiers whose state is a mergeable aggregate, and the tree and network models of ``pyspark.ml``.

State is a short table: one row for each class (label, n, mean, scatter).  Fitting, updating and merging are groupings;
only the table, classes times dimensions squared, is ever brought to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import softmax
from ..sources import io


# nearest class mean


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def ncm_fit(rows: DataFrame, vector: str = "v", label: str = "label") -> DataFrame:
    """(label, n, mean): each task sends one row a class. Rows without a vector or a label are left out."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            codes, x = coded.indices.to_numpy(), _matrix(batch.column(1))
            for i, c in enumerate(coded.dictionary.to_pylist()):
                own = x[codes == i]
                n, total = held.get(c, (0, 0.0))
                held[c] = n + len(own), total + own.sum(axis=0)
        if held:
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([(t / n).tolist() for n, t in held.values()], pa.list_(pa.float64()))], ["label", "n", "mean"])

    known = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return ncm_merge(known.mapInArrow(partial, f"label {dict(known.dtypes)['label']}, n bigint, mean array<double>"))


def ncm_merge(*states: DataFrame) -> DataFrame:
    """The state of all rows together; a class may be new in any of them."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    each = every.select("label", "n", F.posexplode("mean").alias("pos", "m"))
    sums = each.groupBy("label", "pos").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"))
    return sums.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def ncm_proba(rows: DataFrame, state: DataFrame, vector: str = "v", temperature: float = 1.0) -> DataFrame:
    """Adds labels and probabilities (arrays in the order of labels): softmax of minus the squared distance."""
    table = state.agg(F.sort_array(F.collect_list(F.struct("label", "mean"))).alias("_s"))  # a row of classes x dimensions
    v = F.col(vector).cast("array<double>")
    out = rows.crossJoin(F.broadcast(table))
    scores = F.transform("_s", lambda s: -squared_distance(v, s["mean"]))
    return out.withColumn("labels", F.transform("_s", lambda s: s["label"])).withColumn("proba", softmax(scores, temperature)).drop("_s")


def predict(scored: DataFrame) -> DataFrame:
    """Adds prediction: the label of the greatest probability, the first among equals."""
    return scored.withColumn("prediction", F.get("labels", (F.array_position("proba", F.array_max("proba")) - 1).cast("int")))


def state_summary(state: DataFrame) -> DataFrame:
    """n and the norm of the mean of each class."""
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x))
    return state.select("label", "n", F.round(norm, 6).alias("norm"))


def condition_numbers(state: DataFrame, ridge: float = 1e-4) -> DataFrame:
    """(label, n, condition): of each class's regularised covariance."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            cond = [np.linalg.cond(np.stack(s) / max(n - 1, 1) + ridge * np.eye(len(s))) for s, n in zip(df["scatter"], df["n"], strict=True)]
            yield pd.DataFrame({"label": df["label"], "n": df["n"], "condition": cond})

    return state.select("label", "n", "scatter").mapInPandas(run, "label bigint, n bigint, condition double")


# discriminant analysis

STATE = "label bigint, n bigint, mean array<double>, scatter array<array<double>>"


def _merge(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    n, mean, scatter = parts[0]
    for m, mu, s in parts[1:]:
        d = mu - mean
        scatter = scatter + s + np.outer(d, d) * (n * m / (n + m))
        mean = mean + d * (m / (n + m))
        n += m
    return n, mean, scatter


def da_fit(rows: DataFrame, vector: str = "v", label: str = "label") -> DataFrame:
    """State with scatter: each task reduces its batches to one part a class; the parts are merged by class."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            x = _matrix(batch.column(1))
            for c in np.unique(labels):
                own = x[labels == c]
                mean = own.mean(axis=0)
                part = (len(own), mean, (own - mean).T @ (own - mean))
                held[int(c)] = _merge([held[int(c)], part]) if int(c) in held else part
        rows_ = [{"label": c, "n": n, "mean": m.tolist(), "scatter": s.tolist()} for c, (n, m, s) in held.items()]
        if rows_:
            yield pa.RecordBatch.from_pylist(rows_)

    parts = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(partial, STATE)
    # two levels: no task merges the parts of all tasks
    return da_merge(da_merge(parts.withColumn("part", F.spark_partition_id() % MERGE_LANES), by=["label", "part"]))


#: Lanes in which the parts of a class are merged before the lanes are.
MERGE_LANES = 64


def da_merge(*states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The exact state of all rows together; order and grouping don't matter."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, scatter = _merge([(int(r.n), np.array(r.mean_), np.stack(r.scatter)) for r in pdf.rename(columns={"mean": "mean_"}).itertuples()])
        return pd.DataFrame([{"label": pdf["label"].iloc[0], "n": n, "mean": mean.tolist(), "scatter": scatter.tolist()}])

    return every.groupBy(*(by or ["label"])).applyInPandas(merge, STATE)


def _collected(state: DataFrame) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    return sorted(((r["label"], r["n"], np.array(r["mean"]), np.array(r["scatter"])) for r in state.collect()), key=lambda x: x[0])


def pooled_covariance(got: list[tuple[int, int, np.ndarray, np.ndarray]], ridge: float = 1e-4) -> np.ndarray:
    n = sum(x[1] for x in got)
    return sum(x[3] for x in got) / max(n - len(got), 1) + ridge * np.eye(len(got[0][2]))


def slda_proba(rows: DataFrame, state: DataFrame, vector: str = "v") -> DataFrame:
    """Adds labels and probabilities of the shared-covariance model. Weights are solved once and go out as literals."""
    got = _collected(state)
    cov, n = pooled_covariance(got), sum(x[1] for x in got)
    w = np.linalg.solve(cov, np.stack([x[2] for x in got]).T).T
    b = [-0.5 * float(x[2] @ wi) + float(np.log(x[1] / n)) for x, wi in zip(got, w, strict=True)]
    v = F.col(vector).cast("array<double>")
    scores = [F.aggregate(F.zip_with(v, F.lit(wi.tolist()), lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p) + bi for wi, bi in zip(w, b, strict=True)]
    return rows.withColumn("labels", F.lit([int(x[0]) for x in got])).withColumn("proba", softmax(F.array(*scores)))


def qda_proba(rows: DataFrame, state: DataFrame, vector: str = "v", ridge: float = 0.1) -> DataFrame:
    """Adds labels and probabilities with a covariance for each class; where it degenerates, log determinant 1e6."""
    got = _collected(state)
    n = sum(x[1] for x in got)
    parts = []
    for _, k, mean, scatter in got:
        cov = scatter / max(k - 1, 1) + ridge * np.eye(len(mean))
        sign, logdet = np.linalg.slogdet(cov)
        parts.append((mean, np.linalg.inv(cov), logdet if sign > 0 else 1e6, np.log(k / n)))
    labels = [int(x[0]) for x in got]

    @F.pandas_udf("array<double>")
    def proba(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float)
        s = np.stack([-0.5 * np.einsum("ij,jk,ik->i", x - m, inv, x - m) - 0.5 * ld + pr for m, inv, ld, pr in parts], axis=1)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return pd.Series((e / e.sum(axis=1, keepdims=True)).tolist())

    return rows.withColumn("labels", F.lit(labels)).withColumn("proba", proba(F.col(vector).cast("array<double>")))


def state_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Greatest absolute difference of means and scatter matrices of two states."""
    both = a.alias("a").join(b.alias("b"), "label")
    mean = F.array_max(F.zip_with("a.mean", "b.mean", lambda x, y: F.abs(x - y)))
    has = "scatter" in a.columns
    scatter = F.array_max(F.zip_with(F.flatten("a.scatter"), F.flatten("b.scatter"), lambda x, y: F.abs(x - y))) if has else F.lit(0.0)
    return both.agg(F.max(mean).alias("mean_diff"), F.max(scatter).alias("scatter_diff"), F.max(F.abs(F.col("a.n") - F.col("b.n"))).alias("n_diff"))


# models of pyspark.ml

#: Parts of a table that a model is fitted on. Trees pass over it more than a thousand times, and a part of a pass is a task that reports to the driver.
PARTS = 64


def dealt(train: DataFrame, key: str) -> DataFrame:
    """``train`` written once, in one order and in equal parts: one for each core and no more than ``PARTS``, however long it is."""
    parts = min(train.sparkSession.sparkContext.defaultParallelism, PARTS)
    return io.written(train.repartition(parts, key).sortWithinPartitions(key), "training").coalesce(parts)


def gbt(train: DataFrame, rounds: int = 300, depth: int = 4, rate: float = 0.05, subsample: float = 0.8, columns: str = "all", label: str = "label", weight: str | None = "weight"):
    """Gradient-boosted trees; ``columns='0.8'`` samples features at each node."""
    from pyspark.ml.classification import GBTClassifier

    model = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, featureSubsetStrategy=columns, seed=42)
    return (model.setWeightCol(weight) if weight else model).fit(train)


def importances(spark, model, names: list[str]) -> DataFrame:
    values = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values, strict=False)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def network(train: DataFrame, n_features: int, label: str = "label", hidden: tuple[int, ...] = (128, 64, 32), iterations: int = 100):
    """Standardised features into a multilayer perceptron."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler

    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    net = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol=label, layers=[n_features, *hidden, 2], maxIter=iterations, seed=42)
    return Pipeline(stages=[scale, net]).fit(train)


def embeddings(model, rows: DataFrame, key: str) -> DataFrame:
    """(key, v): the last hidden layer of a fitted ``network`` for each row."""
    from pyspark.ml.functions import vector_to_array

    scaled, net = model.stages[0].transform(rows), model.stages[-1]
    layers, flat = net.getLayers(), net.weights.toArray()
    mats, at = [], 0
    for a, b in zip(layers[:-1], layers[1:], strict=False):
        mats.append((flat[at : at + a * b].reshape(b, a, order="F"), flat[at + a * b : at + a * b + b]))
        at += a * b + b

    @F.pandas_udf("array<float>")
    def encode(x: pd.Series) -> pd.Series:
        h = np.stack(x.to_numpy())
        for w, b in mats[:-1]:
            h = 1 / (1 + np.exp(-(h @ w.T + b)))
        return pd.Series(h.astype(np.float32).tolist())

    return scaled.select(key, encode(vector_to_array("scaled")).alias("v"))


def p_closed(scored: DataFrame, closed: float = 0.0) -> DataFrame:
    """Adds p_closed from the probability vector of a ``pyspark.ml`` model, labels 0 (closed) and 1."""
    from pyspark.ml.functions import vector_to_array

    return scored.withColumn("p_closed", F.get(vector_to_array("probability"), F.lit(int(closed))))


OPERATING_POINTS = {"recall": 0.15, "balanced": 0.30, "precision": 0.45}


def decide(scored: DataFrame, threshold: float | str) -> DataFrame:
    """Adds predicted_closed at a threshold or a named operating point."""
    t = OPERATING_POINTS[threshold] if isinstance(threshold, str) else threshold
    return scored.withColumn("predicted_closed", (F.col("p_closed") >= t).cast("int"))
