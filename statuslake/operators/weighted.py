"""Classifier state of noisy labels: every row counts by its weight.

State is a row for each class (label, n, weight, mean, scatter): rows, the sum of their weights, the weighted mean and the
weighted sum of products about it.  Merging is exact, in any order; weights of 1 give the plain state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import MERGE_LANES

STATE = "label bigint, n bigint, weight double, mean array<double>, scatter array<array<double>>"


def _merged(parts: list[tuple]) -> tuple:
    n, w, mean, scatter = parts[0]
    for m, u, mu, s in parts[1:]:
        d = mu - mean
        scatter = scatter + s + np.outer(d, d) * (w * u / (w + u))
        mean = mean + d * (u / (w + u))
        n, w = n + m, w + u
    return n, w, mean, scatter


def fit(rows: DataFrame, vector: str, label: str, weight: str) -> DataFrame:
    """The weighted state.  Rows with a null, or without a positive weight, are left out."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            labels, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(labels), -1) if len(labels) else np.zeros((0, 0))
            for c in np.unique(labels):
                own, u = x[labels == c], w[labels == c]
                mean = u @ own / u.sum()
                part = len(own), float(u.sum()), mean, ((own - mean) * u[:, None]).T @ (own - mean)
                held[int(c)] = _merged([held[int(c)], part]) if int(c) in held else part
        if held:
            yield pa.RecordBatch.from_pylist([{"label": c, "n": n, "weight": w, "mean": m.tolist(), "scatter": s.tolist()} for c, (n, w, m, s) in held.items()])

    known = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull() & (F.col(weight) > 0))
    parts = known.select(F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v"), F.col(weight).cast("double").alias("w")).mapInArrow(partial, STATE)
    # two levels: no task merges the parts of all tasks
    return merge(merge(parts.withColumn("lane", F.spark_partition_id() % MERGE_LANES), by=["label", "lane"]))


def merge(*states: DataFrame, by: list[str] | None = None) -> DataFrame:
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, w, mean, scatter = _merged([(int(n), float(w), np.array(m), np.stack(s)) for n, w, m, s in zip(pdf["n"], pdf["weight"], pdf["mean"], pdf["scatter"], strict=True)])
        return pd.DataFrame([{"label": pdf["label"].iloc[0], "n": n, "weight": w, "mean": mean.tolist(), "scatter": scatter.tolist()}])

    return every.groupBy(*(by or ["label"])).applyInPandas(run, STATE)
