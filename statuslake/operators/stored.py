"""Fitted trees and networks as tables, and their scores from such a table in expressions.

A model is read as a table once (it is as large as its parameters, never as the data) and becomes literals of the plan: scoring
is one projection without a shuffle or a Python worker.  Any engine that reads the table gets the same scores.

Defined results: a null feature goes the way of a value that isn't a number, which is right; a table without rows gives 0.5;
rows are scored each for itself, so repeats score alike; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row a node, the root of each tree is its node 0; leaves have a value and no feature.
NODES = "tree int, node int, feature int, threshold double, l int, r int, value double, weight double"
#: One row a weight: ``source`` is the unit of the layer before, -1 for the bias.
WEIGHTS = "layer int, unit int, source int, w double"


def tree_table(spark: SparkSession, model) -> DataFrame:
    """The nodes of a fitted tree ensemble of ``pyspark.ml`` on continuous features."""
    rows: list[tuple] = []
    for t, (tree, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        nodes, waiting = [None], [(0, tree._call_java("rootNode"))]
        while waiting:
            at, node = waiting.pop()
            if not node.getClass().getSimpleName().startswith("Internal"):
                nodes[at] = (t, at, None, None, None, None, float(node.prediction()), float(weight))
                continue
            split, left = node.split(), len(nodes)
            nodes += [None, None]
            nodes[at] = (t, at, int(split.featureIndex()), float(split.threshold()), left, left + 1, None, float(weight))
            waiting += [(left, node.leftChild()), (left + 1, node.rightChild())]
        rows += nodes
    return spark.createDataFrame(rows, NODES)


def features_of(columns: list[str]) -> Column:
    return F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns))


def margin(x: Column, nodes: DataFrame) -> Column:
    """The weighted sum of the values of the leaves that the array ``x`` reaches."""
    rows = sorted(nodes.select(*(c.split()[0] for c in NODES.split(", "))).collect(), key=lambda r: (r["tree"], r["node"]))
    if not rows:
        return F.lit(0.0)
    place = {(r["tree"], r["node"]): i for i, r in enumerate(rows)}
    leaf = [r["feature"] is None for r in rows]
    left, right = ([i if leaf[i] else place[r["tree"], r[side]] for i, r in enumerate(rows)] for side in "lr")
    depth = [0] * len(rows)
    for (_, node), i in place.items():
        seen, below, steps = {i}, {i}, 0
        while node == 0 and (below := {s for b in below if not leaf[b] for s in (left[b], right[b])}):
            if below & seen:
                raise ValueError("a tree's nodes form a circle")
            seen |= below
            steps += 1
        depth[i] = steps
    roots = [(i, depth[i], rows[i]["weight"]) for (_, node), i in place.items() if node == 0]
    table = F.lit([0 if leaf[i] else r["feature"] for i, r in enumerate(rows)]), F.lit([0.0 if leaf[i] else r["threshold"] for i, r in enumerate(rows)]), F.lit(left), F.lit(right)
    values = F.lit([r["value"] if leaf[i] else 0.0 for i, r in enumerate(rows)])

    def step(node: Column, _: Column) -> Column:
        feature, threshold, lower, upper = (F.get(column, node) for column in table)
        return F.when(F.get(x, feature) <= threshold, lower).otherwise(upper)

    steps = max(1, max(d for _, d, _ in roots))
    trees = F.arrays_zip(F.lit([i for i, _, _ in roots]).alias("root"), F.lit([float(w) for _, _, w in roots]).alias("weight"))
    reached = lambda root: F.aggregate(F.lit(list(range(steps))), root, step)
    return F.aggregate(trees, F.lit(0.0), lambda s, t: s + t["weight"] * F.get(values, reached(t["root"])))


def p_closed_by_trees(rows: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Adds p_closed of boosted trees whose class 1 is open: the logistic function of twice the margin, from 1."""
    out = "_x"
    while out in rows.columns:
        out += "_"
    return rows.withColumn(out, features_of(columns)).withColumn("p_closed", 1 - 1 / (1 + F.exp(-2 * margin(F.col(out), nodes)))).drop(out)


def split_spread(nodes: DataFrame) -> DataFrame:
    """(feature, splits, spread): how often each feature splits, and the weighted variances of its trees' leaf values."""
    spread = nodes.groupBy("tree").agg(F.var_pop(F.when(F.col("feature").isNull(), F.col("value"))).alias("spread"))
    inner = nodes.where("feature IS NOT NULL").join(spread, "tree")
    return inner.groupBy("feature").agg(F.count("*").alias("splits"), F.sum(F.col("weight") * F.col("spread")).alias("spread"))


def network_table(spark: SparkSession, model) -> DataFrame:
    """The weights of a fitted ``classify.network``; standardisation is worked into its first layer."""
    scale, net = model.stages
    layers, flat, at, rows = net.getLayers(), net.weights.toArray(), 0, []
    mean, std = scale.mean.toArray(), scale.std.toArray()
    for k, (a, b) in enumerate(zip(layers[:-1], layers[1:], strict=True), 1):
        w, bias = flat[at : at + a * b].reshape(b, a, order="F").copy(), flat[at + a * b : at + a * b + b].copy()
        at += a * b + b
        if k == 1:
            w = w * [1 / s if s > 0 else 0.0 for s in std]
            bias = bias - w @ mean
        rows += [(k, u, s, float(w[u, s])) for u in range(b) for s in range(a)] + [(k, u, -1, float(bias[u])) for u in range(b)]
    return spark.createDataFrame(rows, WEIGHTS)


def network_layers(rows: DataFrame, weights: DataFrame, columns: list[str], name: str = "hidden") -> DataFrame:
    """Adds the last hidden layer (``name``) and ``proba``: logistic units, softmax at the end."""
    table: dict[int, dict[int, dict[int, float]]] = {}
    for r in weights.select("layer", "unit", "source", "w").collect():
        table.setdefault(r["layer"], {}).setdefault(r["unit"], {})[r["source"]] = r["w"]
    out, n = rows.withColumn(name, features_of(columns)), len(columns)
    for k in sorted(table):
        units = [table[k][u] for u in sorted(table[k])]
        matrix = F.lit([[u.get(s, 0.0) for s in range(n)] for u in units])
        biases = F.lit([u.get(-1, 0.0) for u in units])
        total, n = F.zip_with(matrix, biases, lambda w, b: F.aggregate(F.zip_with(w, name, lambda x, y: x * y), b, lambda s, p: s + p)), len(units)
        if k < max(table):
            out = out.withColumn(name, F.transform(total, lambda z: 1 / (1 + F.exp(-z))))
        else:
            out = out.withColumn("proba", total).withColumn("proba", F.transform("proba", lambda z: F.exp(z - F.array_max("proba"))))
            out = out.withColumn("proba", F.transform("proba", lambda e: e / F.aggregate("proba", F.lit(0.0), lambda s, p: s + p)))
    return out
