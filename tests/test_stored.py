"""Models as tables against the models they come from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuslake.operators import classify, stored
from statuslake.plans.model_queries import _matrix
from statuslake.plans.views import Source

COLUMNS = ["n_chars", "toxic", "count_feature", "age"]


@pytest.fixture(scope="module")
def matrix(spark, sf_dir):
    return [x.cache() for x in _matrix(Source(spark, sf_dir))]


def test_trees_score_as_the_model(spark, matrix):
    model = classify.gbt(matrix[0], rounds=5)
    nodes = stored.tree_table(spark, model)
    want = {r["id"]: r["p_closed"] for r in classify.p_closed(model.transform(matrix[1])).collect()}
    got = {r["id"]: r["p_closed"] for r in stored.p_closed_by_trees(matrix[1], nodes, COLUMNS).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(set(want.values())) > 5


def test_network_scores_as_the_model(spark, matrix):
    model = classify.network(matrix[0], 4, hidden=(6, 3), iterations=15)
    table = stored.network_table(spark, model)
    rows = stored.network_layers(matrix[1], table, COLUMNS).collect()
    want = {r["id"]: list(r["v"]) for r in classify.embeddings(model, matrix[1], "id").collect()}
    assert all(list(r["hidden"]) == pytest.approx(want[r["id"]], abs=1e-5) for r in rows)
    proba = {r["id"]: r["p_closed"] for r in classify.p_closed(model.transform(matrix[1])).collect()}
    assert all(r["proba"][0] == pytest.approx(proba[r["id"]], abs=1e-7) for r in rows)


def test_trees_of_odd_inputs(spark):
    nodes = spark.createDataFrame([(0, 0, 0, 1.0, 1, 2, None, 2.0), (0, 1, None, None, None, None, 0.25, 2.0), (0, 2, None, None, None, None, -0.5, 2.0), (3, 0, None, None, None, None, 0.1, 1.0)], stored.NODES)
    rows = spark.createDataFrame([(1.0, "a"), (1.5, "b"), (None, "c"), (float("nan"), "d"), (1.0, "a")], "x double, _x string")
    got = sorted((r["_x"], round(r["p_closed"], 9)) for r in stored.p_closed_by_trees(rows, nodes, ["x"]).collect())
    left, right = (round(1 - 1 / (1 + np.exp(-2 * m)), 9) for m in (0.6, -0.9))
    assert got == [("a", left), ("a", left), ("b", right), ("c", right), ("d", right)]
    assert stored.p_closed_by_trees(rows, nodes.where("false"), ["x"]).first()["p_closed"] == 0.5
    assert stored.p_closed_by_trees(rows.where("false"), nodes, ["x"]).count() == 0
    circle = spark.createDataFrame([(0, 0, 0, 1.0, 1, 0, None, 1.0), (0, 1, None, None, None, None, 0.5, 1.0)], stored.NODES)
    with pytest.raises(ValueError):
        stored.p_closed_by_trees(rows, circle, ["x"])


def test_condition_numbers_of_whole_vectors(spark, sf_dir):
    rows = Source(spark, sf_dir)("embed").select("label", F.col("v").cast("array<double>").alias("v")).collect()
    got = {r["label"]: r["condition"] for r in classify.condition_numbers(classify.da_fit(Source(spark, sf_dir)("embed"))).collect()}
    for label in got:
        x = np.array([r["v"] for r in rows if r["label"] == label])
        d = x - x.mean(axis=0)
        e = np.linalg.eigvalsh(d.T @ d / max(len(x) - 1, 1) + 1e-4 * np.eye(x.shape[1]))
        assert got[label] == pytest.approx(e[-1] / e[0], rel=1e-4)
