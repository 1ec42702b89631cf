"""Validation operators against numpy."""

import math

import numpy as np
import pytest

from statuslake.operators import classify, validate


def cloud(seed, n, d=6, classes=3):
    r = np.random.default_rng(seed)
    label = r.integers(0, classes, n)
    x = r.normal(size=(n, d)).round(2) + 2 * label[:, None]
    x[n // 2 :: 7] = x[0]  # copies: equal distances
    return [(int(i), [float(z) for z in x[i]], int(label[i])) for i in range(n)]


@pytest.mark.parametrize("pivots, first, cell", [(8, 1, 4096), (1, 3, 4096), (30, 0, 4096), (4, 1, 16)])
def test_nearest_is_that_of_all_pairs(spark, monkeypatch, pivots, first, cell):
    """Few and many cells, cells cut into blocks, ties, and rows that can't take part."""
    monkeypatch.setattr(validate, "CELL_ROWS", cell)
    rows = cloud(pivots, 180)
    df = spark.createDataFrame([*rows, (None, [0.0] * 6, 1), (999, None, 1), (998, [0.0] * 5 + [None], 1), (997, [float("nan")] * 6, 0)], "id bigint, v array<double>, label int").repartition(3)
    x = np.array([r[1] for r in rows])
    got = {}
    for r in validate.nearest(df, "id", "v", 5, pivots=pivots, first=first).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["near"], r["distance"]))
    assert sorted(got) == [r[0] for r in rows]
    for i, found in got.items():
        d = np.sqrt(((x[i] - x) ** 2).sum(1))
        want = sorted((d[j], j) for j in range(len(x)) if j != i)[:5]
        assert [(k, n) for k, n, _ in sorted(found)] == [(k + 1, j) for k, (_, j) in enumerate(want)]
    few = df.where("id < 3")
    assert sorted((r["id"], r["near"]) for r in validate.nearest(few, "id", "v", 5).collect()) == [(a, b) for a in range(3) for b in range(3) if a != b]
    assert validate.nearest(df.where("false"), "id", "v", 5).count() == 0


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-3, 1e6), (1e18, 0.0), (1e-9, 0.0)])
def test_nearest_among_copies_and_odd_values(spark, monkeypatch, scale, offset):
    """More copies than neighbours, spread over several bins; values beyond single precision and far from the origin."""
    monkeypatch.setattr(validate, "CELL_ROWS", 40)
    x = np.array([r[1] for r in cloud(5, 200)]) * scale + offset
    x[::3] = x[1]
    df = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "id bigint, v array<double>").repartition(3)
    got = {}
    for r in validate.nearest(df, "id", "v", 4, pivots=6, first=1).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["near"]))
    for i in range(len(x)):
        d = np.sqrt(((x[i] - x) ** 2).sum(1))
        want = sorted((d[j], j) for j in range(len(x)) if j != i)[:4]
        assert sorted(got[i]) == [(k + 1, j) for k, (_, j) in enumerate(want)]


def test_small_cells_share_a_bin():
    """So a row that can skip no cell is sent once for each bin, not once for each cell."""
    centres = np.arange(12.0)[:, None]
    start, pieces, bins = validate._bins([3, 3, 3, 0, 25, *[3] * 7], centres, 10)
    assert len(bins) == 3 + 4 and pieces[4] == 3 and pieces[3] == 0
    assert sorted(c for b in bins for c in set(b)) == [0, 1, 2, 4, 4, 4, *range(5, 12)]
    assert all(c in bins[start[c] + i] for c in range(12) for i in range(pieces[c]))
    assert validate._bins([0, 0], centres[:2], 10) == ([0, 0], [0, 0], [])


def test_copies_that_are_nobodys_neighbours():
    x = np.array([[0.0, 1.0]] * 5 + [[-0.0, 1.0]] + [[2.0, 1.0]] * 2)
    assert validate._few_copies(x, np.array([9, 8, 7, 6, 5, 4, 3, 2]), 2).tolist() == [3, 4, 5, 6, 7]


def test_silhouettes_are_those_of_all_pairs(spark):
    rows = cloud(2, 90) + [(900, [9.0] * 6, 7)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int")
    got = {r["id"]: r["silhouette"] for r in validate.silhouettes(df, classify.da_fit(df), "v", "label").collect()}
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for k, (i, _, c) in enumerate(rows):
        d = ((x[k] - x) ** 2).sum(1)
        if (y == c).sum() == 1:
            assert got[i] == 0
            continue
        a, b = d[y == c].sum() / ((y == c).sum() - 1), min(d[y == o].mean() for o in set(y.tolist()) - {c})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_subtraction_undoes_the_merge(spark):
    """The state of the rows outside each fold equals a fit without the fold; a class within one fold has no row there."""
    rows = cloud(3, 120) + [(900, [5.0] * 6, 9), (901, [6.0] * 6, 9)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int")
    dealt, states = validate.fold_states(df, "v", "label", "id", folds=5)
    fold = {r["id"]: r["fold"] for r in dealt.collect()}
    got = {(r["fold"], r["label"]): r for r in states.collect()}
    want = 0
    for f in range(5):
        for c in {r[2] for r in rows}:
            x = np.array([r[1] for r in rows if r[2] == c and fold[r[0]] != f])
            if len(x):
                want += 1
                m = x - x.mean(0)
                assert got[f, c]["n"] == len(x) and np.allclose(got[f, c]["mean"], x.mean(0)) and np.allclose(got[f, c]["scatter"], m.T @ m, atol=1e-6)
    assert want == len(got)


def test_permutations_move_whole_columns(spark):
    rows = [(f"k{i}", float(i), None if i % 9 == 0 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, a double, b int")
    got = validate.permuted(df, ["a", "b"], "id").collect()
    assert len(got) == 300 and sorted(r["a_permuted"] for r in got) == sorted(r["a"] for r in got)
    assert sum(r["b_permuted"] is None for r in got) == sum(r["b"] is None for r in got)
    assert sum(r["a_permuted"] == r["a"] for r in got) < 15
    assert {r["id"]: r["a_permuted"] for r in validate.permuted(df.repartition(5), ["a"], "id").collect()} == {r["id"]: r["a_permuted"] for r in got}


def test_temperature_is_the_best_one(spark):
    r = np.random.default_rng(4)
    z = r.normal(size=(400, 4)) * 3
    p = np.exp(z / 2.5) / np.exp(z / 2.5).sum(1, keepdims=True)
    y = [int(r.choice(4, p=q)) for q in p]
    df = spark.createDataFrame([([float(x) for x in a], b) for a, b in zip(z, y)] + [(None, 1)], "z array<double>, y int")
    t = validate.fit_temperature(df, "z", "y")
    loss = lambda t: -np.mean([(a / t)[b] - math.log(np.exp(a / t).sum()) for a, b in zip(z, y)])
    assert loss(t) <= min(loss(t * 1.001), loss(t / 1.001)) and 2 < t < 3.2


def test_normalised_by_hand(spark):
    train = spark.createDataFrame([(x, 1.0) for x in (0.0, 1.0, 1.0, 1.0, 3.0)] + [(None, 1.0)], "a double, b double")
    table = validate.fit_quantiles(train, ["a", "b"], 4)
    rows = spark.createDataFrame([(x, 1.0) for x in (-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 9.0, None)], "a double, b double")
    got = [(r["a"], r["b"]) for r in validate.normalised(rows, table, ["a", "b"]).collect()]
    assert [a for a, _ in got] == [0.0, 0.0, 0.125, 0.5, 0.875, 1.0, 1.0, None] and all(b == 0.5 for _, b in got)


def test_gate(spark):
    r = np.random.default_rng(8)
    frame = lambda shift: spark.createDataFrame([(int(i % 2), [float(x) for x in r.normal(size=3) + shift]) for i in range(400)], "label int, v array<double>")
    states = {name: classify.da_fit(frame(s)) for name, s in (("a", 0), ("b", 0), ("c", 3))}
    same = spark.createDataFrame([((i % 10) / 10 + 0.05,) for i in range(200)], "p double")
    got = {x["release"]: x for x in validate.drift_gate(states, {n: same for n in states}, "a", "p").collect()}
    assert got["b"]["decision"] == "keep" and got["c"]["decision"] == "refit" and got["b"]["psi"] == 0
    old, new = ({x["label"]: x for x in states[k].collect()} for k in "ac")
    for x in validate.gaussian_divergence(states["a"], states["c"]).collect():
        (s, n), (t, m) = ((np.array(q["scatter"]) / (q["n"] - 1) + 1e-4 * np.eye(3), np.array(q["mean"])) for q in (old[x["label"]], new[x["label"]]))
        want = 0.5 * (np.trace(np.linalg.solve(s, t)) + (m - n) @ np.linalg.solve(s, m - n) - 3 + math.log(np.linalg.det(s) / np.linalg.det(t)))
        assert x["kl"] == pytest.approx(want)
