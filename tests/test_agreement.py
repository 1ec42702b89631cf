"""Agreement joins against all pairs; weighted states against numpy."""

import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statuslake.operators import agreement, weighted


@pytest.mark.parametrize("percent", [50, 60, 80, 100])
def test_jaccard_loses_no_pair(spark, percent):
    r = random.Random(percent)
    text = lambda: r.choice([None, "", "--", " ".join(r.choice("a b c d e f g main street st".split()) for _ in range(r.randrange(1, 8)))]) if r.random() < 0.1 else " ".join(r.choice("a b c d e f g main street st".split()) for _ in range(r.randrange(1, 8)))
    sides = [[text() for _ in range(120)] for _ in (0, 1)]
    a, b = (spark.createDataFrame([(x,) for x in s], "t string") for s in sides)
    sets = [[frozenset(w for w in (x or "").replace("-", " ").split()) for x in s] for s in sides]
    want = {}
    for x in set(sets[0]) - {frozenset()}:
        for y in set(sets[1]) - {frozenset()}:
            if 100 * len(x & y) >= percent * len(x | y):
                want[" ".join(sorted(x)), " ".join(sorted(y))] = (sets[0].count(x), sets[1].count(y), pytest.approx(len(x & y) / len(x | y)))
    got = {(" ".join(r[0]), " ".join(r[1])): tuple(r)[2:] for r in agreement.jaccard_join(a, b, "t", percent).collect()}
    assert got == want
    assert agreement.jaccard_join(a.where("false"), b, "t", percent).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=12), st.text("abcd ", max_size=12))
def test_similarity_as_elsewhere(a, b):
    if a and b:
        assert agreement.jaro_winkler(a, b) == pytest.approx(duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0])
        assert agreement.jaro_winkler(a, b) <= 1


def test_similar_within_is_that_of_all_pairs(spark):
    r = random.Random(3)
    names = ["Blue Cafe", "Blue Cafe #2", "The Blue Caff", "Red House", "Rde House", "x", "", None, "Zebra Grill & Bar", "zebra gril bar"]
    points = [[(i + 1000 * side, r.choice(names), 37.7 + r.random() / 300, -122.4 + r.random() / 300) for i in range(80)] for side in (0, 1)]
    a, b = (spark.createDataFrame(p, "id bigint, name string, lat double, lon double") for p in points)
    from statuslake.operators import spatial

    near = {(x["id"], x["r_id"]) for x in spatial.radius_join(a, b, 100.0).collect()}
    normal = lambda n: "".join(c for c in (n or "").lower() if c.isascii() and (c.isalnum() or c == " ")).strip()
    name = {p[0]: normal(p[1]) for side in points for p in side}
    want = {(i, j) for i, j in near if name[i] and name[j] and agreement.jaro_winkler(name[i], name[j]) >= 0.85}
    assert {(x["id"], x["r_id"]) for x in agreement.similar_within(a, b).collect()} == want and want


def test_weighted_state_by_hand(spark):
    g = np.random.default_rng(1)
    rows = [(int(i % 3), [float(x) for x in g.normal(size=4)], float(g.integers(0, 4))) for i in range(90)]
    df = spark.createDataFrame([*rows, (None, [0.0] * 4, 1.0), (1, None, 1.0), (1, [0.0] * 4, None)], "label int, v array<double>, w double").repartition(5)
    got = {r["label"]: r for r in weighted.fit(df, "v", "label", "w").collect()}
    for c in range(3):
        x, w = (np.array([r[k] for r in rows if r[0] == c and r[2] > 0]) for k in (1, 2))
        m = w @ x / w.sum()
        assert got[c]["n"] == len(x) and got[c]["weight"] == pytest.approx(w.sum())
        assert np.allclose(got[c]["mean"], m) and np.allclose(got[c]["scatter"], ((x - m) * w[:, None]).T @ (x - m))
    assert weighted.fit(df.where("false"), "v", "label", "w").count() == 0
