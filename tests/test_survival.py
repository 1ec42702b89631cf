"""Survival operators against plain loops."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statuslake.operators import relational, survival


def test_spells_by_hand(spark):
    rows = [(1, 0, 0), (1, 1, 0), (1, 3, 1), (1, 4, 0), (1, 12, 0), (1, 13, 0), (2, 5, 1), (2, 6, 0), (2, 7, 1), (2, 7, 0), (3, 2, 0), (None, 1, 0), (4, None, 0), (5, 1, None)]
    df = spark.createDataFrame(rows, "id bigint, r int, c int")
    got = sorted(tuple(r) for r in survival.spells(df, "id", "r", "c", max_gap=4).collect())
    assert got == [(1, 1, 0, 3, 3, 1), (1, 2, 4, 4, 0, 0), (1, 3, 12, 13, 1, 0), (2, 2, 6, 7, 1, 1), (3, 1, 2, 2, 0, 0)]
    periods = sorted((r["id"], r["spell"], r["age"], r["release"], r["event"]) for r in survival.person_periods(survival.spells(df, "id", "r", "c")).collect())
    assert periods == [(1, 1, 1, 1, 0), (1, 1, 2, 2, 0), (1, 1, 3, 3, 1), (1, 3, 1, 13, 0), (2, 2, 1, 7, 1)]
    assert survival.spells(df.where("false"), "id", "r", "c").count() == 0


def sample(seed, n=300, times=25, risks=12):
    r = random.Random(seed)
    return [(r.randrange(times), int(r.random() < 0.5), r.randrange(risks) / 4) for _ in range(n)]


def pairs(rows):
    won = tied = all_ = 0
    for t, e, x in rows:
        for u, f, y in rows:
            if e and (u > t or (u == t and not f)):
                all_, won, tied = all_ + 1, won + (x > y), tied + (x == y)
    return won, tied, all_


@pytest.mark.parametrize("range_rows, times, risks", [(10**6, 25, 12), (20, 25, 12), (7, 3, 200), (9, 200, 2), (15, 1, 40)])
def test_concordance_is_that_of_all_pairs(spark, range_rows, times, risks):
    """Few and many ranges, a time or a risk that most rows share, and a null in each column."""
    rows = sample(times, 250, times, risks)
    df = spark.createDataFrame([*rows, (None, 1, 1.0), (1, None, 1.0), (1, 1, None)], "t int, e int, r double")
    got = survival.concordance(df, "t", "e", "r", range_rows=range_rows).first()
    won, tied, all_ = pairs(rows)
    assert (got["concordant"], got["tied"], got["comparable"]) == (won, tied, all_)
    assert got["c_index"] == pytest.approx((won + tied / 2) / all_)


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([], "t int, e int, r double")
    assert survival.concordance(df, "t", "e", "r").first()["c_index"] is None
    assert survival.kaplan_meier(df.withColumn("k", df["t"]), "k", "t", "e").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 2), st.integers(1, 3)), max_size=40))
def test_merge_counts(rows):
    x, y, a, w = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
    want = sum(int(a[i]) * int(w[j]) for i in range(len(rows)) for j in range(len(rows)) if x[j] > x[i] and y[j] < y[i])
    assert survival.dominated(x, y, a, w) == want


@pytest.mark.parametrize("whole", [True, False])
def test_curves_by_hand(spark, monkeypatch, whole):
    """Kaplan-Meier and Brier from plain products, with and without ranges of time."""
    if not whole:
        monkeypatch.setattr(relational, "WHOLE_KEYS", 3)
    rows = [(k, t, e, x / 4) for k in (0, 1) for t, e, x in sample(k + 5, 60, 9)]
    df = spark.createDataFrame(rows, "k int, t int, e int, r double")
    got = {(r["k"], r["time"]): r for r in survival.kaplan_meier(df, "k", "t", "e").collect()}
    for k in (0, 1):
        left = 1.0
        for t in sorted({r[1] for r in rows if r[0] == k}):
            risk, gone = sum(r[0] == k and r[1] >= t for r in rows), sum(r[0] == k and r[1] == t and r[2] for r in rows)
            assert got[k, t]["before"] == pytest.approx(left)
            left *= 1 - gone / risk
            assert (got[k, t]["at_risk"], got[k, t]["events"]) == (risk, gone) and got[k, t]["survival"] == pytest.approx(left, abs=1e-12)
    stay = lambda until, upto: np.prod([1 - sum(r[1] == t and not r[2] for r in rows) / sum(r[1] >= t for r in rows) for t in sorted({r[1] for r in rows}) if (t <= until if upto else t < until)])
    want = np.mean([r[3] ** 2 / stay(r[1], False) if r[1] <= 4 and r[2] else (1 - r[3]) ** 2 / stay(4, True) if r[1] > 4 else 0 for r in rows])
    assert survival.brier(df, "t", "e", "r", 4).first()["brier"] == pytest.approx(want)
