"""Name blocks and bounds against comparing every pair."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from statuslake.functions.similarity import indel, indels, may_reach, prepared
from statuslake.operators import matching

WORDS = "the a blue red door cafe café joe's joes taqueria taqeria bar grill 7 x le petit pettit bistro bistrot of corner corne".split()


def similarity(a, b):
    norm = lambda s: re.sub("[^a-z0-9 ]", "", (s or "").lower()).strip()
    first = lambda s: next((w for w in s.split() if w not in ("the", "a", "an")), s.split()[0] if s.split() else "")
    x, y = norm(a), norm(b)
    if not x or not y:
        return 0.0
    if x in y or y in x:
        return 1.0
    return 0.4 * SequenceMatcher(None, x, y).ratio() + 0.6 * SequenceMatcher(None, first(x), first(y)).ratio()


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(4)
    name = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))
    odd = ["The Blue Door", "Blue Door", None, "", "!!", "7", "x", "the", "Ünïq"]
    rows = [[(i, n, rng.choice("pq") if i % 9 else None) for i, n in enumerate(odd + [name() for _ in range(110)])] for _ in range(2)]
    return [spark.createDataFrame(r, "id bigint, name string, locality string") for r in rows]


def test_no_pair_is_lost(sides):
    left, right = sides
    for least in (0.75, 0.5, 0.9):
        got = {(r["id"], r["r_id"]): r["nsim"] for r in matching.named_pairs(left, right, least).collect()}
        want = {(a["id"], b["id"]): s for a in left.collect() for b in right.collect() if a["locality"] and a["locality"] == b["locality"] and (s := similarity(a["name"], b["name"])) >= least}
        assert got == pytest.approx(want) and len(want) > 50


def test_bounds_never_dismiss(sides):
    pairs = sides[0].select("name", prepared(F.col("name")).alias("x")).crossJoin(sides[1].select(F.col("name").alias("other"), prepared(F.col("name")).alias("y")))
    for least in (0.4, 0.75):
        rows = pairs.select("name", "other", may_reach(F.col("x"), F.col("y"), least).alias("may")).collect()
        assert all(r["may"] for r in rows if similarity(r["name"], r["other"]) >= least)
        assert sum(not r["may"] for r in rows) > len(rows) / 5


def test_cascade_finds_names_with_articles(spark):
    place = lambda name, at: spark.createDataFrame([(1, name, at, at, "town")], "id bigint, name string, lat double, lon double, locality string")
    got = matching.cascade(place("The Blue Door", 1.0), place("Blue Door", 2.0)).first()
    assert (got["match_type"], got["r_id"], got["nsim"]) == ("name", 1, 1.0)


def common(a, b):
    """Length of the longest common subsequence by its table."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            above = row[j]
            row[j] = diagonal + 1 if x == y else max(above, row[j - 1])
            diagonal = above
    return row[-1]


def test_indel_equals_the_table():
    rng = random.Random(9)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert indel(a, b) == (100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b)))


def test_indels_of_a_batch_equal_single_ones():
    rng = random.Random(10)
    text = lambda: "".join(rng.choice("abcé😀 \0") for _ in range(rng.choice((0, 1, 5, 30, 63, 64, 65, 130))))
    a, b = [text() for _ in range(3000)], [text() for _ in range(3000)]
    assert indels(a, b).tolist() == [indel(x, y) for x, y in zip(a, b, strict=True)]
    assert indels([], []).tolist() == []


def test_crowded_locality_keeps_its_pairs(spark):
    """Names that share nearly all their grams, and short ones inside long ones."""
    names = ["caf", "ca", "c", "cafe", "cafe bar", "the cafe bar of the corner"] + [f"cafe bar {i}" for i in range(60)]
    left = spark.createDataFrame([(i, n, "town") for i, n in enumerate(names)], "id bigint, name string, locality string")
    got = {(r["id"], r["r_id"]): r["nsim"] for r in matching.named_pairs(left, left, 0.75).collect()}
    want = {(i, j): s for i, a in enumerate(names) for j, b in enumerate(names) if (s := similarity(a, b)) >= 0.75}
    assert got == pytest.approx(want)
