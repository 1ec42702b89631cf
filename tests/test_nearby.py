"""Names first, then points: against comparing every pair, and on crowds whose pairs are too many to form."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from statuslake.functions.similarity import indel
from statuslake.operators import agreement, matching, nearby, spatial
from statuslake.plans import catalogue

from .test_matching import similarity

WORDS = "blue red door cafe bar grill joes corner".split()
COS = math.cos(math.radians(37.77))


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(11)
    name = lambda: rng.choice([None, "", "!"]) if rng.random() < 0.05 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 2)))
    spots = [(37.7 + rng.random() * 2.4e-3, -122.5 + rng.random() * 2.4e-3) for _ in range(60)]
    spot = lambda: rng.choice(spots)
    rows = [[(i, name(), *spot(), "t", i % 3 == 0) for i in range(n)] + [(n, "blue door", None, None, "t", True)] for n in (150, 120)]
    left, right = (spark.createDataFrame(r, "id bigint, name string, lat double, lon double, locality string, shut boolean") for r in rows)
    return left, right.withColumnRenamed("shut", "closed")


def metres(a, b):
    return math.hypot((a["lat"] - b["lat"]) * 111111.0, (a["lon"] - b["lon"]) * 111111.0 * COS)


@pytest.mark.parametrize("nearest, all_names", [(True, 0), (True, 4_000_000), (False, 0)])
def test_best_is_that_of_all_pairs(points, monkeypatch, nearest, all_names):
    monkeypatch.setattr(nearby, "ALL_NAMES", all_names)
    left, right = points
    want = {}
    for a in left.where("lat IS NOT NULL").collect():
        near = [(similarity(a["name"], b["name"]), -metres(a, b) if nearest else 0, -b["id"]) for b in right.where("lat IS NOT NULL").collect() if metres(a, b) <= 100]
        near = [x for x in near if x[0] >= 0.6]
        if near:
            want[a["id"]] = max((round(s, 9), round(d, 6), i) for s, d, i in near)
    got = {r["id"]: (r["nsim"], -r["dist_m"] if nearest else 0, -r["r_id"]) for r in matching.best_nearby(left, right, 100.0, 0.6, nearest).collect()}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


@pytest.mark.parametrize("all_names", [4_000_000, 0])
def test_probe_counts_all_pairs(points, monkeypatch, all_names):
    monkeypatch.setattr(nearby, "ALL_NAMES", all_names)
    left, right = points
    table, best = matching.probe(left, right, 0.00045, [50.0, 80.0], F.col("shut") == F.col("r_closed"))
    words = lambda s: " ".join(sorted((s or "").lower().split()))
    close = lambda a, b: all(abs(a[c] - b[c]) <= 0.00045 for c in ("lat", "lon"))
    pairs = [(a, b, indel(words(a["name"]), words(b["name"]))) for a in left.where("lat IS NOT NULL").collect() for b in right.where("lat IS NOT NULL").collect() if close(a, b)]
    for r in table.collect():
        kept = [(a, b) for a, b, s in pairs if s >= r["threshold"]]
        assert (r["kept"], r["dropped"], r["keys"], r["agree"]) == (len(kept), len(pairs) - len(kept), len({a["id"] for a, _ in kept}), sum(a["shut"] == b["closed"] for a, b in kept))
    chosen = {}
    for a, b, s in pairs:
        chosen[a["id"]] = max(chosen.get(a["id"], (-1, 0)), (s, -b["id"]))
    assert {r["id"]: (r["sim"], -r["r_id"]) for r in best.collect()} == chosen and chosen


@pytest.fixture(scope="module")
def crowd(spark):
    """Two sides of 12,000 points each within some 20 m: 144 million pairs, few names."""
    def side(names, step):
        rows = spark.range(12_000).withColumn("name", F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int")))
        return rows.withColumns({"lat": 37.7 + F.pmod(F.col("id") * step, F.lit(199)) * 1e-6, "lon": -122.5 + F.pmod(F.col("id") * step, F.lit(197)) * 1e-6, "locality": F.lit("t")})

    return side([f"{x} door {i}" for i in range(20) for x in ("blue", "red")], 7), side([f"{x} doors {i}" for i in range(20) for x in ("blue", "red")], 11)


def test_crowd_is_matched_in_time(crowd):
    begun = time.time()
    got = matching.best_match(*crowd)
    assert got.where("nsim > 0.9").count() == 12_000
    assert matching.cascade(*crowd).where("match_type = 'geo'").count() == 12_000
    assert time.time() - begun < 150


def test_only_points_of_similar_names_meet(crowd):
    plan = agreement.similar_within(*crowd)._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Join Inner" in line and "_cx" in line and "name" in line]


def test_points_of_one_spot_meet_once(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SPOT_IDS", 3)
    here = [(i, 37.71, -122.51) for i in range(7)] + [(7, 37.7101, -122.51), (8, None, -122.51), (9, 37.9, -122.51)]
    left, right = (spark.createDataFrame(rows, "id long, lat double, lon double") for rows in (here, [(100 + i, a, b) for i, a, b in here]))
    a, b = spatial.spots(left), spatial.spots(right)
    met = spatial.radius_join(a, b, 100.0, parts=spatial.many_parts(left))
    assert met.count() == 4 * 4 + 1  # three rows of one spot and one of another, and the one far away
    pairs = lambda df: sorted(map(tuple, df.select("id", "r_id", "dist_m").collect()))
    assert pairs(spatial.expanded(met)) == pairs(spatial.radius_join(left, right, 100.0))
    ids = lambda df: sorted(map(tuple, df.select("id", "r_id").collect()))
    assert ids(spatial.expanded(spatial.band_join(a, b, 0.001))) == ids(spatial.band_join(left, right, 0.001))


def test_both_sides_are_read_once(spark, points):
    left, right = points
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(name):
        read.add(1)
        return name

    n = left.count() + right.count()
    matching.best_match(left.withColumn("name", seen("name")), right.withColumn("name", seen("name"))).collect()
    assert read.value == n


def test_pairs_are_not_made_in_the_join_loop(spark, sf_dir):
    """A join's generated loop holds what it makes of one left row: spots, not pairs of ids; and large tables aren't broadcast."""
    usual = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("j6_band_join", "j7_radius_join"):
            plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            last_join = re.search(r"\*\((\d+)\) (?:SortMerge|BroadcastHash)Join \[_cx", plan)[1]
            assert set(re.findall(r"\*\((\d+)\) Generate explode\(r?_?ids", plan)).isdisjoint({last_join})
            assert not re.search(r"BroadcastHashJoin \[c_custkey", plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", usual)


def test_probe_counts_kinds_near_a_spot_once(spark, monkeypatch):
    """3,000 records of four kinds near two spots with 400 places: eight rows meet the places, and all pairs are counted."""
    tables, write = {}, matching.io.written
    monkeypatch.setattr(matching.io, "written", lambda df, name: tables.update({name: write(df, name)}) or tables[name])
    left = spark.range(400).selectExpr("id", "concat('blue door ', id % 2) AS name", "37.7D + id % 2 * 1e-6 AS lat", "-122.5D AS lon", "id % 2 = 0 AS shut")
    right = spark.range(3000).selectExpr("id", "concat('blue door ', id % 2) AS name", "37.7D AS lat", "-122.5D + id * 1e-8 AS lon", "id % 4 < 2 AS closed")
    table, _ = matching.probe(left, right, 0.00045, [50.0, 100.0], F.col("shut") == F.col("r_closed"))
    assert [tuple(r) for r in table.orderBy("threshold").select("threshold", "kept", "dropped", "keys", "agree").collect()] == [(50.0, 1_200_000, 0, 400, 600_000), (100.0, 600_000, 600_000, 400, 300_000)]
    assert tables["near"].count() == 8
