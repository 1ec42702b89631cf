"""Hand-made edge cases of scalar functions, features and evaluation."""

import math
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from statuslake.functions import features, similarity
from statuslake.functions import scalar as S
from statuslake.operators import assembly, classify, evaluate, matching, profile, relational, spatial
from statuslake.sources import io

PLACE = """id string, names struct<primary string>, confidence double, categories struct<primary string, alternate array<string>>, websites array<string>, socials array<string>, phones array<string>,
brand struct<names struct<primary string>>, addresses array<struct<freeform string, locality string, postcode string, region string, country string>>,
sources array<struct<dataset string, record_id string, update_time string, confidence double, property string>>, operating_status string"""


def place(id_, sources, brand=None, addresses=()):
    return (id_, ("n",), None, (None, None), None, [], ["1"], brand, list(addresses), sources, "open")


def src(dataset, time, confidence=None):
    return (dataset, "r", time, confidence, "")


def test_place_features(spark):
    rows = [
        place("none", None),
        place("empty", []),
        place("case", [src("Microsoft", "2001-08-01T00:00:00Z", 0.5), src("META", "2001-07-01", 0.7)], ((None,),), [("f", "l", None, "r", "c")]),
        place("meta", [src("meta", "2001-08-01T00:00:00")]),
        place("late", [src("microsoft", "2001-08-02T00:00:01Z")]),
        place("bad", [src("Other", "not a time"), src("Other", "2001-08-01T00:00:00")]),
    ]
    got = {r["id"]: r for r in features.place_features(spark.createDataFrame(rows, PLACE), "2001-08-02 00:00:00").collect()}
    for k in ("none", "empty"):
        r = got[k]
        assert (r["source_count"], r["max_source_confidence"], r["msft_update_age_days"], r["min_update_age_days"], r["msft_fresh"], r["has_only_meta"]) == (0, 0.0, -1.0, -1.0, 0, 0)
    case = got["case"]
    assert (case["has_meta"], case["has_microsoft"], case["has_brand"], case["address_completeness"], case["msft_update_age_days"], case["n_sources_with_update_time"]) == (1, 1, 1, 0.75, 1.0, 1)
    assert got["meta"]["has_only_meta"] == 1 and got["meta"]["n_sources_with_update_time"] == 0
    assert got["late"]["msft_update_age_days"] == -1.0
    assert got["bad"]["n_sources_with_update_time"] == 1
    assert len(features.PLACE_SPEC.names(with_confidence=True)) == 27
    assert got["case"].__fields__[2:] and len(got["case"]) == 29


def test_names(spark):
    pairs = [("Panda Express", "Panda Express #1234"), ("The Regency House", "Regency House Bingo"), ("", "x"), ("éé", "x"), ("Blue Cafe", "Bleu Coffee"), (None, "a")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(similarity.name_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and got[2] == 0.0 and got[3] == 0.0 and got[5] == 0.0
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    assert got[1] == pytest.approx(0.4 * ratio("the regency house", "regency house bingo") + 0.6)
    assert got[4] == pytest.approx(0.4 * ratio("blue cafe", "bleu coffee") + 0.6 * ratio("blue", "bleu"))
    assert similarity.indel("abc", "abc") == 100 and similarity.indel("ab", "cd") == 0 and similarity.indel("", "") == 100


def test_scalars(spark):
    df = spark.createDataFrame([("Restaurants, Italian Food, ", 0), ("", 5000)], "c string, n int")
    got = df.select(S.comma_list(F.col("c")).alias("l"), S.review_confidence(F.col("n")).alias("r")).select(S.head(F.col("l")), S.tail(F.col("l")), "r").collect()
    assert tuple(got[0]) == ("restaurants", ["italian_food"], 0.0) and tuple(got[1]) == (None, [], 1.0)
    d = spark.createDataFrame([(15.0,), (16.0,), (200.0,)], "d double").select(S.decay(F.col("d"), 100)).collect()
    assert [round(r[0], 6) for r in d] == [0.85, 0.84, 0.0]
    t = spark.createDataFrame([("996692645123",), ("2001-08-01T19:04:05.999Z",), ("x",), (None,)], "t string").select(S.any_timestamp(F.col("t")).cast("string")).collect()
    assert t[0][0].startswith("2001-08-01 19:04:05") and t[1][0] == "2001-08-01 19:04:05" and t[2][0] is None and t[3][0] is None
    assert spark.createDataFrame([(" ",), ("[]",), ("a",), (None,)], "x string").where(S.is_present(F.col("x"))).count() == 1


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (None,)], "x double")
    assert [r[0] for r in df.select(profile.left_closed(F.col("x"), [0, 1, 2])).collect()] == [0, 1, 1, None, None]
    assert [r[0] for r in df.select(profile.right_closed(F.col("x"), [0, 1, 2])).collect()] == [0, 1, 2, 2, None]


def test_split_quotas(spark):
    rows = [(str(i), int(i >= 313)) for i in range(313 + 3112)]
    df = spark.createDataFrame(rows, "id string, open int")
    held = assembly.stratified(df, "open", "id", 20).where("held").groupBy("open").count().collect()
    assert {r[0]: r[1] for r in held} == {0: 63, 1: 622}
    assert assembly.open_needed(20, 50, 10) == 130 and assembly.open_needed(1, 500, 10) == 0


def test_evaluation_edges(spark):
    tied = spark.createDataFrame([("m", y, 0.4) for y in (0, 1, 1, 0)], "model string, y int, p_closed double")
    assert evaluate.auc(tied).first()["auc"] == 0.5
    assert evaluate.best_f1(tied).first()["threshold"] == 0.01
    none = spark.createDataFrame([("m", 1, 0.0), ("m", 0, 0.0)], "model string, y int, p_closed double")
    got = evaluate.best_f1(none).first()
    assert (got["threshold"], got["f1"]) == (0.5, 0.0)
    assert evaluate.rates(evaluate.confusion(none, 0.5, "model")).first()["precision"] == 0.0


def test_state_merges_exactly(spark):
    import numpy as np

    rng = np.random.default_rng(42)
    rows = [(i, int(i >= 50), rng.normal(size=8).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, label int, v array<double>")
    full = classify.da_fit(df)
    for cut in (1, 60, 150):
        parts = classify.da_merge(classify.da_fit(df.where(f"id >= {cut}")), classify.da_fit(df.where(f"id < {cut}")))
        d = classify.state_difference(full, parts).first()
        assert d["mean_diff"] < 1e-6 and d["scatter_diff"] < 1e-6 and d["n_diff"] == 0
    x = np.array([r[2] for r in rows if r[1] == 1])
    got = {r["label"]: r for r in full.collect()}[1]
    assert np.allclose(got["mean"], x.mean(0)) and np.allclose(got["scatter"], np.cov(x.T) * (len(x) - 1))
    means = {r["label"]: r for r in classify.ncm_merge(classify.ncm_fit(df.where("id < 70")), classify.ncm_fit(df.where("id >= 70"))).collect()}
    assert np.allclose(means[1]["mean"], x.mean(0)) and means[1]["n"] == 150
    p = classify.predict(classify.qda_proba(df, full)).first()
    assert math.isclose(sum(p["proba"]), 1.0) and p["prediction"] in (0, 1)
    assert {r["label"] for r in classify.condition_numbers(full).collect()} == {0, 1}


def test_grid_join_is_brute_force(spark):
    import random

    random.seed(3)
    pts = [(i, -122.5 + random.random() / 100, 37.7 + random.random() / 100) for i in range(150)]
    a = spark.createDataFrame(pts[:80], "id int, lon double, lat double")
    b = spark.createDataFrame(pts[80:], "id int, lon double, lat double")
    scale = 111111.0 * math.cos(math.radians(37.77))
    want = {(p[0], q[0]) for p in pts[:80] for q in pts[80:] if math.hypot((p[2] - q[2]) * 111111.0, (p[1] - q[1]) * scale) <= 150}
    assert {(r["id"], r["r_id"]) for r in spatial.radius_join(a, b, 150.0).collect()} == want
    band = {(p[0], q[0]) for p in pts[:80] for q in pts[80:] if abs(p[1] - q[1]) <= 0.001 and abs(p[2] - q[2]) <= 0.001}
    assert {(r["id"], r["r_id"]) for r in spatial.band_join(a, b, 0.001).collect()} == band


def test_address_gate_and_not_in(spark):
    m = spark.createDataFrame([(1, "5 Main St", "5 Main St"), (2, None, "x"), (3, "5 Main", "77 Oak")], "id int, a string, b string")
    assert [r["address_ok"] for r in matching.address_gate(m, "a", "b", 0.8).orderBy("id").collect()] == [True, True, False]
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert relational.not_in(left, spark.createDataFrame([(1,), (None,)], "k int"), "k").count() == 0
    assert [r[0] for r in relational.not_in(left, spark.createDataFrame([(1,)], "k int"), "k").collect()] == [2]
    assert relational.not_in(left, spark.createDataFrame([], "k int"), "k").count() == 3


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", -122.5, 37.7, bytes([1, 255]), float("nan"))], "id string, lon double, lat double, geometry binary, confidence double")
    io.write_geojson(rows, f"{tmp_path}/g", "lon", "lat", ["id"])
    assert tuple(io.geojson_lines(spark, f"{tmp_path}/g", "id: string").first()) == ("a", -122.5, 37.7)
    assert io.hex_binaries(rows).first()["geometry"] == "01ff"
    assert io.normalised(rows, 0).first()["confidence"] == 0.0
    io.write_json_lines(rows.select("id"), f"{tmp_path}/j", 1)
    assert tuple(io.json_lines(spark, f"{tmp_path}/j", "id string, open int").first()) == ("a", 1)
    assert [r["name"] for r in io.describe_schema(rows).collect()][0] == "id"


def test_softmax_scores_long_documents(spark):
    from statuslake.plans.scalar_queries import f24_softmax

    rows = spark.createDataFrame([("a", 50_000.0, 5.0), ("b", 100_000.0, 1.0), ("c", 2e8, 0.0)], "id string, n_chars double, toxic double")
    assert {r["id"]: r["p"] for r in f24_softmax(lambda _: rows).collect()} == {"a": 0.5, "b": 0.999877, "c": 1.0}
