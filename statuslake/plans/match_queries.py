"""Spatial joins and entity matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from ..operators import matching, spatial
from .catalogue import query
from .views import Source

D = "sqrt(power((l.lat - r.lat) * 111111.0, 2) + power((l.lon - r.lon) * 111111.0 * cos(radians(37.77)), 2))"
BOX = (-122.52, -122.503, 37.70, 37.712)


@query("SELECT l.id, r.id AS r_id FROM points_l l JOIN points_r r ON abs(l.lon - r.lon) <= 0.0009 AND abs(l.lat - r.lat) <= 0.0009")
def j6_band_join(v: Source) -> DataFrame:
    left, right = (spatial.spots(v(side, ("customer", "part"))) for side in ("points_l", "points_r"))
    met = spatial.band_join(left, right, 0.0009, spatial.many_parts(left))
    return spatial.expanded(met).select("id", "r_id")


@query(f"SELECT l.id, r.id AS r_id, round({D}, 3) AS dist_m FROM points_l l JOIN points_r r ON {D} <= 100")
def j7_radius_join(v: Source) -> DataFrame:
    left, right = (spatial.spots(v(side, ("customer", "part"))) for side in ("points_l", "points_r"))
    met = spatial.radius_join(left, right, 100.0, parts=spatial.many_parts(left))
    return spatial.expanded(met.withColumn("dist_m", F.round("dist_m", 3))).select("id", "r_id", "dist_m")


@query(f"""SELECT id, r_id FROM (SELECT l.id, r.id AS r_id, row_number() OVER (PARTITION BY l.id ORDER BY round({D}, 6), r.id) AS rn FROM points_l l JOIN points_r r ON {D} <= 15
    WHERE contains(l.name, r.name) OR contains(r.name, l.name)) WHERE rn = 1""")
def m2_substring_matches(v: Source) -> DataFrame:
    """Best match within 15 m of those whose names hold one another: decided without string similarity."""
    pairs = spatial.radius_join(v("points_l"), v("points_r"), 15.0).where(F.contains("name", F.col("r_name")) | F.contains("r_name", F.col("name")))
    best = pairs.groupBy("id").agg(F.min_by("r_id", F.struct(F.round("dist_m", 6), "r_id")).alias("r_id"))
    return best


def _matches(v: Source) -> DataFrame:
    return matching.best_match(v("points_l"), v("points_r"))


@query()
def m2_best_match(v: Source) -> DataFrame:
    return _matches(v).select("id", "r_id", F.round("nsim", 6).alias("nsim"), F.round("lsim", 6).alias("lsim"), F.round("dist_m", 3).alias("dist_m"))


def _report(v: Source) -> DataFrame:
    m = matching.address_gate(_matches(v).withColumn("a", F.when(F.col("id") % 3 > 0, F.concat(F.lit("Street "), "id"))).withColumn("b", F.concat(F.lit("Street "), (F.col("r_id") - 1000000).cast("string"))), "a", "b", 0.8)
    return matching.report(v("points_l").withColumn("open", F.when(F.col("status") == "permanently_closed", 0).otherwise(1)), m)


@query()
def m3_m6_match_report(v: Source) -> DataFrame:
    return _report(v).select("id", "open", "r_id", "r_closed", "match_status")


@query()
def m8_match_summary(v: Source) -> DataFrame:
    return matching.match_summary(_report(v))


_STALE = "CAST(DATE '2001-08-02' - CAST(o_orderdate AS DATE) AS BIGINT)"


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS label FROM orders WHERE o_orderkey % 2 = 1 OR {_STALE} <= 700")
def m4_m7_staleness_transfer(v: Source) -> DataFrame:
    t = F.col("o_orderdate").cast("timestamp")
    rows = v("orders").withColumn("r_closed", F.col("o_orderkey") % 2 == 0)
    rows = rows.withColumn("stale_days", matching.staleness(F.col("r_closed"), t, F.lit("2001-08-02 00:00:00").cast("timestamp")))
    return matching.transfer_labels(rows, limit=700).select(F.col("o_orderkey").alias("id"), "label")


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND {_STALE} <= 700 THEN 0 ELSE 1 END AS label FROM orders")
def m7_relabelled(v: Source) -> DataFrame:
    """Stale closures become open instead of being left out."""
    t = F.col("o_orderdate").cast("timestamp")
    rows = v("orders").withColumn("r_closed", F.col("o_orderkey") % 2 == 0)
    rows = rows.withColumn("stale_days", matching.staleness(F.col("r_closed"), t, F.lit("2001-08-02 00:00:00").cast("timestamp")))
    return matching.transfer_labels(rows, limit=700, relabel=True).select(F.col("o_orderkey").alias("id"), "label")


@query(f"SELECT id, name, lat, lon, CASE WHEN lower(status) IN ('permanently_closed', 'closed') THEN 0 ELSE 1 END AS open FROM flat_places WHERE lon BETWEEN {BOX[0]} AND {BOX[1]} AND lat BETWEEN {BOX[2]} AND {BOX[3]}")
def m9_area_labels(v: Source) -> DataFrame:
    return matching.area(v.places(), BOX)


@query()
def m10_two_phase_probe(v: Source) -> DataFrame:
    table, _ = matching.probe(v("points_l"), v("points_r"), 0.00045, [50.0, 65.0, 80.0, 95.0], F.col("r_closed") == (F.col("status") == "permanently_closed"))
    return table


@query()
def m11_cascade(v: Source) -> DataFrame:
    near = v("points_l").withColumn("locality", F.floor(F.col("lat") * 200).cast("string"))
    far = v("points_r").withColumn("locality", F.floor(F.col("lat") * 200).cast("string"))
    return matching.cascade(near, far).select("id", "match_type", "r_id", F.round("nsim", 6).alias("nsim"))


_SWEEP = """WITH c AS (SELECT i AS id, -122.52 + (i % 8 + 0.5) * 0.017 / 8 AS lon, 37.70 + (i // 8 + 0.5) * 0.012 / 8 AS lat FROM (SELECT unnest(generate_series(0, 63)) AS i)),
  f AS (SELECT l.id AS cell, r.id, row_number() OVER (PARTITION BY l.id ORDER BY round($, 6), r.id) AS rn FROM c l JOIN points_r r ON $ <= 120)
  SELECT id, min(cell) AS first_cell, count(*) AS found_by FROM f WHERE rn <= 50 GROUP BY id""".replace("$", D)


@query(_SWEEP)
def m12_m13_grid_sweep(v: Source) -> DataFrame:
    points = v("points_r")
    return spatial.sweep(spatial.grid_centres(points, (-122.52, -122.503, 37.70, 37.712), 8), points, 120.0)


# the same operators on names whose similarity SQL can tell: place by place

_SIM = "CASE WHEN l.name = r.name THEN CAST(1 AS DOUBLE) ELSE 0.4 * (21 - hamming(l.name, r.name)) / 21.0 + 0.6 * (10 - hamming(l.name[1:10], r.name[1:10])) / 10.0 END"
_NAMED_PAIRS = f"SELECT l.id, r.id AS r_id, l.name, l.status, r.closed AS r_closed, {_SIM} AS nsim, {D} AS d FROM named_l l JOIN named_r r ON {D} <= 100"
_NAMED = f"SELECT id, r_id, r_closed, nsim, 1 - d / 100 AS lsim, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(nsim, 9) DESC, d, r_id) AS rn FROM ({_NAMED_PAIRS})) WHERE rn = 1 AND nsim >= 0.75 - 1e-12 AND d <= 15"


@query(f"SELECT id, r_id, round(nsim, 6) AS nsim, round(lsim, 6) AS lsim, round(d, 3) AS dist_m FROM ({_NAMED})")
def m2_named_match(v: Source) -> DataFrame:
    m = matching.best_match(v("named_l"), v("named_r"))
    return m.select("id", "r_id", F.round("nsim", 6).alias("nsim"), F.round("lsim", 6).alias("lsim"), F.round("dist_m", 3).alias("dist_m"))


def _named_report(v: Source) -> DataFrame:
    """Addresses are names, too: those of the records beside the matched ones; every third place has none."""
    beside = lambda name, shift: v(name).select((F.col("id") + shift).alias("id"), F.col("name").alias("address"))
    m = matching.best_match(v("named_l"), v("named_r")).join(beside("named_l", 1).where("id % 3 > 0"), "id", "left")
    m = m.join(beside("named_r", 0).withColumnsRenamed({"id": "r_id", "address": "r_address"}), "r_id", "left")
    gated = matching.address_gate(m, "address", "r_address", 0.75)
    return matching.report(v("named_l").withColumn("open", F.when(F.col("status") == "permanently_closed", 0).otherwise(1)), gated)


_NAMED_REPORT = f"""SELECT p.id, CASE WHEN p.status = 'permanently_closed' THEN 0 ELSE 1 END AS open, m.r_id, m.r_closed,
    CASE WHEN m.r_id IS NULL THEN 'no_match' WHEN l.name IS NOT NULL AND NOT ({_SIM} >= 0.75 - 1e-12) THEN 'address_rejected' ELSE 'matched' END AS match_status
  FROM named_l p LEFT JOIN ({_NAMED}) m ON m.id = p.id LEFT JOIN named_l l ON l.id = m.id - 1 AND m.id % 3 > 0 LEFT JOIN named_r r ON r.id = m.r_id"""


@query(_NAMED_REPORT)
def m3_m6_named_report(v: Source) -> DataFrame:
    return _named_report(v).select("id", "open", "r_id", "r_closed", "match_status")


@query(f"""SELECT count(*) AS n, count(*) FILTER (WHERE match_status = 'matched') AS matched, count(*) FILTER (WHERE match_status = 'matched' AND (open = 0) = r_closed) AS agree,
  count(*) FILTER (WHERE match_status = 'matched' AND (open = 0) <> r_closed) AS disagree, count(*) FILTER (WHERE match_status = 'no_match') AS no_match, count(*) FILTER (WHERE match_status = 'address_rejected') AS rejected FROM ({_NAMED_REPORT})""")
def m8_named_summary(v: Source) -> DataFrame:
    return matching.match_summary(_named_report(v))


_BAND = "FROM named_l l JOIN named_r r ON abs(l.lon - r.lon) <= 0.00045 AND abs(l.lat - r.lat) <= 0.00045"


@query(f"""SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE s >= t) AS kept, count(*) FILTER (WHERE s < t) AS dropped, count(DISTINCT CASE WHEN s >= t THEN id END) AS keys, count(*) FILTER (WHERE s >= t AND same) AS agree
  FROM (SELECT l.id, 100.0 * (21 - hamming(l.name, r.name)) / 21 AS s, coalesce(r.closed = (l.status = 'permanently_closed'), false) AS same {_BAND}), (SELECT unnest([50.0, 65.0, 80.0, 95.0]) AS t) GROUP BY t""")
def m10_named_probe(v: Source) -> DataFrame:
    table, _ = matching.probe(v("named_l"), v("named_r"), 0.00045, [50.0, 65.0, 80.0, 95.0], F.col("r_closed") == (F.col("status") == "permanently_closed"))
    return table


_PLACED = "(SELECT *, CAST(floor(lat * 200) AS VARCHAR) AS locality FROM $)"


@query(f"""WITH g AS (SELECT id, r_id, nsim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(nsim, 9) DESC, r_id) AS rn FROM (SELECT l.id, r.id AS r_id, {_SIM} AS nsim FROM named_l l JOIN named_r r ON {D} <= 20)) WHERE rn = 1 AND nsim >= 0.55 - 1e-12),
  n AS (SELECT id, r_id, nsim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(nsim, 9) DESC, r_id) AS rn FROM (SELECT l.id, r.id AS r_id, {_SIM} AS nsim FROM {_PLACED.replace('$', 'named_l')} l JOIN {_PLACED.replace('$', 'named_r')} r ON l.locality = r.locality)) WHERE rn = 1 AND nsim >= 0.75 - 1e-12)
  SELECT p.id, CASE WHEN g.id IS NOT NULL THEN 'geo' WHEN n.id IS NOT NULL THEN 'name' ELSE 'none' END AS match_type, coalesce(g.r_id, n.r_id) AS r_id, round(coalesce(g.nsim, n.nsim), 6) AS nsim FROM named_l p LEFT JOIN g ON g.id = p.id LEFT JOIN n ON n.id = p.id""")
def m11_named_cascade(v: Source) -> DataFrame:
    placed = lambda name: v(name).withColumn("locality", F.floor(F.col("lat") * 200).cast("string"))
    return matching.cascade(placed("named_l"), placed("named_r"), radius=20.0).select("id", "match_type", "r_id", F.round("nsim", 6).alias("nsim"))


@query(f"""SELECT l.id, round({_SIM}, 6) AS similarity, round(100.0 * (21 - hamming(l.name, r.name)) / 21, 6) AS token_sort, round({_SIM}, 6) AS sql_similarity FROM named_l l JOIN named_r r ON r.id = l.id + 1000000""")
def f20_f21_m1_v1_named(v: Source) -> DataFrame:
    """Each place against its own registry record: the library's columns and the functions registered for SQL."""
    similarity.register(v.spark)
    pairs = v("named_l").join(v("named_r").select((F.col("id") - 1000000).alias("id"), F.col("name").alias("other")), "id")
    return pairs.select("id", F.round(similarity.name_similarity(F.col("name"), F.col("other")), 6).alias("similarity"), F.round(similarity.token_sort_ratio(F.col("name"), F.col("other")), 6).alias("token_sort"), F.round(F.call_function("name_ratio", "name", "other"), 6).alias("sql_similarity"))


_CITY = """WITH f AS (SELECT l.cell, r.id, r.closed, row_number() OVER (PARTITION BY l.cell ORDER BY round($, 6), r.id) AS rn FROM cities l JOIN wide_r r ON $ <= 50000),
  o AS (SELECT id, closed, min(cell) AS city FROM f WHERE rn <= 50 GROUP BY id, closed)
  SELECT city, count(*) AS found, count(*) FILTER (WHERE closed) AS closed FROM o GROUP BY city""".replace("$", D)


@query(_CITY)
def m13_city_sweep(v: Source) -> DataFrame:
    return matching.city_sweep(v("cities"), v("wide_r"))
