"""Scalar functions, features, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features, similarity
from ..functions import scalar as S
from ..operators import matching, profile
from ..sources import io
from .catalogue import query
from .views import REFERENCE, Source

DAYS = "CAST(floor((epoch_us(TIMESTAMP '2001-08-02 00:00:00') - epoch_us(try_cast(replace(update_time, 'Z', '') AS TIMESTAMP))) / 86400000000) AS BIGINT)"

#: The features of a place from its flat form.
FEATURES_SQL = f"""
WITH s AS (SELECT *, lower(dataset) AS ds, {DAYS} AS age FROM flat_sources),
g AS (SELECT k, count(*) AS n, max(CASE WHEN ds = 'meta' THEN 1 ELSE 0 END) AS meta, min(CASE WHEN ds = 'meta' THEN 1 ELSE 0 END) AS only_meta, max(CASE WHEN ds = 'microsoft' THEN 1 ELSE 0 END) AS micro,
      max(source_confidence) AS hi, min(source_confidence) AS lo, avg(source_confidence) AS mean, min(age) FILTER (WHERE ds = 'microsoft') AS ms_age,
      count(age) FILTER (WHERE ds <> 'meta') AS n_time, min(age) FILTER (WHERE ds <> 'meta') AS lo_age, max(age) FILTER (WHERE ds <> 'meta') AS hi_age FROM s GROUP BY k),
p AS (SELECT f.*, coalesce(n, 0) AS n, coalesce(meta, 0) AS meta, coalesce(only_meta, 0) AS only_meta, coalesce(micro, 0) AS micro, coalesce(hi, 0) AS hi, coalesce(lo, 0) AS lo, coalesce(mean, 0) AS mean,
      CAST(coalesce(ms_age, -1) AS DOUBLE) AS ms_age, coalesce(n_time, 0) AS n_time, CAST(coalesce(lo_age, -1) AS DOUBLE) AS lo_age, CAST(coalesce(hi_age, -1) AS DOUBLE) AS hi_age,
      CASE WHEN n_web > 0 THEN 1 ELSE 0 END AS w, CASE WHEN n_phone > 0 THEN 1 ELSE 0 END AS ph, CASE WHEN n_social > 0 THEN 1 ELSE 0 END AS so, CASE WHEN has_brand THEN 1 ELSE 0 END AS br
      FROM flat_places f LEFT JOIN g USING (k))
SELECT id, status AS operating_status, CAST(n AS INT) AS source_count, meta AS has_meta, micro AS has_microsoft, CAST(only_meta AS INT) AS has_only_meta, hi AS max_source_confidence, lo AS min_source_confidence, round(mean, 6) AS mean_source_confidence,
  round(hi - lo, 6) AS confidence_spread, ms_age AS msft_update_age_days, CASE WHEN ms_age BETWEEN 0 AND 365 THEN 1 ELSE 0 END AS msft_fresh, CAST(n_time AS INT) AS n_sources_with_update_time, lo_age AS min_update_age_days, hi_age AS max_update_age_days,
  round(mean * n, 6) AS conf_x_source, CASE WHEN n = 1 THEN 1 ELSE 0 END AS has_single_source, w AS has_website, ph AS has_phone, so AS has_socials, br AS has_brand, coalesce(n_web, 0) AS website_count, coalesce(n_phone, 0) AS phone_count,
  CAST(w + ph + so + br AS DOUBLE) / 4 AS completeness_score, coalesce(category, 'unknown') AS primary_category, CASE WHEN n_alt > 0 THEN 1 ELSE 0 END AS has_alternate_categories, n_alt AS alternate_category_count, coalesce(confidence, 0) AS confidence,
  CASE WHEN NOT has_address THEN CAST(0 AS DOUBLE) WHEN postcode IS NULL THEN CAST(0.75 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS address_completeness FROM p"""


def place_features(v: Source) -> DataFrame:
    return features.place_features(v.places(), REFERENCE)


@query(FEATURES_SQL)
def g1_g4_place_features(v: Source) -> DataFrame:
    out = place_features(v)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_source_confidence", "confidence_spread", "conf_x_source")})


@query("""SELECT certificate, CAST(greatest(DATE '2001-08-02' - start_day, 0) AS DOUBLE) AS age_days, CAST(length(dba_name) AS INT) AS name_length, CAST(len(string_split(dba_name, ' ')) AS INT) AS name_words,
  CASE WHEN naics IS NULL OR naics = '' THEN 0 ELSE 1 END AS has_naics, CASE WHEN city IS NULL OR city = '' THEN 0 ELSE 1 END AS has_city, CASE WHEN lower(trim(city)) = 'san francisco' THEN 1 ELSE 0 END AS in_city,
  CASE WHEN parking_tax = 'true' THEN 1 ELSE 0 END AS parking_tax, CAST(year(start_day) AS INT) AS start_year, CAST(month(start_day) AS INT) AS start_month, CAST(day(start_day) AS INT) AS start_dom,
  coalesce(nullif(naics, ''), 'unknown') AS category, CASE WHEN coalesce(end_day <= DATE '2001-08-02', false) THEN 0 ELSE 1 END AS open FROM registry""")
def g5_g8_registry_features(v: Source) -> DataFrame:
    return features.registry_features(v("registry"), REFERENCE)


@query("""WITH c AS (SELECT coalesce(end_day <= DATE '2001-08-02', false) AS a, admin_closed IS NOT NULL AND admin_closed <> '' AS o, coalesce(location_end_day <= DATE '2001-08-02', false) AS l FROM registry)
  SELECT a AS closed_a, a OR o AS closed_b, l AS closed_c, a OR o OR l AS closed_d, count(*) AS n FROM c GROUP BY ALL""")
def g6_label_strategies(v: Source) -> DataFrame:
    return features.registry_labels(v("registry"), REFERENCE).groupBy("closed_a", "closed_b", "closed_c", "closed_d").agg(F.count("*").alias("n"))


@query("""SELECT 'yelp:' || business_id AS id, name, nullif(lower(replace(trim(string_split(categories, ',')[1]), ' ', '_')), '') AS category,
  CAST(len(list_filter(string_split(categories, ','), lambda x: trim(x) <> '')) AS INT) AS n_categories, round(least(ln(1 + review_count) / ln(501), 1), 6) AS confidence, state AS region, CASE WHEN is_open = 1 THEN 'open' ELSE 'permanently_closed' END AS status, is_open AS open FROM yelp""")
def g7_f11_f13_yelp_places(v: Source) -> DataFrame:
    p = features.yelp_places(v("yelp"))
    n = F.when(F.col("categories.primary").isNull(), 0).otherwise(1 + F.size("categories.alternate"))
    return p.select("id", F.col("names.primary").alias("name"), F.col("categories.primary").alias("category"), n.alias("n_categories"), F.round("confidence", 6).alias("confidence"), S.first_of("addresses", "region").alias("region"), F.col("operating_status").alias("status"), "open")


@query(f"SELECT count(*) AS n, round(sum(address_completeness), 4) AS total, CAST(sum(website_count) AS BIGINT) AS websites FROM ({FEATURES_SQL.replace(chr(10) + 'WITH s AS', 'WITH s AS')})")
def g9_v3_feature_spec(v: Source) -> DataFrame:
    out = features.PLACE_SPEC.select(v.places(), "id", with_confidence=True, exclude=("has_meta",))
    return out.agg(F.count("*").alias("n"), F.round(F.sum("address_completeness"), 4).alias("total"), F.sum("website_count").alias("websites"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f2_json_path(v: Source) -> DataFrame:
    return v("events").select("event_id", S.json_path("props", "$.k").cast("bigint").alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def f1_f3_json_array(v: Source) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, "not json").otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    got = S.json_array(text, "array<struct<k: bigint>>")
    back = S.json_array(S.as_json(got), "array<struct<k: bigint>>")
    return v("events").select("event_id", F.size(back).alias("n"), F.get(back, F.lit(0))["k"].alias("k"))


@query(f"SELECT k, idx, {DAYS} AS days, CAST(greatest({DAYS}, 0) AS DOUBLE) AS clamped FROM flat_sources WHERE update_time <> 'bad' UNION ALL SELECT k, idx, NULL, CAST(-5 AS DOUBLE) FROM flat_sources WHERE update_time = 'bad'")
def f4_f6_ages(v: Source) -> DataFrame:
    at = F.lit(REFERENCE).cast("timestamp")
    t = S.iso_timestamp(F.col("update_time"))
    return v("flat_sources").select("k", "idx", S.whole_days(t, at).alias("days"), S.age_days(t, at, -5.0).alias("clamped"))


@query("SELECT o_orderkey, o_orderdate AS at FROM orders")
def f5_polymorphic_time(v: Source) -> DataFrame:
    t = F.col("o_orderdate").cast("timestamp")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.unix_millis(t).cast("string")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    return v("orders").select("o_orderkey", S.any_timestamp(text).cast("timestamp_ntz").alias("at"))


@query("""WITH n AS (SELECT p_partkey, trim(regexp_replace(lower('The ' || p_name || ' Inc.'), '[^a-z0-9 ]', '', 'g')) AS nm, p_name FROM part)
  SELECT p_partkey, nm, string_split(nm, ' ')[2] AS first, contains(nm, p_name) OR contains(p_name, nm) AS inside, p_partkey || '/' || p_name AS joined FROM n""")
def f8_f12_f19_names(v: Source) -> DataFrame:
    nm = S.normal_name(F.concat(F.lit("The "), "p_name", F.lit(" Inc.")))
    joined = S.join_filled("/", F.col("p_partkey").cast("string"), F.lit(""), F.col("p_name"))
    return v("part").select("p_partkey", nm.alias("nm"), S.first_word(nm).alias("first"), S.contains_either(nm, F.col("p_name")).alias("inside"), joined.alias("joined"))


@query("""SELECT id, round(sqrt(power((lat - 37.7) * 111111.0, 2) + power((lon + 122.52) * 111111.0 * cos(radians(37.77)), 2)), 4) AS d,
  round(greatest(0, 1 - sqrt(power((lat - 37.7) * 111111.0, 2) + power((lon + 122.52) * 111111.0 * cos(radians(37.77)), 2)) / 100), 6) AS near, CAST(round_even(confidence * 20, 0) AS DOUBLE) AS half_even FROM flat_places""")
def f14_f16_f23_distance(v: Source) -> DataFrame:
    lat, lon = S.midpoint("bbox")
    d = S.distance_metres(lat, lon, F.lit(37.7), F.lit(-122.52))
    return v.places().select("id", F.round(d, 4).alias("d"), F.round(S.decay(d, 100), 6).alias("near"), S.half_even(F.col("confidence") * 20).alias("half_even"))


@query("SELECT k, max(update_time) AS latest, count(source_confidence) AS known, max(CASE WHEN dataset = 'meta' THEN 1 ELSE 0 END) = 1 AS has_meta FROM flat_sources GROUP BY k")
def f17_f22_array_functions(v: Source) -> DataFrame:
    s = F.col("sources")
    known = F.size(F.filter(F.transform(s, lambda x: x["confidence"]), lambda c: c.isNotNull())).cast("bigint")
    return v.places().where(F.size(s) > 0).select("k", S.latest(s, "update_time").alias("latest"), known.alias("known"), F.array_contains(F.transform(s, lambda x: x["dataset"]), "meta").alias("has_meta"))


@query("SELECT id, coalesce(nullif(category, ''), 'none') AS category FROM flat_places")
def f18_empty_aware_default(v: Source) -> DataFrame:
    return v.places().select("id", S.or_default(F.col("categories.primary"), F.lit("none"), F.lit("")).alias("category"))


@query("SELECT year(start_day) AS year, count(*) AS n, round(avg((end_day - start_day) / 365.25), 6) AS years FROM registry GROUP BY 1")
def f7_years(v: Source) -> DataFrame:
    at = lambda c: F.col(c).cast("timestamp")
    return v("registry").groupBy(F.year("start_day").cast("bigint").alias("year")).agg(F.count("*").alias("n"), F.round(F.avg(S.years(at("start_day"), at("end_day"))), 6).alias("years"))


@query("SELECT id, round(1 / (1 + exp(toxic - n_chars / 10000)), 6) AS p FROM labeled")
def f24_softmax(v: Source) -> DataFrame:
    return v("labeled").select("id", F.round(F.get(S.softmax(F.array(F.col("n_chars") / 10000, "toxic")), F.lit(0)), 6).alias("p"))


@query("SELECT id, lower(hex(encode(id))) AS geometry FROM flat_places")
def s13_hex(v: Source) -> DataFrame:
    return io.hex_binaries(v.places().select("id", "geometry"))


@query("SELECT id, coalesce(confidence, 0) AS confidence, coalesce(n_web, 0) AS n_web, coalesce(n_phone, 0) AS n_phone, 1 AS open FROM flat_places")
def s14_normaliser(v: Source) -> DataFrame:
    return io.normalised(v.places(), 1).select("id", "confidence", F.size("websites").alias("n_web"), F.size("phones").alias("n_phone"), "open")


@query("SELECT k, min_by(update_time, idx) AS whole FROM flat_sources GROUP BY k")
def m5_primary_update(v: Source) -> DataFrame:
    return v.places().where(F.size("sources") > 0).select("k", matching.primary_update(F.col("sources")).alias("whole"))


@query()
def f20_f21_m1_v1_similarities(v: Source) -> DataFrame:
    """All parts against the part that follows: the library's columns and the functions registered for SQL agree."""
    similarity.register(v.spark)
    a = v("part").select("p_partkey", "p_name")
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    pairs = a.join(b, "p_partkey")
    return pairs.select("p_partkey", "p_name", "other", F.round(similarity.name_similarity(F.col("p_name"), F.col("other")), 6).alias("similarity"), F.round(similarity.token_sort_ratio(F.col("p_name"), F.col("other")), 6).alias("token_sort"), F.round(F.call_function("name_ratio", "p_name", "other"), 6).alias("sql_similarity"))


@query("SELECT id, n_web > 0 AS present FROM flat_places WHERE n_web IS NOT NULL UNION ALL SELECT id, false FROM flat_places WHERE n_web IS NULL")
def p14_is_present(v: Source) -> DataFrame:
    return v.places().select("id", F.coalesce(S.is_present(F.to_json("websites")), F.lit(False)).alias("present"))


@query("SELECT 'city' AS field, count(*) FILTER (WHERE city IS NULL OR city = '') AS nulls, count(*) FILTER (WHERE city <> '') AS filled FROM registry UNION ALL SELECT 'naics', count(*) FILTER (WHERE naics IS NULL OR naics = ''), count(*) FILTER (WHERE naics <> '') FROM registry UNION ALL SELECT 'admin_closed', count(*) FILTER (WHERE admin_closed IS NULL OR admin_closed = ''), count(*) FILTER (WHERE admin_closed <> '') FROM registry")
def a11_p15_null_profile(v: Source) -> DataFrame:
    return profile.null_profile(v("registry"), ["city", "naics", "admin_closed"])
