"""Aggregations and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features
from ..operators import profile
from .catalogue import query
from .views import REFERENCE, Source


def _unpivot(sql: str, items: list[str]) -> str:
    return " UNION ALL ".join(sql.replace("$", i) for i in items)


@query("SELECT count(*) AS total, CAST(sum(is_open) AS BIGINT) AS ones, CAST(count(*) - sum(is_open) AS BIGINT) AS zeros FROM yelp")
def a1_label_totals(v: Source) -> DataFrame:
    return profile.label_totals(v("yelp"), "is_open")


@query("SELECT event_type, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM events), 4) AS pct FROM events GROUP BY event_type")
def a2_group_share(v: Source) -> DataFrame:
    return profile.share(v("events"), "event_type")


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS user_id_distinct, count(DISTINCT event_type) AS event_type_distinct FROM events")
def a6_distinct_counts(v: Source) -> DataFrame:
    return profile.distinct_counts(v("events"), "user_id", "event_type")


@query("SELECT naics, count(*) AS n FROM registry GROUP BY naics ORDER BY n DESC, naics NULLS FIRST LIMIT 4")
def a7_top_values(v: Source) -> DataFrame:
    return profile.top_values(v("registry"), "naics", 4)


@query("SELECT category, round(count(*) / (SELECT count(*) FROM labeled), 6) AS fraction FROM labeled GROUP BY category")
def a8_distribution(v: Source) -> DataFrame:
    return profile.distribution(v("labeled"), "category").withColumn("fraction", F.round("fraction", 6))


@query("SELECT category, count(*) AS n, CAST(sum(1 - open) AS BIGINT) AS ones, round(sum(1 - open) / count(*), 6) AS rate FROM labeled GROUP BY category HAVING count(*) >= 10 ORDER BY rate DESC, category LIMIT 15")
def a9_group_rate(v: Source) -> DataFrame:
    return profile.group_rate(v("labeled").withColumn("closed", 1 - F.col("open")), "category", "closed")


@query(_unpivot("SELECT '$' AS field, round(avg(CASE WHEN $ > 0 THEN 1.0 ELSE 0.0 END), 6) AS overall, round(avg(CASE WHEN status = 'open' THEN CASE WHEN $ > 0 THEN 1.0 ELSE 0.0 END END), 6) AS in_open, round(avg(CASE WHEN status = 'permanently_closed' THEN CASE WHEN $ > 0 THEN 1.0 ELSE 0.0 END END), 6) AS in_closed FROM flat_places", ["n_web", "n_phone", "n_social"]))
def a12_field_presence(v: Source) -> DataFrame:
    label = F.when(F.col("operating_status") == "open", 1).when(F.col("operating_status") == "permanently_closed", 0)
    rows = v.places().select(label.alias("open"), *[F.to_json(a).alias(b) for a, b in (("websites", "n_web"), ("phones", "n_phone"), ("socials", "n_social"))])
    return profile.presence(rows, ["n_web", "n_phone", "n_social"], "open")


@query(_unpivot("SELECT '$' AS feature, round(avg($) FILTER (WHERE open = 0), 6) AS mean_closed, round(avg($) FILTER (WHERE open = 1), 6) AS mean_open, round(abs(avg($) FILTER (WHERE open = 0) - avg($) FILTER (WHERE open = 1)) / stddev_samp($), 6) AS effect FROM labeled", ["n_chars", "toxic", "count_feature"]))
def a13_effect_sizes(v: Source) -> DataFrame:
    return profile.effect_sizes(v("labeled"), ["n_chars", "toxic", "count_feature"], "open")


@query("SELECT open, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM labeled), 4) AS pct FROM labeled GROUP BY open")
def a14_class_balance(v: Source) -> DataFrame:
    return profile.share(v("labeled"), "open")


@query("SELECT round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(value), 6) AS mean, max(value) AS max FROM events")
def a15_quantiles(v: Source) -> DataFrame:
    return profile.quantiles(v("events"), "value")


@query("SELECT open, round(avg(age) FILTER (WHERE age <> -1), 6) AS mean, round(median(age) FILTER (WHERE age <> -1), 6) AS median, min(age) FILTER (WHERE age <> -1) AS min, max(age) FILTER (WHERE age <> -1) AS max, round(count(*) FILTER (WHERE age <> -1) / count(*), 6) AS share FROM labeled GROUP BY open")
def a16_class_stats(v: Source) -> DataFrame:
    return profile.class_stats(v("labeled"), "age", "open")


@query("SELECT open, bin, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY open), 4) AS pct FROM (SELECT open, CASE WHEN n_chars >= 0 AND n_chars < 500 THEN 0 WHEN n_chars >= 500 AND n_chars < 2000 THEN 1 WHEN n_chars >= 2000 AND n_chars <= 5000 THEN 2 END AS bin FROM labeled) WHERE bin IS NOT NULL GROUP BY open, bin")
def a17_left_closed_histogram(v: Source) -> DataFrame:
    return profile.histogram(v("labeled"), profile.left_closed(F.col("n_chars"), [0, 500, 2000, 5000]), "open")


@query("SELECT bin, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM (SELECT CASE WHEN p_closed <= 0.25 THEN 0 WHEN p_closed <= 0.5 THEN 1 ELSE 2 END AS bin FROM scored WHERE model = 'b') GROUP BY bin")
def a18_right_closed_histogram(v: Source) -> DataFrame:
    return profile.histogram(v("scored").where("model = 'b'"), profile.right_closed(F.col("p_closed"), [0.25, 0.5, 0.75]))


@query("SELECT CAST(year(start_day) AS INT) AS year, count(*) AS n, min(start_day) AS first, max(start_day) AS last FROM registry WHERE start_day IS NOT NULL GROUP BY 1")
def a19_year_histogram(v: Source) -> DataFrame:
    return profile.year_histogram(v("registry"), "start_day")


@query("SELECT open, count_feature AS bin, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY open), 4) AS pct FROM labeled GROUP BY open, count_feature")
def a20_count_distribution(v: Source) -> DataFrame:
    return profile.histogram(v("labeled"), F.col("count_feature"), "open")


@query("SELECT dataset, count(*) AS entries, count(DISTINCT k) AS places FROM flat_sources GROUP BY dataset")
def a21_exploded_sources(v: Source) -> DataFrame:
    return profile.exploded_sources(v.places())


@query("SELECT naics, count(*) AS n, round(avg(CASE WHEN coalesce(end_day <= DATE '2001-08-02', false) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM registry WHERE naics IN (SELECT naics FROM registry WHERE naics IS NOT NULL GROUP BY naics ORDER BY count(*) DESC, naics LIMIT 3) GROUP BY naics")
def a22_rate_of_largest(v: Source) -> DataFrame:
    return profile.rate_of_largest(features.registry_labels(v("registry"), REFERENCE), "naics", "closed_a", 3)


_STRATEGIES = ["closed_a", "closed_b", "closed_c", "closed_d"]
_PAIRS = [(a, b) for i, a in enumerate(_STRATEGIES) for b in _STRATEGIES[i:]]


@query("WITH s AS (SELECT a AS closed_a, a OR o AS closed_b, l AS closed_c, a OR o OR l AS closed_d FROM (SELECT coalesce(end_day <= DATE '2001-08-02', false) AS a, admin_closed IS NOT NULL AND admin_closed <> '' AS o, coalesce(location_end_day <= DATE '2001-08-02', false) AS l FROM registry)) " + " UNION ALL ".join(f"SELECT '{a}|{b}' AS pair, count(*) FILTER (WHERE {a} AND {b}) AS \"both\", count(*) FILTER (WHERE {a} = {b}) AS agree FROM s" for a, b in _PAIRS))
def a23_strategy_counts(v: Source) -> DataFrame:
    return profile.strategy_counts(features.registry_labels(v("registry"), REFERENCE), _STRATEGIES)


@query("SELECT t AS threshold, count(*) FILTER (WHERE p_closed >= t) AS kept, count(*) FILTER (WHERE NOT p_closed >= t) AS dropped, count(DISTINCT CASE WHEN p_closed >= t THEN category END) AS keys, count(*) FILTER (WHERE p_closed >= t AND y = 1) AS agree FROM scored, (SELECT unnest([CAST(0.25 AS DOUBLE), 0.5, 0.75]) AS t) GROUP BY t")
def a24_threshold_sweep(v: Source) -> DataFrame:
    return profile.threshold_sweep(v("scored"), "p_closed", [0.25, 0.5, 0.75], "category", F.col("y") == 1)


@query("SELECT bucket, count(*) AS n, count(*) FILTER (WHERE y = 1) AS agree, round(count(*) FILTER (WHERE y = 1) / count(*), 6) AS rate FROM (SELECT y, CASE WHEN p_closed >= 0 AND p_closed < 0.5 THEN 0 WHEN p_closed >= 0.5 AND p_closed < 0.75 THEN 1 WHEN p_closed >= 0.75 AND p_closed < 1.01 THEN 2 END AS bucket FROM scored) WHERE bucket IS NOT NULL GROUP BY bucket")
def a25_bucket_agreement(v: Source) -> DataFrame:
    return profile.bucket_agreement(v("scored"), "p_closed", [0, 0.5, 0.75, 1.01], F.col("y") == 1)


@query("SELECT open, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'xx') AS xx FROM labeled GROUP BY open")
def a26_match_pivot(v: Source) -> DataFrame:
    return profile.match_pivot(v("labeled"), "open", "lang", ["en", "de", "xx"])


@query("SELECT end_day IS NULL AS open, count(*) AS n FROM registry GROUP BY 1")
def a27_null_tally(v: Source) -> DataFrame:
    return profile.null_tally(v("registry"), "end_day")


@query("SELECT min(value) AS min, (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS c FROM events WHERE value IS NOT NULL) WHERE rn = c // 2 + 1) AS upper_median, max(value) AS max, round(avg(value), 6) AS mean FROM events")
def a28_upper_median(v: Source) -> DataFrame:
    return profile.upper_median(v("events"), "value")


@query("SELECT closed, CAST(t AS INT) AS target, CAST(floor(closed * 100 / t) AS BIGINT) AS total FROM (SELECT count(*) FILTER (WHERE open = 0) AS closed FROM labeled), (SELECT unnest([10, 15, 20]) AS t)")
def a29_size_projection(v: Source) -> DataFrame:
    return profile.size_projection(v("labeled"), "open", [10, 15, 20])


@query(_unpivot("SELECT '$' AS feature, count($) AS count, count(*) - count($) AS nulls, round(avg($), 6) AS mean, round(stddev_samp($), 6) AS std, round(CAST(min($) AS DOUBLE), 6) AS min, round(quantile_cont($, 0.25), 6) AS p25, round(quantile_cont($, 0.5), 6) AS p50, round(quantile_cont($, 0.75), 6) AS p75, round(CAST(max($) AS DOUBLE), 6) AS max FROM flat_places", ["confidence", "lat"]))
def a30_describe(v: Source) -> DataFrame:
    return profile.describe(v("flat_places"), ["confidence", "lat"])


@query("SELECT count(*) AS n, count(*) FILTER (WHERE dba_name <> '') AS with_name, count(*) FILTER (WHERE city <> '') AS with_city, count(*) FILTER (WHERE lower(trim(city)) = 'san francisco') AS in_city, count(*) FILTER (WHERE lower(trim(city)) = 'san francisco' AND end_day <= DATE '2001-08-02') AS closed_in_city FROM registry")
def a31_join_feasibility(v: Source) -> DataFrame:
    return profile.join_feasibility(features.registry_labels(v("registry"), REFERENCE))


@query("SELECT count(*) AS n, count(location_end_day) AS location_end, count(*) FILTER (WHERE admin_closed <> '') AS admin, count(*) FILTER (WHERE admin_closed <> '' OR location_end_day <= DATE '2001-08-02') AS \"any\" FROM registry WHERE end_day IS NULL")
def a32_presumed_open(v: Source) -> DataFrame:
    return profile.presumed_open(features.registry_labels(v("registry"), REFERENCE))


@query("WITH y AS (SELECT (end_day - start_day) / 365.25 AS y FROM registry WHERE end_day IS NOT NULL) SELECT round(quantile_cont(y, 0.1), 6) AS p10, round(quantile_cont(y, 0.25), 6) AS p25, round(quantile_cont(y, 0.5), 6) AS p50, round(quantile_cont(y, 0.75), 6) AS p75, round(quantile_cont(y, 0.9), 6) AS p90, round(avg(y), 6) AS mean, max(y) AS max FROM y")
def a33_durations(v: Source) -> DataFrame:
    return profile.durations(v("registry"), "start_day", "end_day")
