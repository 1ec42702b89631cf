"""Place, registry and label views over the star-schema tables.

Each view is one text that both Spark and an ANSI engine can run; views may build on each other.  ``places`` is the
nested form of ``flat_places`` and ``flat_sources``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The instant that ages refer to.
REFERENCE = "2001-08-02 00:00:00"


def coded_name(digits: str, step: int) -> str:
    """A name of two words whose letters all differ and stay in place; ``step`` decides which of them become digits.

    Such names of equal length only match place by place, so SQL can tell their similarity from their differences.
    """
    part = lambda letters, at: " || ".join([f"'{letters[0]}'", *(f"CASE WHEN k * {step + 2 * i} % {5 + (i + at) % 4} = 0 THEN '{digits[i % len(digits)]}' ELSE '{c}' END" for i, c in enumerate(letters[1:], 1))])
    return f"{part('abcdefghij', 0)} || ' ' || {part('klmnopqrst', 2)}"


def tree_of(tree: int, upper: tuple[int, str], lower: tuple[int, str]) -> tuple[str, str]:
    """The inner nodes and leaves of a tree that splits all rows at ``upper``, both parts at ``lower`` (index and name)."""
    (f, x), (g, y) = upper, lower
    inner = f"SELECT {tree} AS tree, 0 AS node, {f} AS feature, t{f} AS threshold, 1 AS l, 2 AS r FROM tree_cuts UNION ALL " + " UNION ALL ".join(f"SELECT {tree}, {i}, {g}, t{g}, {2 * i + 1}, {2 * i + 2} FROM tree_cuts" for i in (1, 2))
    leaf = f"SELECT {tree} AS tree, CASE WHEN {x} <= t{f} THEN 3 ELSE 5 END + CASE WHEN {y} <= t{g} THEN 0 ELSE 1 END AS node, round(2 * avg(CAST(open AS DOUBLE)) - 1, 6) AS value FROM labeled JOIN tree_cuts ON true GROUP BY 1, 2"
    return inner, leaf


TREES = [tree_of(0, (0, "n_chars"), (1, "toxic")), tree_of(1, (2, "count_feature"), (3, "age")), tree_of(2, (3, "age"), (0, "n_chars"))]

VIEWS = {
    "flat_places": """
        SELECT c_custkey AS k, CAST(c_custkey AS STRING) AS id, p_name || ' ' || lower(c_mktsegment) AS name,
               CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey * 37 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS confidence,
               CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE lower(c_mktsegment) END AS category, CAST(c_custkey % 3 AS INT) AS n_alt,
               CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 0 ELSE CAST(1 + c_custkey % 2 AS INT) END AS n_web,
               CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 0 ELSE CAST(1 + c_custkey % 2 AS INT) END AS n_phone,
               CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 0 ELSE CAST(1 + c_custkey % 2 AS INT) END AS n_social,
               c_custkey % 5 = 0 AS has_brand, c_custkey % 11 <> 0 AS has_address, n_name AS region,
               'Street ' || CAST(c_custkey AS STRING) AS freeform, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey AS STRING) END AS postcode,
               CASE c_custkey % 10 WHEN 0 THEN 'permanently_closed' WHEN 1 THEN 'temporarily_closed' WHEN 2 THEN NULL ELSE 'open' END AS status,
               CAST(37.7 AS DOUBLE) + CAST(c_custkey * 7919 % 1200 AS DOUBLE) / CAST(100000 AS DOUBLE) AS lat,
               CAST(-122.52 AS DOUBLE) + CAST(c_custkey * 104729 % 1700 AS DOUBLE) / CAST(100000 AS DOUBLE) AS lon
        FROM customer JOIN part ON p_partkey = c_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "flat_sources": """
        SELECT o_custkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS idx,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'meta' WHEN '2' THEN 'Microsoft' WHEN '3' THEN 'Foursquare' WHEN '4' THEN 'META' ELSE 'Overture' END AS dataset,
               CASE WHEN o_orderkey % 23 = 0 THEN 'bad' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T00:00:00' || CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE '' END END AS update_time,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS source_confidence,
               CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN '' ELSE '/properties/existence' END AS property
        FROM orders WHERE o_orderkey % 6 = 0""",
    "release_a": "SELECT id, name, region, category, confidence, status, lon, lat FROM flat_places WHERE k % 10 <> 3",
    "release_b": """
        SELECT id, name, region, category, CASE WHEN k % 5 = 0 THEN confidence + CAST(0.001 AS DOUBLE) ELSE confidence END AS confidence,
               CASE WHEN k % 8 <> 0 THEN status WHEN status = 'open' THEN 'permanently_closed' ELSE 'open' END AS status, lon, lat
        FROM flat_places WHERE k % 10 <> 7""",
    "points_l": "SELECT k AS id, name, lat, lon, status FROM flat_places",
    "points_r": """
        SELECT k + 1000000 AS id, lat + CAST((k * 31 % 41) - 20 AS DOUBLE) / CAST(111111 AS DOUBLE) AS lat, lon + CAST((k * 17 % 41) - 20 AS DOUBLE) / CAST(87824 AS DOUBLE) AS lon,
               CASE WHEN k % 3 = 1 THEN name || ' inc' ELSE reverse(split_part(name, ' ', 1)) || substr(name, length(split_part(name, ' ', 1)) + 1) END AS name, k % 4 = 0 AS closed
        FROM flat_places WHERE k % 3 <> 0""",
    "named_l": f"SELECT k AS id, {coded_name('135', 7)} AS name, lat, lon, status FROM flat_places",
    "named_r": f"SELECT id, {coded_name('246', 11)} AS name, lat, lon, closed FROM (SELECT *, CAST((id - 1000000) * 3 AS BIGINT) AS k FROM points_r)",
    "wide_r": """
        SELECT k AS id, CAST(25 AS DOUBLE) + CAST(k * 7919 % 20000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat, CAST(-120 AS DOUBLE) + CAST(k * 104729 % 40000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon, k % 4 = 0 AS closed
        FROM flat_places""",
    "cities": """
        SELECT CAST(n_nationkey AS BIGINT) AS cell, CAST(26 + n_nationkey * 7 % 18 AS DOUBLE) AS lat, CAST(-118 + n_nationkey * 11 % 36 AS DOUBLE) AS lon FROM nation""",
    "registry": """
        SELECT o_orderkey AS certificate, p_name AS dba_name, CAST(o_orderdate AS DATE) AS start_day,
               CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey * 13 % 2500 AS INT) AS DATE) END AS end_day,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey * 13 % 2500 + o_orderkey % 30 AS INT) AS DATE) END AS location_end_day,
               CASE WHEN o_orderkey % 29 = 0 THEN 'closed by office' WHEN o_orderkey % 31 = 0 THEN '' ELSE NULL END AS admin_closed,
               CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN NULL ELSE p_type END AS naics,
               CASE o_orderkey % 4 WHEN 0 THEN 'San Francisco' WHEN 1 THEN ' san francisco ' WHEN 2 THEN 'Oakland' ELSE NULL END AS city,
               CASE WHEN o_orderkey % 50 = 0 THEN 'true' ELSE 'false' END AS parking_tax
        FROM orders JOIN (SELECT count(*) AS n FROM part) ON true JOIN part ON p_partkey = o_orderkey % n""",
    "yelp": """
        SELECT CAST(c_custkey AS STRING) AS business_id, c_name AS name, CAST(c_custkey * 53 % 700 AS INT) AS review_count,
               CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Restaurants, ' WHEN 2 THEN 'Restaurants, Italian Food, ' ELSE 'Auto Repair, Tires, Body Shops, ' END AS categories,
               CASE WHEN c_custkey % 5 <> 0 THEN 1 ELSE 0 END AS is_open, CAST(c_nationkey AS STRING) AS state
        FROM customer""",
    "labeled": """
        SELECT CAST(d.doc_id AS STRING) AS id, d.doc_id, l.quality AS open, d.source AS category, d.lang, CAST(d.n_chars AS DOUBLE) AS n_chars,
               CAST(l.toxic AS DOUBLE) AS toxic, CAST(d.doc_id % 7 AS INT) AS count_feature,
               CASE WHEN d.doc_id % 5 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(d.n_chars % 900 AS DOUBLE) END AS age
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "tree_cuts": "SELECT round(avg(n_chars), 1) + CAST(0.05 AS DOUBLE) AS t0, CAST(0.5 AS DOUBLE) AS t1, CAST(2.5 AS DOUBLE) AS t2, round(avg(age), 1) + CAST(0.05 AS DOUBLE) AS t3 FROM labeled",
    "tree_inner": " UNION ALL ".join(inner for inner, _ in TREES),
    "tree_leaves": " UNION ALL ".join(leaf for _, leaf in TREES),
    "tree_places": "SELECT tree, node, feature, threshold, l, r FROM tree_inner UNION ALL SELECT DISTINCT tree, c, CAST(NULL AS INT), CAST(NULL AS DOUBLE), CAST(NULL AS INT), CAST(NULL AS INT) FROM (SELECT tree, l AS c FROM tree_inner WHERE l > 2 UNION ALL SELECT tree, r AS c FROM tree_inner WHERE r > 2)",
    "tree_nodes": """
        SELECT p.tree, p.node, feature, threshold, l, r, CASE WHEN feature IS NULL THEN coalesce(value, 0) END AS value, CAST(1 AS DOUBLE) / CAST(p.tree + 1 AS DOUBLE) AS weight
        FROM tree_places p LEFT JOIN tree_leaves v ON v.tree = p.tree AND v.node = p.node""",
    "net_effects": " UNION ALL ".join(f"SELECT {i} AS source, round(avg({c}), 2) AS m, round(stddev_pop({c}) + CAST(0.01 AS DOUBLE), 2) AS s, round((avg(CASE WHEN open = 1 THEN {c} END) - avg(CASE WHEN open = 0 THEN {c} END)) / (stddev_pop({c}) + 0.01), 3) AS e FROM labeled" for i, c in enumerate(("n_chars", "toxic", "count_feature", "age"))),
    "net_weights": """
        SELECT 1 AS layer, u AS unit, source, CASE WHEN (source + u) % 2 = 0 THEN e / s ELSE CAST(0.1 AS DOUBLE) / s END AS w FROM net_effects JOIN (SELECT 0 AS u UNION ALL SELECT 1 AS u UNION ALL SELECT 2 AS u) AS units ON true
        UNION ALL SELECT 1, u, -1, sum(-m * CASE WHEN (source + u) % 2 = 0 THEN e / s ELSE CAST(0.1 AS DOUBLE) / s END) FROM net_effects JOIN (SELECT 0 AS u UNION ALL SELECT 1 AS u UNION ALL SELECT 2 AS u) AS units ON true GROUP BY u
        UNION ALL SELECT 2, o, u, CAST((1 - 2 * o) * (u + 1) AS DOUBLE) FROM (SELECT 0 AS u UNION ALL SELECT 1 AS u UNION ALL SELECT 2 AS u) AS units JOIN (SELECT 0 AS o UNION ALL SELECT 1 AS o) AS outs ON true""",
    "scored": """
        SELECT 'a' AS model, id, CASE WHEN open = 1 THEN 0 ELSE 1 END AS y, category, CAST(CAST(n_chars AS BIGINT) * 7919 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS p_closed, n_chars, toxic FROM labeled
        UNION ALL
        SELECT 'b' AS model, id, CASE WHEN open = 1 THEN 0 ELSE 1 END AS y, category, CAST(doc_id * 31 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS p_closed, n_chars, toxic FROM labeled""",
    "sightings": """
        SELECT o_custkey AS id, CAST((year(CAST(o_orderdate AS DATE)) - 1992) * 4 + quarter(CAST(o_orderdate AS DATE)) - 1 AS BIGINT) AS release, CAST(max(CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END) AS INT) AS closed
        FROM orders GROUP BY 1, 2""",
    "embed": "SELECT vec_id AS id, embedding AS v, label FROM embeddings",
}


def needed(sql: str) -> list[str]:
    """The views that ``sql`` reads, each after those it builds on."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            out += [x for x in [*needed(VIEWS[name]), name] if x not in out]
    return out


def with_views(sql: str) -> str:
    parts = [f"{n} AS ({VIEWS[n]})" for n in needed(sql)]
    if not parts:
        return sql
    own = re.match(r"\s*WITH\b( RECURSIVE\b)?", sql)
    return f"WITH{own and own[1] or ''} {', '.join(parts)} " + (", " + sql[own.end() :] if own else sql)


class Source:
    """Tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __call__(self, name: str, shuffled: tuple[str, ...] = ()) -> DataFrame:
        """A table, or a view; joins of the tables ``shuffled`` shuffle both sides, few as their columns may be: Spark would
        send all keys of a large table to every executor, since they take little of its file."""
        if name in TABLES:
            return self.table(name)
        sql = with_views(f"SELECT * FROM {name}")
        for t in TABLES:
            if re.search(rf"\b{t}\b", sql):
                (self.table(t).hint("merge") if t in shuffled else self.table(t)).createOrReplaceTempView(t)
        return self.spark.sql(sql)

    def places(self) -> DataFrame:
        """Nested place records."""
        src = F.struct("idx", "dataset", "update_time", F.col("source_confidence").alias("confidence"), "property")
        held = self("flat_sources").groupBy("k").agg(F.sort_array(F.collect_list(src)).alias("s"))
        held = held.select("k", F.expr("transform(s, x -> struct(x.dataset AS dataset, concat('r', x.idx) AS record_id, x.update_time AS update_time, x.confidence AS confidence, x.property AS property))").alias("sources"))
        many = lambda n, what: F.expr(f"IF({n} IS NULL, NULL, IF({n} = 0, CAST(array() AS ARRAY<STRING>), transform(sequence(1, {n}), i -> concat('{what}', k, '-', i))))")
        return self("flat_places").join(held, "k", "left").select(
            "k", "id", F.struct(F.col("name").alias("primary")).alias("names"), "confidence",
            F.struct(F.col("category").alias("primary"), F.expr("IF(n_alt = 0, CAST(array() AS ARRAY<STRING>), transform(sequence(1, n_alt), i -> concat('alt', i)))").alias("alternate")).alias("categories"),
            many("n_web", "http://w").alias("websites"), many("n_phone", "+1").alias("phones"), many("n_social", "http://s").alias("socials"),
            F.expr("IF(has_brand, named_struct('names', named_struct('primary', CAST(NULL AS STRING))), NULL)").alias("brand"),
            F.expr("IF(has_address, array(named_struct('freeform', freeform, 'locality', 'San Francisco', 'postcode', postcode, 'region', region, 'country', 'US')), array())").alias("addresses"),
            F.coalesce("sources", F.expr("CAST(array() AS ARRAY<STRUCT<dataset: STRING, record_id: STRING, update_time: STRING, confidence: DOUBLE, property: STRING>>)")).alias("sources"),
            F.col("status").alias("operating_status"), F.struct(F.col("lon").alias("xmin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymin"), F.col("lat").alias("ymax")).alias("bbox"),
            F.encode("id", "UTF-8").alias("geometry"))
