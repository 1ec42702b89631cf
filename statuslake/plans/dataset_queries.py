"""Splits, encodings, weights, augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assembly, profile, relational
from .catalogue import query
from .scalar_queries import place_features
from .views import Source

SPLIT = """q AS (SELECT open, n, ceil(sum(n) OVER () * P / 100) AS want, n * ceil(sum(n) OVER () * P / 100) / sum(n) OVER () AS share FROM (SELECT open, count(*) AS n FROM labeled GROUP BY open)),
  quota AS (SELECT open, floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, open) <= want - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM q),
  split AS (SELECT l.*, row_number() OVER (PARTITION BY l.open ORDER BY md5(id || '42'), id) <= quota AS held FROM labeled l JOIN quota ON l.open = quota.open)"""
SPLIT20, SPLIT30 = SPLIT.replace("* P /", "* 20 /"), SPLIT.replace("* P /", "* 30 /")


def split(v: Source, percent: int = 20) -> DataFrame:
    return assembly.stratified(v("labeled"), "open", "id", percent)


@query(f"WITH {SPLIT20} SELECT id, open, held FROM split")
def d1_stratified_split(v: Source) -> DataFrame:
    return split(v).select("id", "open", "held")


@query(f"WITH {SPLIT20} SELECT id, open FROM split WHERE NOT held UNION ALL SELECT id, 1 FROM labeled WHERE doc_id % 3 = 0 AND id NOT IN (SELECT id FROM split WHERE held)")
def d2_append_training(v: Source) -> DataFrame:
    rows = split(v)
    extra = v("labeled").where("doc_id % 3 = 0").select("id", F.lit(1).alias("open"))
    return assembly.append_training(rows.where("NOT held").select("id", "open"), rows.where("held"), [extra], "id")


@query(f"WITH {SPLIT20}, i AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INT) AS index FROM (SELECT DISTINCT category FROM split WHERE NOT held AND category < 'src5')) SELECT s.id, coalesce(i.index, CAST((SELECT count(*) FROM i) AS INT)) AS index, coalesce(i.category, 'OOV') AS decoded FROM split s LEFT JOIN i ON s.category = i.category WHERE held")
def d3_e12_category_index(v: Source) -> DataFrame:
    rows = split(v)
    index = assembly.category_index(rows.where("NOT held AND category < 'src5'"), "category")
    coded = assembly.apply_index(rows.where("held"), index, "category").select("id", "index")
    return assembly.decode_index(coded, index, "category").select("id", "index", F.col("category").alias("decoded"))


@query(f"WITH {SPLIT20}, r AS (SELECT category, avg(CAST(1 - open AS DOUBLE)) AS rate FROM split WHERE NOT held GROUP BY category) SELECT s.id, round(coalesce(r.rate, (SELECT avg(CAST(1 - open AS DOUBLE)) FROM split WHERE NOT held)), 6) AS closure_rate FROM split s LEFT JOIN r ON s.category = r.category WHERE held")
def d4_target_encoding(v: Source) -> DataFrame:
    rows = split(v)
    return assembly.target_encode(rows.where("held"), rows.where("NOT held"), "category", "open").select("id", F.round("closure_rate", 6).alias("closure_rate"))


_FOLD = "CAST('0x' || substr(md5(id || '42'), 1, 8) AS BIGINT) % 5"


@query(f"""WITH r AS (SELECT id, category, {_FOLD} AS f, CAST(1 - open AS DOUBLE) AS c FROM labeled), g AS (SELECT category, f, sum(c) AS s, count(*) AS n FROM r GROUP BY ALL),
  o AS (SELECT a.category, a.f, sum(b.s) / sum(b.n) AS rate FROM g a JOIN g b ON a.category = b.category AND a.f <> b.f GROUP BY ALL)
  SELECT r.id, round(coalesce(o.rate, (SELECT avg(c) FROM r)), 6) AS closure_rate FROM r LEFT JOIN o ON r.category = o.category AND r.f = o.f""")
def d4_target_encoding_folds(v: Source) -> DataFrame:
    return assembly.target_encode_folds(v("labeled"), "category", "open", "id").select("id", F.round("closure_rate", 6).alias("closure_rate"))


@query("""WITH i AS (SELECT category, CAST(row_number() OVER (ORDER BY category) AS INT) AS i FROM (SELECT DISTINCT category FROM labeled WHERE category IS NOT NULL))
  SELECT id, n_chars + toxic + 1 AS total, CAST(coalesce(i.i, (SELECT count(*) + 1 FROM i)) AS BIGINT) AS hot FROM labeled l LEFT JOIN i ON l.category = i.category""")
def d5_d13_one_hot_matrix(v: Source) -> DataFrame:
    rows = v("labeled")
    coded = assembly.one_hot(assembly.apply_index(rows, assembly.category_index(rows, "category"), "category"))
    from pyspark.ml.functions import vector_to_array

    out = assembly.assemble(coded, ["n_chars", "toxic", "category_vec"])
    hot = F.array_position(F.slice(vector_to_array("category_vec"), 1, 300), F.lit(1.0)).alias("hot")
    return out.select("id", F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x).alias("total"), hot)


@query("SELECT id, round(CAST((SELECT count(*) FROM labeled) AS DOUBLE) / (2 * n), 6) AS weight FROM labeled l JOIN (SELECT open, count(*) AS n FROM labeled GROUP BY open) c ON l.open = c.open")
def d6_class_weights(v: Source) -> DataFrame:
    return assembly.balanced_weights(v("labeled"), "open").select("id", F.round("weight", 6).alias("weight"))


@query("SELECT region, count(*) AS n FROM release_a WHERE status IN ('closed', 'permanently_closed') GROUP BY region ORDER BY n DESC, region LIMIT 10")
def d7_top_regions(v: Source) -> DataFrame:
    return assembly.top_regions(v("release_a"), 10)


_NEGATIVES = """sh AS (SELECT category, count(*) / (SELECT count(*) FROM release_b WHERE category < 'g') AS fraction FROM release_b WHERE category < 'g' GROUP BY category),
  pool AS (SELECT * FROM release_a WHERE (status IS NULL OR status = 'open') AND category IS NOT NULL),
  qt AS (SELECT category, greatest(CAST(round_even(fraction * (0.8 * 200), 0) AS DOUBLE), 1) AS quota FROM sh),
  kn AS (SELECT id, category FROM (SELECT p.id, p.category, quota, row_number() OVER (PARTITION BY p.category ORDER BY md5(p.id || '42'), p.id) AS rn FROM pool p JOIN qt ON p.category = qt.category) WHERE rn <= quota),
  ot AS (SELECT id, category FROM pool WHERE category NOT IN (SELECT category FROM sh) ORDER BY md5(id || '42'), id LIMIT 40)"""


@query(f"WITH {_NEGATIVES} SELECT id, category FROM kn UNION ALL SELECT id, category FROM ot")
def d8_stratified_negatives(v: Source) -> DataFrame:
    shares = profile.distribution(v("release_b").where("category < 'g'"), "category")
    pool = v("release_a").where("status IS NULL OR status = 'open'")
    return assembly.stratified_negatives(pool, shares, 200, "category", "id").select("id", "category")


_RATIO = """top AS (SELECT region FROM release_a WHERE status IN ('closed', 'permanently_closed') GROUP BY region ORDER BY count(*) DESC, region LIMIT 5),
  ins AS (SELECT * FROM release_a WHERE region IN (SELECT region FROM top)),
  cl AS (SELECT id FROM ins WHERE status IN ('closed', 'permanently_closed')), n AS (SELECT 2 * count(*) AS n FROM cl),
  pool AS (SELECT * FROM ins WHERE status IS NULL OR status = 'open'),
  sh AS (SELECT category, count(*) / (SELECT count(*) FROM release_b WHERE category < 'm') AS fraction FROM release_b WHERE category < 'm' GROUP BY category),
  qt AS (SELECT category, greatest(CAST(round_even(fraction * (0.8 * n), 0) AS DOUBLE), 1) AS quota FROM sh, n),
  kn AS (SELECT id FROM (SELECT p.id, quota, row_number() OVER (PARTITION BY p.category ORDER BY md5(p.id || '42'), p.id) AS rn FROM pool p JOIN qt ON p.category = qt.category) WHERE rn <= quota),
  ot AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5(id || '42'), id) AS rn FROM pool WHERE category IS NOT NULL AND category NOT IN (SELECT category FROM sh)), n WHERE rn <= n - CAST(floor(0.8 * n) AS BIGINT))"""


@query(f"WITH {_RATIO} SELECT id, 0 AS open FROM cl UNION ALL SELECT id, 1 FROM kn UNION ALL SELECT id, 1 FROM ot")
def d9_fixed_ratio(v: Source) -> DataFrame:
    return assembly.fixed_ratio(v("release_a"), v("release_b").where("category < 'm'"), 5, 2).select("id", "open")


@query("""WITH n AS (SELECT count(*) FILTER (WHERE open = 0) AS c, count(*) FILTER (WHERE open = 1) AS o FROM labeled WHERE doc_id % 4 = 0 AND (open = 0 OR doc_id % 8 = 0))
  SELECT id FROM labeled WHERE open = 1 AND id NOT IN (SELECT id FROM labeled WHERE doc_id % 4 = 0 AND (open = 0 OR doc_id % 8 = 0)) ORDER BY md5(id || '42'), id LIMIT (SELECT CAST(greatest(0, round_even(c * 100 / 15, 0) - c - o) AS BIGINT) FROM n)""")
def d10_percent_target(v: Source) -> DataFrame:
    labeled = v("labeled").where("doc_id % 4 = 0 AND (open = 0 OR doc_id % 8 = 0)")
    return assembly.percent_target(v("labeled").where("open = 1"), labeled, "open", "id", 15).select("id")


@query("""WITH o AS (SELECT id, open FROM labeled WHERE open = 1 ORDER BY md5(id || '42'), id LIMIT 100),
  c AS (SELECT id, open FROM labeled WHERE open = 0 ORDER BY md5(id || '42'), id LIMIT (SELECT CAST(floor(count(*) * 10 / 90) AS BIGINT) FROM o)) SELECT * FROM o UNION ALL SELECT * FROM c""")
def d11_t5_capped(v: Source) -> DataFrame:
    return assembly.capped(v("labeled").select("id", "open"), "open", 100, 10, "id")


@query(f"WITH {SPLIT30} SELECT open, held AS later_release, count(*) AS n FROM split GROUP BY open, held")
def d12_release_simulation(v: Source) -> DataFrame:
    return split(v, 30).groupBy("open", F.col("held").alias("later_release")).agg(F.count("*").alias("n"))


@query("SELECT f AS feature, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS nans FROM (SELECT unnest(['source_count', 'confidence', 'min_update_age_days']) AS f) WHERE (SELECT count(*) FROM flat_places) > 0")
def d14_sanity(v: Source) -> DataFrame:
    return assembly.sanity(place_features(v), ["source_count", "confidence", "min_update_age_days"])


@query("SELECT category, open, count(*) AS n FROM labeled GROUP BY ALL")
def a10_cross_tab(v: Source) -> DataFrame:
    return profile.counts(v("labeled"), "category", "open")


@query("SELECT feature, diff, CAST(rank() OVER (ORDER BY abs(diff) DESC) AS INT) AS rank FROM (SELECT 'toxic' AS feature, round(avg(toxic) FILTER (WHERE open = 0) - avg(toxic) FILTER (WHERE open = 1), 6) AS diff FROM labeled UNION ALL SELECT 'n_chars', round(avg(n_chars) FILTER (WHERE open = 0) - avg(n_chars) FILTER (WHERE open = 1), 6) FROM labeled)")
def w4_rank_features(v: Source) -> DataFrame:
    mean = lambda c, k: F.avg(F.when(F.col("open") == k, F.col(c)))
    rows = profile.long(v("labeled"), {c: {"diff": F.round(mean(c, 0) - mean(c, 1), 6)} for c in ("toxic", "n_chars")})
    return relational.with_rank(rows, "diff")
