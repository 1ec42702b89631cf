"""Agreement of sources by token sets and Jaro-Winkler, and states of weighted labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agreement, weighted
from .catalogue import query
from .match_queries import D
from .views import Source

_SETS = "SELECT list_sort(list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda t: t <> ''))) AS s, count(*) AS n FROM {} GROUP BY 1"


@query(f"""WITH a AS ({_SETS.format("points_l")}), b AS ({_SETS.format("points_r")}), p AS (SELECT a.s AS l, b.s AS r, a.n AS n_left, b.n AS n_right, len(list_intersect(a.s, b.s)) AS shared FROM a JOIN b ON len(list_intersect(a.s, b.s)) > 0)
  SELECT array_to_string(l, ' ') AS left_tokens, array_to_string(r, ' ') AS right_tokens, n_left, n_right, round(shared / (len(l) + len(r) - shared), 6) AS jaccard FROM p WHERE 100 * shared >= 60 * (len(l) + len(r) - shared)""")
def agreement_token_jaccard(v: Source) -> DataFrame:
    """Names of both sources whose words agree by 60 % or more."""
    got = agreement.jaccard_join(v("points_l"), v("points_r"), "name", 60)
    return got.select(F.array_join("left_tokens", " ").alias("left_tokens"), F.array_join("right_tokens", " ").alias("right_tokens"), "n_left", "n_right", F.round("jaccard", 6).alias("jaccard"))


_NORMAL = "trim(regexp_replace(lower({}.name), '[^a-z0-9 ]', '', 'g'))"


@query(f"""SELECT l.id, r.id AS r_id, round({D}, 3) AS dist_m, round(jaro_winkler_similarity({_NORMAL.format("l")}, {_NORMAL.format("r")}), 6) AS similarity
  FROM points_l l JOIN points_r r ON {D} <= 100 AND jaro_winkler_similarity({_NORMAL.format("l")}, {_NORMAL.format("r")}) >= 0.85""")
def agreement_jaro_winkler(v: Source) -> DataFrame:
    """Points within 100 m whose names have a Jaro-Winkler similarity of 0.85 or more."""
    got = agreement.similar_within(v("points_l"), v("points_r"), 100.0, 0.85)
    return got.select("id", "r_id", F.round("dist_m", 3).alias("dist_m"), F.round("similarity", 6).alias("similarity"))


@query("""WITH e AS (SELECT id, CAST(label AS BIGINT) AS label, CAST(v AS DOUBLE[]) AS v, 0.25 + (id % 4) / 4 AS w FROM embed), i AS (SELECT unnest(generate_series(1, 64)) AS i),
  m AS (SELECT label, i, count(*) AS n, sum(w) AS weight, sum(w * v[i]) / sum(w) AS m FROM e, i GROUP BY label, i), s AS (SELECT e.label, i, n, weight, m, sum(w * power(v[i] - m, 2)) AS own FROM e JOIN m ON e.label = m.label GROUP BY ALL)
  SELECT label, n, round(weight, 6) AS weight, round(sqrt(sum(m * m)), 6) AS norm, round(sum(own), 4) AS trace FROM s GROUP BY label, n, weight""")
def weighted_states(v: Source) -> DataFrame:
    """States of weighted labels, fitted on two parts and merged."""
    rows = v("embed").withColumn("w", 0.25 + (F.col("id") % 4) / 4)
    state = weighted.merge(weighted.fit(rows.where("id % 3 = 0"), "v", "label", "w"), weighted.fit(rows.where("id % 3 <> 0"), "v", "label", "w"))
    trace = F.aggregate(F.transform("scatter", lambda r, i: F.get(r, i)), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x))
    return state.select("label", "n", F.round("weight", 6).alias("weight"), F.round(norm, 6).alias("norm"), F.round(trace, 4).alias("trace"))
