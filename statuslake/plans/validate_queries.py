"""Validation: neighbours and silhouettes of embeddings, folds, permutations, calibration, normalisation and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify, validate
from .catalogue import query
from .views import Source

_NEAR = """d AS (SELECT a.id, a.label, b.id AS near, b.label AS other, list_distance(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS distance FROM embed a JOIN embed b ON a.id <> b.id),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, near) AS rank FROM d)"""


@query(f"WITH {_NEAR} SELECT id, near, CAST(rank AS INT) AS rank, round(distance, 5) AS distance FROM r WHERE rank <= 5")
def neighbours_five_nearest(v: Source) -> DataFrame:
    """The exact five nearest other vectors of each vector."""
    return validate.nearest(v("embed"), "id", "v", 5).withColumn("distance", F.round("distance", 5))


@query(f"WITH {_NEAR} SELECT label, count(DISTINCT id) AS n, round(avg(CASE WHEN label = other THEN 1.0 ELSE 0.0 END), 6) AS purity FROM r WHERE rank <= 5 GROUP BY label")
def neighbours_purity(v: Source) -> DataFrame:
    return validate.neighbour_purity(v("embed"), "id", "v", "label", 5).withColumn("purity", F.round("purity", 6))


@query("""WITH e AS (SELECT id, label, CAST(v AS DOUBLE[]) AS v FROM embed), d AS (SELECT a.id, a.label, b.label AS other, sum(pow(list_distance(a.v, b.v), 2)) AS total, count(*) AS n FROM e a JOIN e b ON a.id <> b.id GROUP BY ALL),
  s AS (SELECT id, label, max(CASE WHEN label = other THEN total / n END) AS a, min(CASE WHEN label <> other THEN total / n END) AS b FROM d GROUP BY id, label)
  SELECT label, count(*) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s GROUP BY label""")
def neighbours_silhouette(v: Source) -> DataFrame:
    """Mean silhouette of each class for squared distances, from the classes' stored moments."""
    rows = v("embed")
    got = validate.silhouettes(rows, classify.da_fit(rows), "v", "label")
    return got.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


_FOLDS = "f AS (SELECT id, CAST(label AS BIGINT) AS label, CAST(v AS DOUBLE[]) AS v, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '42'), id) - 1) % 5 AS INT) AS fold FROM embed), g AS (SELECT CAST(unnest(generate_series(0, 4)) AS INT) AS fold), i AS (SELECT unnest(generate_series(1, 64)) AS i)"


@query(f"""WITH {_FOLDS}, s AS (SELECT g.fold, label, i, count(*) AS n, covar_pop(v[i], v[i]) * count(*) AS own, covar_pop(v[i], v[2]) * count(*) AS corner, avg(v[i]) AS m FROM f JOIN g ON f.fold <> g.fold, i GROUP BY g.fold, label, i)
  SELECT fold, label, n, round(sum(own), 4) AS trace, round(sum(corner), 4) AS second, round(sqrt(sum(m * m)), 6) AS norm FROM s GROUP BY fold, label, n""")
def folds_by_subtraction(v: Source) -> DataFrame:
    """States of the rows outside each of five folds: the total less the fold's own state, on whole vectors."""
    _, states = validate.fold_states(v("embed"), "v", "label", "id")
    trace = F.aggregate(F.transform("scatter", lambda r, i: F.get(r, i)), F.lit(0.0), lambda a, x: a + x)
    second = F.aggregate(F.transform("scatter", lambda r: F.get(r, F.lit(1))), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x))
    return states.select("fold", "label", "n", F.round(trace, 4).alias("trace"), F.round(second, 4).alias("second"), F.round(norm, 6).alias("norm"))


@query(f"""WITH {_FOLDS}, m AS (SELECT g.fold, label, i, avg(v[i]) AS m FROM f JOIN g ON f.fold <> g.fold, i GROUP BY g.fold, label, i),
  d AS (SELECT f.id, f.fold, f.label, m.label AS other, sum(power(v[i] - m, 2)) AS d FROM f JOIN m ON f.fold = m.fold GROUP BY ALL), p AS (SELECT id, fold, label, arg_min(other, d) AS prediction FROM d GROUP BY ALL)
  SELECT fold, count(*) AS n, round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY fold""")
def folds_accuracy(v: Source) -> DataFrame:
    """Stratified five-fold validation of the nearest class mean, all five models from one pass."""
    rows, states = validate.fold_states(v("embed"), "v", "label", "id")
    out = None
    for fold in range(5):
        own = classify.predict(classify.ncm_proba(rows.where(F.col("fold") == fold), states.where(F.col("fold") == fold).select("label", "n", "mean")))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("accuracy"))


_IMPORTANT = ("n_chars", "toxic", "age", "count_feature")
_DEALT = " ".join(f"JOIN (SELECT {c} AS {c}_p, row_number() OVER (ORDER BY md5(id || '42:{c}'), id) AS place FROM labeled) AS p_{c} USING (place)" for c in _IMPORTANT)
_CASES = " UNION ALL ".join(f"SELECT '{name}' AS model, 1 - open AS y, {', '.join(f'{c}_p AS {c}' if c == name else c for c in _IMPORTANT)} FROM w" for name in ("", *_IMPORTANT))


@query(f"""WITH w AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5(id || '42:'), id) AS place FROM labeled) {_DEALT}),
  l AS (SELECT model, y, round(1.5 * toxic - ln(1 + n_chars) / 4 + age / 2000 + count_feature / 20.0, 9) AS s FROM ({_CASES})), c AS (SELECT model, s, sum(y) AS pos, sum(1 - y) AS neg FROM l GROUP BY model, s),
  r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c), a AS (SELECT model, round(sum(pos * (before + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM r GROUP BY model)
  SELECT model AS "column", auc, round((SELECT auc FROM a WHERE model = '') - auc, 6) AS drop FROM a WHERE model <> ''""")
def permutation_importances(v: Source) -> DataFrame:
    """Loss of AUC of a stated linear score when one of its columns is dealt anew."""
    score = F.round(1.5 * F.col("toxic") - F.ln(1 + F.col("n_chars")) / 4 + F.col("age") / 2000 + F.col("count_feature") / 20.0, 9)
    return validate.permutation_importance(v("labeled"), list(_IMPORTANT), "id", "open", score)


@query("""WITH RECURSIVE x AS (SELECT toxic * 3 - 1 + (n_chars % 97) / 97 AS z, 1 - open AS y FROM labeled),
  t AS (SELECT 0 AS i, CAST(1 AS DOUBLE) AS b UNION ALL SELECT i + 1, b - (SELECT greatest(least(sum((1 / (1 + exp(-b * z)) - y) * z) / sum(z * z / (1 + exp(-b * z)) / (1 + exp(b * z))), b / 2), -b) FROM x) FROM t WHERE i < 40)
  SELECT round(1 / b, 5) AS temperature, round((SELECT avg(ln(1 + exp(CASE WHEN y = 1 THEN -z ELSE z END))) FROM x), 6) AS loss_before, round((SELECT avg(ln(1 + exp(CASE WHEN y = 1 THEN -z * b ELSE z * b END))) FROM x), 6) AS loss_after FROM t WHERE i = 40""")
def calibration_temperature(v: Source) -> DataFrame:
    """The temperature that fits stated logits, and the loss before and after."""
    z = F.col("toxic") * 3 - 1 + (F.col("n_chars") % 97) / 97
    rows = v("labeled").select(F.array(F.lit(0.0), z).alias("logits"), (1 - F.col("open")).alias("y"), z.alias("z"))
    t = validate.fit_temperature(rows, "logits", "y")
    loss = lambda scale: F.round(F.avg(F.ln(1 + F.exp(F.when(F.col("y") == 1, -F.col("z") / scale).otherwise(F.col("z") / scale)))), 6)
    return rows.agg(F.round(F.lit(t), 5).alias("temperature"), loss(1.0).alias("loss_before"), loss(t).alias("loss_after"))


_TWENTIETHS = str([i / 20 for i in range(21)])
_PLACE = "round(CASE WHEN len(list_filter(q_{0}, lambda v: v <= {0})) > len(list_filter(q_{0}, lambda v: v < {0})) THEN (len(list_filter(q_{0}, lambda v: v <= {0})) + len(list_filter(q_{0}, lambda v: v < {0})) - 1) / 2.0 WHEN len(list_filter(q_{0}, lambda v: v < {0})) = 0 THEN 0 WHEN len(list_filter(q_{0}, lambda v: v < {0})) > 20 THEN 20 ELSE len(list_filter(q_{0}, lambda v: v < {0})) - 1 + ({0} - q_{0}[len(list_filter(q_{0}, lambda v: v < {0}))]) / (q_{0}[len(list_filter(q_{0}, lambda v: v < {0})) + 1] - q_{0}[len(list_filter(q_{0}, lambda v: v < {0}))]) END / 20, 6) AS {0}"


@query(f"""WITH q AS (SELECT quantile_cont(n_chars, {_TWENTIETHS}) AS q_n_chars, quantile_cont(age, {_TWENTIETHS}) AS q_age FROM labeled WHERE doc_id % 3 <> 0)
  SELECT id, {_PLACE.format("n_chars")}, {_PLACE.format("age")} FROM labeled, q""")
def quantile_normalisation(v: Source) -> DataFrame:
    """All rows' places among the quantiles of two thirds of them."""
    rows = v("labeled")
    table = validate.fit_quantiles(rows.where("doc_id % 3 <> 0"), ["n_chars", "age"], 20)
    return validate.normalised(rows, table, ["n_chars", "age"]).select("id", F.round("n_chars", 6).alias("n_chars"), F.round("age", 6).alias("age"))


@query("""WITH c AS (SELECT CAST(least(floor(p_closed * 10), 9) AS INT) AS bin, sum(CASE WHEN model = 'a' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN model = 'b' THEN 1 ELSE 0 END) AS b FROM scored GROUP BY 1),
  p AS (SELECT greatest(a, 0.5) / (SELECT sum(a) FROM c) AS p, greatest(b, 0.5) / (SELECT sum(b) FROM c) AS q FROM c) SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM p""")
def drift_of_scores(v: Source) -> DataFrame:
    scored = v("scored")
    return validate.score_shift(scored.where("model = 'a'"), scored.where("model = 'b'"), "p_closed").withColumn("psi", F.round("psi", 6))


@query()
def drift_decisions(v: Source) -> DataFrame:
    """Keep, update or refit, for two releases against a third: divergence of classes and shift of scores."""
    rows, scored = v("embed"), v("scored")
    states = {f"r{i}": classify.da_fit(rows.where(F.col("id") % 3 == i)) for i in range(3)}
    scores = {f"r{i}": scored.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i) for i in range(3)}
    got = validate.drift_gate(states, scores, "r0", "p_closed", most_kl=100.0)
    return got.select("release", F.round("kl", 4).alias("kl"), F.round("psi", 6).alias("psi"), "decision")
