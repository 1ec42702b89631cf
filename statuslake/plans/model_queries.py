"""Classifiers, evaluation, sources and sinks by round trip, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assembly, classify, evaluate, relational, stored
from ..sources import io
from ..streaming import state as streaming
from .catalogue import query
from .dataset_queries import split
from .views import Source


def scratch(v: Source, name: str) -> str:
    """A new folder that all machines share."""
    return f"{io.shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


# classifiers

_STATE = "SELECT label, CAST(i AS INT) AS pos, count(*) AS n, round(avg(CAST(v[i + 1] AS DOUBLE)), 6) AS m FROM embed, (SELECT unnest(generate_series(0, 63)) AS i) WHERE {} GROUP BY label, i"


def _flat(state: DataFrame) -> DataFrame:
    return state.select("label", "n", F.posexplode("mean").alias("pos", "m")).select("label", "pos", "n", F.round("m", 6).alias("m"))


@query(_STATE.format("true"))
def c1_ncm_fit(v: Source) -> DataFrame:
    return _flat(classify.ncm_fit(v("embed")))


@query(_STATE.format("true"))
def c2_ncm_update(v: Source) -> DataFrame:
    """Fitted on one part, updated with another that has a class the first lacks."""
    a, b = v("embed").where("id % 3 = 0 AND label <> 4"), v("embed").where("NOT (id % 3 = 0 AND label <> 4)")
    return _flat(classify.ncm_merge(classify.ncm_fit(a), classify.ncm_fit(b)))


@query("""WITH m AS (SELECT label, i, avg(CAST(v[i] AS DOUBLE)) AS m FROM embed, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY label, i),
  d AS (SELECT e.id, m.label, exp(-sum(power(CAST(v[i] AS DOUBLE) - m, 2)) / 0.5) AS x FROM embed e, m GROUP BY e.id, m.label)
  SELECT id, arg_max(label, x) AS prediction, round(max(x) / sum(x), 6) AS p FROM d GROUP BY id""")
def c3_c4_ncm_scores(v: Source) -> DataFrame:
    state = classify.ncm_fit(v("embed"))
    return classify.predict(classify.ncm_proba(v("embed"), state, temperature=0.5)).select("id", "prediction", F.round(F.array_max("proba"), 6).alias("p"))


@query("SELECT label, n, round(sqrt(sum(m * m)), 6) AS norm FROM (SELECT label, count(*) AS n, avg(CAST(v[i] AS DOUBLE)) AS m FROM embed, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY label, i) GROUP BY label, n")
def c5_state_summary(v: Source) -> DataFrame:
    return classify.state_summary(classify.ncm_fit(v("embed")))


def _plane(v: Source) -> DataFrame:
    """The vectors' first two coordinates, for which SQL can invert a covariance."""
    return v("embed").withColumn("v", F.slice("v", 1, 2))


_PLANE = """e AS (SELECT id, CAST(label AS BIGINT) AS label, CAST(v[1] AS DOUBLE) AS x, CAST(v[2] AS DOUBLE) AS y FROM embed),
  m AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, var_pop(y) * count(*) AS syy, covar_pop(x, y) * count(*) AS sxy FROM e GROUP BY label)"""


@query(f"WITH {_PLANE}, c AS (SELECT label, n, sxx / (n - 1) + 0.0001 AS a, syy / (n - 1) + 0.0001 AS b, sxy / (n - 1) AS c FROM m) SELECT label, n, round((a + b + sqrt(power(a - b, 2) + 4 * c * c)) / (a + b - sqrt(power(a - b, 2) + 4 * c * c)), 5) AS condition FROM c")
def c5_condition_numbers(v: Source) -> DataFrame:
    return classify.condition_numbers(classify.da_fit(_plane(v))).withColumn("condition", F.round("condition", 5))


_SCATTER = "SELECT label, round(sum(s), 4) AS trace, round(sum(CASE WHEN i = 1 THEN c END), 4) AS corner FROM (SELECT CAST(label AS BIGINT) AS label, i, covar_pop(CAST(v[i] AS DOUBLE), CAST(v[i] AS DOUBLE)) * count(*) AS s, covar_pop(CAST(v[i] AS DOUBLE), CAST(v[2] AS DOUBLE)) * count(*) AS c FROM embed, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY label, i) GROUP BY label"


def _trace(state: DataFrame) -> DataFrame:
    diagonal = F.aggregate(F.transform("scatter", lambda row, i: F.get(row, i)), F.lit(0.0), lambda a, x: a + x)
    return state.select("label", F.round(diagonal, 4).alias("trace"), F.round(F.get(F.get("scatter", F.lit(0)), F.lit(1)), 4).alias("corner"))


@query(_SCATTER)
def c6_scatter_fit(v: Source) -> DataFrame:
    return _trace(classify.da_fit(v("embed")))


@query(_SCATTER)
def c7_v2_scatter_merge(v: Source) -> DataFrame:
    parts = [classify.da_fit(v("embed").where(f"id % 3 = {i}")) for i in range(3)]
    return _trace(classify.da_merge(*parts))


@query()
def c8_c9_slda(v: Source) -> DataFrame:
    out = classify.predict(classify.slda_proba(v("embed"), classify.da_fit(v("embed"))))
    return out.select("id", "label", "prediction", F.round(F.array_max("proba"), 6).alias("p"))


@query()
def c10_qda(v: Source) -> DataFrame:
    out = classify.predict(classify.qda_proba(v("embed"), classify.da_fit(v("embed"))))
    return out.select("id", "label", "prediction", F.round(F.array_max("proba"), 6).alias("p"))


_SHARED = f"""WITH {_PLANE}, p AS (SELECT sum(sxx) / (sum(n) - count(*)) + 0.0001 AS a, sum(syy) / (sum(n) - count(*)) + 0.0001 AS b, sum(sxy) / (sum(n) - count(*)) AS c, sum(n) AS t FROM m),
  w AS (SELECT label, mx, my, (b * mx - c * my) / (a * b - c * c) AS wx, (a * my - c * mx) / (a * b - c * c) AS wy, ln(n / t) AS prior FROM m, p),
  s AS (SELECT id, e.label AS own, w.label, x * wx + y * wy - 0.5 * (mx * wx + my * wy) + prior AS s FROM e, w)"""
_CHOSEN = "SELECT id, own AS label, arg_max(label, s) AS prediction, round(1 / sum(exp(s - best)), 6) AS p FROM (SELECT *, max(s) OVER (PARTITION BY id) AS best FROM s) GROUP BY id, own"


@query(f"{_SHARED} {_CHOSEN}")
def c8_c9_slda_plane(v: Source) -> DataFrame:
    out = classify.predict(classify.slda_proba(_plane(v), classify.da_fit(_plane(v))))
    return out.select("id", F.col("label").cast("bigint").alias("label"), "prediction", F.round(F.array_max("proba"), 6).alias("p"))


@query(f"""WITH {_PLANE}, c AS (SELECT *, sxx / (n - 1) + 0.1 AS a, syy / (n - 1) + 0.1 AS b, sxy / (n - 1) AS c, ln(n / sum(n) OVER ()) AS prior FROM m),
  s AS (SELECT id, e.label AS own, c.label, prior - 0.5 * ln(a * b - c * c) - 0.5 * (b * power(x - mx, 2) - 2 * c * (x - mx) * (y - my) + a * power(y - my, 2)) / (a * b - c * c) AS s FROM e, c) {_CHOSEN}""")
def c10_qda_plane(v: Source) -> DataFrame:
    out = classify.predict(classify.qda_proba(_plane(v), classify.da_fit(_plane(v))))
    return out.select("id", F.col("label").cast("bigint").alias("label"), "prediction", F.round(F.array_max("proba"), 6).alias("p"))


@query("SELECT CAST(0 AS DOUBLE) AS mean_diff, CAST(0 AS DOUBLE) AS scatter_diff, CAST(0 AS BIGINT) AS n_diff FROM (SELECT count(*) AS n FROM embed) WHERE n > 0")
def c18_incremental_is_full(v: Source) -> DataFrame:
    e = v("embed")
    d = classify.state_difference(classify.da_fit(e), classify.da_merge(classify.da_fit(e.where("id % 10 < 7")), classify.da_fit(e.where("id % 10 >= 7"))))
    return d.select(F.round("mean_diff", 6).alias("mean_diff"), F.round("scatter_diff", 6).alias("scatter_diff"), "n_diff")


def _matrix(v: Source) -> tuple[DataFrame, DataFrame]:
    rows = assembly.assemble(split(v), ["n_chars", "toxic", "count_feature", "age"])
    train = assembly.balanced_weights(rows.where("NOT held"), "open").withColumnRenamed("open", "label")
    return classify.dealt(train, "id"), rows.where("held")


@query()
def c11_c16_c17_trees(v: Source) -> DataFrame:
    train, held = _matrix(v)
    model = classify.gbt(train)
    return classify.decide(classify.p_closed(model.transform(held)), "balanced").select("id", "open", F.round("p_closed", 6).alias("p_closed"), "predicted_closed")


@query()
def c12_c13_importances(v: Source) -> DataFrame:
    train, _ = _matrix(v)
    return classify.importances(v.spark, classify.gbt(train, columns="0.8"), ["n_chars", "toxic", "count_feature", "age"])


@query()
def c14_c15_network_embeddings(v: Source) -> DataFrame:
    train, held = _matrix(v)
    model = classify.network(train, 4)
    return classify.embeddings(model, held, "id").select("id", F.size("v").alias("size"), F.round(F.get("v", F.lit(0)).cast("double"), 4).alias("first"))


_FEATURES = ["n_chars", "toxic", "count_feature", "age"]
_X = "SELECT id, i AS feature, [n_chars, toxic, count_feature, age][i + 1] AS x FROM labeled, (SELECT unnest([0, 1, 2, 3]) AS i)"


@query(f"""WITH RECURSIVE f AS ({_X}), n AS MATERIALIZED (SELECT * FROM tree_nodes), w AS (
    SELECT id, tree, 0 AS node FROM labeled, (SELECT DISTINCT tree FROM n)
    UNION ALL SELECT w.id, w.tree, CASE WHEN f.x <= n.threshold THEN n.l ELSE n.r END FROM w JOIN n ON n.tree = w.tree AND n.node = w.node JOIN f ON f.id = w.id AND f.feature = n.feature),
  p AS (SELECT w.id, 1 - 1 / (1 + exp(-2 * sum(n.weight * n.value))) AS p FROM w JOIN n ON n.tree = w.tree AND n.node = w.node WHERE n.feature IS NULL GROUP BY w.id)
  SELECT id, round(p, 6) AS p_closed, CASE WHEN p >= 0.3 THEN 1 ELSE 0 END AS predicted_closed FROM p""")
def c11_c16_c17_stored_trees(v: Source) -> DataFrame:
    """Scores and decisions of a stored table of tree nodes; SQL walks the same table."""
    scored = stored.p_closed_by_trees(v("labeled"), v("tree_nodes"), _FEATURES)
    return classify.decide(scored, "balanced").select("id", F.round("p_closed", 6).alias("p_closed"), "predicted_closed")


@query("""WITH split_gain AS (SELECT feature, weight, (SELECT var_pop(value) FROM tree_nodes b WHERE b.tree = a.tree AND b.feature IS NULL) AS spread FROM tree_nodes a WHERE feature IS NOT NULL)
  SELECT feature, count(*) AS splits, round(sum(weight * spread), 6) AS spread FROM split_gain GROUP BY feature""")
def c12_c13_stored_splits(v: Source) -> DataFrame:
    """How often each feature splits in a stored model, and the spread of the trees' values there."""
    return stored.split_spread(v("tree_nodes")).withColumn("spread", F.round("spread", 6))


@query(f"""WITH f AS ({_X}), h AS (SELECT id, unit, 1 / (1 + exp(-sum(CASE WHEN w.source = -1 THEN w ELSE w * x END))) AS h FROM net_weights w JOIN (SELECT * FROM f UNION ALL SELECT id, -1, 1.0 FROM labeled) f ON f.feature = w.source WHERE layer = 1 GROUP BY id, unit),
  o AS (SELECT id, w.unit, sum(w.w * h) AS z FROM net_weights w JOIN h ON h.unit = w.source WHERE layer = 2 GROUP BY id, w.unit)
  SELECT h.id, round(max(CASE WHEN h.unit = 0 THEN h END), 6) AS h0, round(max(CASE WHEN h.unit = 1 THEN h END), 6) AS h1, round(max(CASE WHEN h.unit = 2 THEN h END), 6) AS h2, round(max(p), 6) AS p_closed
  FROM h JOIN (SELECT id, max(CASE WHEN unit = 0 THEN exp(z) END) / sum(exp(z)) AS p FROM o GROUP BY id) o ON o.id = h.id GROUP BY h.id""")
def c14_c15_stored_network(v: Source) -> DataFrame:
    """Hidden units and probabilities of a stored table of weights; SQL forms the same products."""
    out = stored.network_layers(v("labeled"), v("net_weights"), _FEATURES)
    hidden = [F.round(F.get("hidden", F.lit(i)), 6).alias(f"h{i}") for i in range(3)]
    return out.select("id", *hidden, F.round(F.get("proba", F.lit(0)), 6).alias("p_closed"))


@query()
def c5_condition_numbers_whole(v: Source) -> DataFrame:
    """All 64 coordinates: no SQL form, a test holds it against the eigenvalues."""
    return classify.condition_numbers(classify.da_fit(v("embed")))


# evaluation

_AUC = "SELECT model, round(sum(CAST(pos AS DOUBLE) * (less + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p_closed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM (SELECT model, p_closed, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY ALL)) GROUP BY model"
_AP = "SELECT model, round(sum(CAST(pos AS DOUBLE) * tp / n) / sum(pos), 6) AS ap FROM (SELECT *, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS n FROM (SELECT model, p_closed, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY ALL) WINDOW w AS (PARTITION BY model ORDER BY p_closed DESC)) GROUP BY model"
_RATES = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"
_CONF = "count(*) FILTER (WHERE p_closed >= $ AND y = 1) AS tp, count(*) FILTER (WHERE p_closed >= $ AND y = 0) AS fp, count(*) FILTER (WHERE p_closed < $ AND y = 1) AS fn, count(*) FILTER (WHERE p_closed < $ AND y = 0) AS tn"
_F1 = """SELECT model, round(arg_max(t, f1 * 1000000 - t), 3) AS threshold, round(max(f1), 6) AS f1 FROM (SELECT model, t, round(2.0 * tp / (called + pos), 6) AS f1 FROM
  (SELECT model, t, count(*) FILTER (WHERE p_closed >= t - 1e-9 AND y = 1) AS tp, count(*) FILTER (WHERE p_closed >= t - 1e-9) AS called, sum(y) AS pos FROM scored, (SELECT 0.01 + CAST(i AS DOUBLE) * 0.005 AS t FROM (SELECT unnest(generate_series(0, 198)) AS i)) GROUP BY model, t) WHERE called > 0) GROUP BY model"""


@query(_AUC)
def e1_auc(v: Source) -> DataFrame:
    return evaluate.auc(v("scored"))


@query(_AP)
def e2_average_precision(v: Source) -> DataFrame:
    return evaluate.average_precision(v("scored"))


@query(_F1)
def e3_best_f1(v: Source) -> DataFrame:
    return evaluate.best_f1(v("scored"))


@query(f"SELECT model, tp, fp, fn, tn, {_RATES} FROM (SELECT model, {_CONF.replace('$', '0.9')} FROM scored GROUP BY model)")
def e4_rates(v: Source) -> DataFrame:
    return evaluate.rates(evaluate.confusion(v("scored"), 0.9, "model"))


@query(f"SELECT c.model, c.n, a.auc, p.ap, f.threshold AS best_threshold, f.f1 AS best_f1, tp, fp, fn, tn, {_RATES} FROM (SELECT model, count(*) AS n, {_CONF.replace('$', '0.5')} FROM scored GROUP BY model) c JOIN ({_AUC}) a ON a.model = c.model JOIN ({_AP}) p ON p.model = c.model JOIN ({_F1}) f ON f.model = c.model")
def e5_model_comparison(v: Source) -> DataFrame:
    return evaluate.compare(v("scored"))


@query(f"SELECT model, 'auc' AS metric, auc AS value, CAST(0.5 AS DOUBLE) AS target, CASE WHEN auc >= 0.5 THEN 'PASS' ELSE 'MISS' END AS status FROM ({_AUC})")
def e6_targets(v: Source) -> DataFrame:
    return evaluate.targets(evaluate.auc(v("scored")), {"auc": 0.5})


_ERR = "CASE WHEN p_closed >= 0.5 THEN CASE WHEN y = 1 THEN 'TP' ELSE 'FP' END ELSE CASE WHEN y = 1 THEN 'FN' ELSE 'TN' END END"


@query(f"SELECT model, {_ERR} AS error, count(*) AS n FROM scored GROUP BY ALL")
def e7_error_types(v: Source) -> DataFrame:
    return evaluate.error_types(v("scored"), 0.5).groupBy("model", "error").agg(F.count("*").alias("n"))


@query(f"SELECT f AS feature, mean_a, mean_b, diff FROM (SELECT 'n_chars' AS f, round(avg(n_chars) FILTER (WHERE e = 'FN'), 6) AS mean_a, round(avg(n_chars) FILTER (WHERE e = 'TP'), 6) AS mean_b, round(avg(n_chars) FILTER (WHERE e = 'FN') - avg(n_chars) FILTER (WHERE e = 'TP'), 6) AS diff FROM (SELECT *, {_ERR} AS e FROM scored) UNION ALL SELECT 'toxic', round(avg(toxic) FILTER (WHERE e = 'FN'), 6), round(avg(toxic) FILTER (WHERE e = 'TP'), 6), round(avg(toxic) FILTER (WHERE e = 'FN') - avg(toxic) FILTER (WHERE e = 'TP'), 6) FROM (SELECT *, {_ERR} AS e FROM scored))")
def e8_feature_profile(v: Source) -> DataFrame:
    return evaluate.feature_profile(evaluate.error_types(v("scored"), 0.5), "FN", "TP", ["n_chars", "toxic"])


@query(f"SELECT category, closed, tp, fp, fn, tn, closed < 5 AS low_n FROM (SELECT category, count(*) FILTER (WHERE y = 1) AS closed, {_CONF.replace('$', '0.5')} FROM scored WHERE model = 'a' GROUP BY category) WHERE closed >= 1")
def e9_category_errors(v: Source) -> DataFrame:
    return evaluate.category_errors(evaluate.error_types(v("scored").where("model = 'a'"), 0.5))


_CAT = f"SELECT model, category, tp, fp, fn, tn, {_RATES}, tp + fn AS closed, tp + fn >= 5 AS reliable FROM (SELECT model, category, {_CONF.replace('$', '0.5')} FROM scored GROUP BY model, category)"


@query(_CAT)
def e10_category_metrics(v: Source) -> DataFrame:
    return evaluate.category_metrics(v("scored"), 0.5)


@query(f"SELECT model, category, closed, CASE WHEN closed >= 1 AND recall = 0 THEN 'zero' ELSE 'perfect' END AS kind FROM ({_CAT}) WHERE (closed >= 1 AND recall = 0) OR (reliable AND recall = 1)")
def e11_extreme_categories(v: Source) -> DataFrame:
    return evaluate.extreme_categories(evaluate.category_metrics(v("scored"), 0.5), least=1)


def _continual(v: Source, rows: DataFrame) -> DataFrame:
    """AUC of a two-class state fitted on the first release, updated with the second, and fitted on both."""
    rows = rows.withColumn("closed", (F.col("label") < 3).cast("int")).withColumn("key", F.col("id").cast("string"))
    parts = assembly.stratified(rows, "closed", "key", 30)
    old, new = parts.where("NOT held"), parts.where("held")
    first = classify.da_fit(old, label="closed")
    states = {"first": first, "updated": classify.da_merge(first, classify.da_fit(new, label="closed")), "full": classify.da_fit(parts, label="closed")}
    out = None
    for name, state in states.items():
        p = classify.slda_proba(parts, state).select(F.lit(name).alias("model"), F.col("closed").alias("y"), F.round(F.get("proba", F.lit(1)), 9).alias("p_closed"))
        out = p if out is None else out.unionByName(p)
    return evaluate.auc(out)


@query()
def e13_continual_learning(v: Source) -> DataFrame:
    return _continual(v, v("embed"))


_HALVES = """e AS (SELECT id, CASE WHEN label < 3 THEN 1 ELSE 0 END AS closed, CAST(v[1] AS DOUBLE) AS x, CAST(v[2] AS DOUBLE) AS y FROM embed),
  q AS (SELECT closed, n, n * ceil(sum(n) OVER () * 30 / 100) / sum(n) OVER () AS share, ceil(sum(n) OVER () * 30 / 100) AS want FROM (SELECT closed, count(*) AS n FROM e GROUP BY closed)),
  quota AS (SELECT closed, floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, closed) <= want - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM q),
  h AS (SELECT e.*, row_number() OVER (PARTITION BY e.closed ORDER BY md5(id || '42'), CAST(id AS VARCHAR)) <= quota AS held FROM e JOIN quota ON e.closed = quota.closed),
  z AS (SELECT 'first' AS model, * FROM h WHERE NOT held UNION ALL SELECT 'updated', * FROM h UNION ALL SELECT 'full', * FROM h),
  m AS (SELECT model, closed, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, var_pop(y) * count(*) AS syy, covar_pop(x, y) * count(*) AS sxy FROM z GROUP BY model, closed),
  p AS (SELECT model, sum(sxx) / (sum(n) - 2) + 0.0001 AS a, sum(syy) / (sum(n) - 2) + 0.0001 AS b, sum(sxy) / (sum(n) - 2) AS c, sum(n) AS t FROM m GROUP BY model),
  w AS (SELECT m.model, closed, (b * mx - c * my) / (a * b - c * c) AS wx, (a * my - c * mx) / (a * b - c * c) AS wy, ln(n / t) - 0.5 * (b * mx * mx - 2 * c * mx * my + a * my * my) / (a * b - c * c) AS w0 FROM m JOIN p ON m.model = p.model),
  f AS (SELECT w.model, h.closed AS y, round(1 / (1 + exp(sum(CASE WHEN w.closed = 0 THEN 1 ELSE -1 END * (x * wx + h.y * wy + w0)))), 9) AS s FROM h, w GROUP BY w.model, h.id, h.closed),
  g AS (SELECT model, s, sum(y) AS pos, sum(1 - y) AS neg FROM f GROUP BY model, s)"""


@query(f"WITH {_HALVES} SELECT model, round(sum(CAST(pos AS DOUBLE) * (less + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM g) GROUP BY model")
def e13_continual_plane(v: Source) -> DataFrame:
    return _continual(v, _plane(v))


@query("""SELECT model, category, round(sum(CAST(pos AS DOUBLE) * (less + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, category ORDER BY p_closed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less
  FROM (SELECT model, category, p_closed, sum(y) AS pos, sum(1 - y) AS neg FROM scored WHERE category IS NOT NULL GROUP BY ALL)) GROUP BY model, category HAVING sum(pos) * sum(neg) > 0""")
def opt_stratified_auc(v: Source) -> DataFrame:
    return evaluate.stratified_auc(v("scored"), "category")


@query(f"SELECT id, model, y, p_closed, {_ERR} AS error FROM scored")
def e14_s10_error_export(v: Source) -> DataFrame:
    """Written as JSON lines and read back."""
    path = scratch(v, "errors")
    io.write_json_lines(evaluate.error_types(v("scored"), 0.5).select("id", "model", "y", "p_closed", "error"), path)
    return io.json_lines(v.spark, path, "id string, model string, y int, p_closed double, error string")


_P = "greatest(least(CASE WHEN y = 1 THEN p_closed ELSE 1 - p_closed END, 1 - 1e-7), 1e-7)"


@query(f"SELECT model, round(avg(power(1 - {_P}, 2) * CASE WHEN y = 1 THEN 3.0 ELSE 1.0 END * -ln({_P})), 6) AS loss FROM scored GROUP BY model")
def e15_weighted_loss(v: Source) -> DataFrame:
    return evaluate.weighted_loss(v("scored"), 3.0, 2.0)


@query("SELECT model, round(sum(n * gap) / sum(n), 6) AS ece FROM (SELECT model, least(floor(p_closed * 10), 9) AS b, count(*) AS n, abs(avg(p_closed) - avg(y)) AS gap FROM scored GROUP BY 1, 2) GROUP BY model")
def opt_calibration_error(v: Source) -> DataFrame:
    return evaluate.calibration_error(v("scored"))


# sources and sinks, by round trip


@query("SELECT id, name, lon, lat FROM flat_places")
def s4_s5_json_lines(v: Source) -> DataFrame:
    path = scratch(v, "lines")
    good = v("flat_places").select("id", "name", "lon", "lat")
    text = good.select(F.to_json(F.struct("*")).alias("value"))
    text.unionByName(text.limit(3).select(F.lit("{broken").alias("value"))).unionByName(text.limit(2).select(F.lit("").alias("value"))).write.text(path)
    return io.json_lines(v.spark, path, "id string, name string, lon double, lat double").where("id IS NOT NULL")


@query("SELECT id, name, k % 4 <> 0 AS has_geometry, CASE WHEN k % 4 <> 0 THEN lon END AS lon, CASE WHEN k % 4 <> 0 THEN lat END AS lat FROM flat_places")
def s6_geojson_collections(v: Source) -> DataFrame:
    """Collections of at most 500 features each; every fourth place has no geometry."""
    path = scratch(v, "geo")
    io.write_collections(v("flat_places").withColumn("lon", F.when(F.col("k") % 4 != 0, F.col("lon"))), path, "lon", "lat", ["id", "name"], file_rows=500)
    return io.geojson(v.spark, path, "id: string, name: string").select("id", "name", "has_geometry", "lon", "lat")


@query("SELECT id, region, confidence FROM release_a WHERE region = 'NATION_7'")
def s9_parquet_partitions(v: Source) -> DataFrame:
    path = scratch(v, "parts")
    io.write_parquet(v("release_a").select("id", "region", "confidence"), path, "region")
    return io.parquet(v.spark, path).where("region = 'NATION_7'").select("id", "region", "confidence")


@query("SELECT id, status FROM release_b")
def s3_listed_release(v: Source) -> DataFrame:
    """The newest of the folders under a prefix; the others are not read."""
    path = scratch(v, "releases")
    io.write_parquet(relational.tagged_union({"2026-01": v("release_a"), "2026-02": v("release_b")}), path, "release")
    return io.newest_release(v.spark, path).select("id", "status")


@query("SELECT a.id, a.status AS before, b.status AS after FROM release_a a JOIN release_b b ON a.id = b.id WHERE a.status IS DISTINCT FROM b.status")
def s7_attached_releases(v: Source) -> DataFrame:
    """Two releases registered as views and read by one statement."""
    a, b = io.register_release(v("release_a"), "2026-01"), io.register_release(v("release_b"), "2026-02")
    return v.spark.sql(f"SELECT a.id, a.status AS before, b.status AS after FROM {a} a JOIN {b} b ON a.id = b.id WHERE NOT a.status <=> b.status")


@query(_STATE.format("true"))
def s15_state_tables(v: Source) -> DataFrame:
    path = scratch(v, "state")
    io.save_tables(path, ncm_state=classify.ncm_fit(v("embed")))
    return _flat(io.load_tables(v.spark, path, "ncm_state")["ncm_state"])


# streams


@query(_SCATTER)
def x1_streamed_state(v: Source) -> DataFrame:
    """Rows arrive in four files; each micro-batch adds its part of the state."""
    path = scratch(v, "stream")
    v("embed").withColumn("part", F.col("id") % 4).repartition(4, "part").write.parquet(f"{path}/in")
    schema = v("embed").schema
    arriving = v.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    streaming.update_state(arriving, f"{path}/state", f"{path}/checkpoint").awaitTermination()
    return _trace(streaming.read_state(v.spark, f"{path}/state"))


def _drained(v: Source, stream: DataFrame, path: str) -> DataFrame:
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(f"{path}/out")


@query("""WITH m AS (SELECT label, i, avg(CAST(v[i] AS DOUBLE)) AS m FROM embed, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY label, i)
  SELECT id, arg_max(label, -d) AS prediction FROM (SELECT e.id, m.label, sum(power(CAST(v[i] AS DOUBLE) - m, 2)) AS d FROM embed e, m GROUP BY e.id, m.label) GROUP BY id""")
def x2_scored_stream(v: Source) -> DataFrame:
    path = scratch(v, "arrivals")
    v("embed").write.parquet(f"{path}/in")
    stream = v.spark.readStream.schema(v("embed").schema).parquet(f"{path}/in")
    return _drained(v, streaming.score_stream(stream, classify.ncm_fit(v("embed"))).select("id", "prediction"), path)


@query("SELECT event_id FROM events")
def x3_seen_once(v: Source) -> DataFrame:
    """Every event arrives twice."""
    path = scratch(v, "events")
    e = v("events").select("event_id", "ts")
    e.unionByName(e).write.parquet(f"{path}/in")
    stream = v.spark.readStream.schema(e.schema).parquet(f"{path}/in")
    return _drained(v, streaming.seen_once(stream, "event_id", "ts", "30 days").select("event_id"), path)
