"""Survival of places: an order is a sighting of its customer in the order's quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import survival
from .catalogue import query
from .views import Source

_SPELLS = """o AS (SELECT id, release, closed, lag(release) OVER w AS before, lag(closed) OVER w AS was FROM sightings WINDOW w AS (PARTITION BY id ORDER BY release)),
  n AS (SELECT *, sum(CASE WHEN before IS NULL OR was = 1 OR release - before > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY release) AS spell FROM o),
  s AS (SELECT id, CAST(spell AS BIGINT) AS spell, min(release) AS entry, max(release) AS "end", max(release) - min(release) AS duration, max(closed) AS event FROM n GROUP BY id, spell HAVING arg_min(closed, release) = 0)"""


def _spells(v: Source) -> DataFrame:
    return survival.spells(v("sightings"), "id", "release", "closed", max_gap=4)


@query(f'WITH {_SPELLS} SELECT id, spell, entry, "end", duration, event FROM s')
def survival_spells(v: Source) -> DataFrame:
    """Release histories as spells, censored or closed, with late entry after gaps."""
    return _spells(v)


@query(f"WITH {_SPELLS} SELECT id, spell, age, entry + age AS release, CASE WHEN age = duration THEN event ELSE 0 END AS event FROM s, unnest(generate_series(1, duration)) AS u(age)")
def survival_person_periods(v: Source) -> DataFrame:
    return survival.person_periods(_spells(v)).select("id", "spell", "age", "release", "event")


@query(f"""WITH {_SPELLS}, p AS (SELECT id % 5 AS segment, age, CASE WHEN age = duration THEN event ELSE 0 END AS event FROM s, unnest(generate_series(1, duration)) AS u(age)),
  h AS (SELECT segment, age, count(*) AS at_risk, CAST(sum(event) AS BIGINT) AS events FROM p GROUP BY segment, age)
  SELECT segment, age, at_risk, events, round(events / at_risk, 6) AS hazard, round(product(1 - events / at_risk) OVER (PARTITION BY segment ORDER BY age), 6) AS survival FROM h""")
def survival_hazards(v: Source) -> DataFrame:
    """Hazards by age and the running product of what is left, for five segments."""
    got = survival.hazards(survival.person_periods(_spells(v)).withColumn("segment", F.col("id") % 5), "segment")
    return got.select("segment", "age", "at_risk", "events", F.round("hazard", 6).alias("hazard"), F.round("survival", 6).alias("survival"))


_KM = f"""WITH {_SPELLS}, c AS (SELECT id % 3 AS stratum, duration AS time, CAST(sum(event) AS BIGINT) AS events, CAST(sum(1 - event) AS BIGINT) AS censored FROM s GROUP BY 1, 2),
  r AS (SELECT *, CAST(sum(events + censored) OVER (PARTITION BY stratum ORDER BY time DESC) AS BIGINT) AS at_risk FROM c),
  k AS (SELECT *, product(1 - events / at_risk) OVER w AS survival, sum(CASE WHEN at_risk > events THEN events / (CAST(at_risk AS DOUBLE) * (at_risk - events)) ELSE 0 END) OVER w AS green FROM r WINDOW w AS (PARTITION BY stratum ORDER BY time))"""


@query(f"{_KM} SELECT stratum, time, at_risk, events, censored, round(survival, 6) AS survival, round(survival * survival * green, 9) AS variance FROM k")
def survival_kaplan_meier(v: Source) -> DataFrame:
    got = survival.kaplan_meier(_spells(v).withColumn("stratum", F.col("id") % 3), "stratum", "duration", "event")
    return got.select("stratum", "time", "at_risk", "events", "censored", F.round("survival", 6).alias("survival"), F.round("variance", 9).alias("variance"))


@query(f"""WITH {_SPELLS}, x AS (SELECT duration AS t, event AS e, CAST((id * 37 + spell * 11) % 50 AS DOUBLE) / 50 AS r FROM s), d AS (SELECT t, e, r, count(*) AS n FROM x GROUP BY ALL),
  p AS (SELECT a.n * b.n AS w, CASE WHEN a.r > b.r THEN 1 ELSE 0 END AS win, CASE WHEN a.r = b.r THEN 1 ELSE 0 END AS tie FROM d a JOIN d b ON a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0)))
  SELECT CAST(sum(w * win) AS DOUBLE) AS concordant, CAST(sum(w * tie) AS DOUBLE) AS tied, CAST(sum(w) AS DOUBLE) AS comparable, round((sum(w * win) + sum(w * tie) / 2) / sum(w), 6) AS c_index FROM p""")
def survival_concordance(v: Source) -> DataFrame:
    """C-index of a stated risk score over all spells."""
    rows = _spells(v).withColumn("risk", ((F.col("id") * 37 + F.col("spell") * 11) % 50).cast("double") / 50)
    return survival.concordance(rows, "duration", "event", "risk").withColumn("c_index", F.round("c_index", 6))


@query(f"""WITH {_SPELLS}, x AS (SELECT duration AS t, event AS e, CAST(1 + (id * 37 + spell * 11) % 50 AS DOUBLE) / 51 AS o FROM s),
  c AS (SELECT t, sum(1 - e) AS lost, count(*) AS n FROM x GROUP BY t), r AS (SELECT *, sum(n) OVER (ORDER BY t DESC) AS at_risk FROM c),
  g AS (SELECT t, product(1 - lost / at_risk) OVER (ORDER BY t) AS now, coalesce(product(1 - lost / at_risk) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM r),
  h AS (SELECT coalesce(arg_max(now, t), 1) AS stay FROM g WHERE t <= 6)
  SELECT count(*) AS n, round(sum(CASE WHEN x.t <= 6 AND e = 1 THEN o * o / before WHEN x.t > 6 THEN (1 - o) * (1 - o) / stay ELSE 0 END) / count(*), 6) AS brier FROM x JOIN g ON g.t = x.t, h""")
def survival_brier(v: Source) -> DataFrame:
    """Brier score six quarters ahead, censored spells weighted out."""
    rows = _spells(v).withColumn("open", (1 + (F.col("id") * 37 + F.col("spell") * 11) % 50).cast("double") / 51)
    return survival.brier(rows, "duration", "event", "open", 6).withColumn("brier", F.round("brier", 6))
