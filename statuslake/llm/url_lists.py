"""URL filters as of the time of fetching: a temporal join with dated list entries.

List events (domain, action ``add`` or ``remove``, list, at) become validity intervals: an entry holds from an ``add``
until the next event of its domain and list.  A capture is looked up by its host and the host's parent domains, each
against the interval that holds its time of fetching: the as-of join is an equi-join on the domain with the interval as
the further condition, so at most one interval of a domain and list matches.

Captures are reduced to distinct (host, time) before the join.  Intervals are broadcast if at most
``BROADCAST_INTERVALS`` (counted first); beyond that both sides are shuffled by domain, where adaptive execution splits
a hot host.

Defined results: a null or unreadable URL has no host and is not blocked, nor is a capture without a time; events with
a null domain, time or action are ignored; of events at the same instant ``remove`` wins; repeated captures each keep a
row; without events nothing is blocked; all columns of the captures stay, but for those
named as a result column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: About 100 bytes each: 50 MB.
BROADCAST_INTERVALS = 500_000


def host(url: str) -> Column:
    """The lower-cased host of an absolute URL, an IPv6 address without its brackets; null if there is none."""
    authority = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), "^.*@", "")
    name = F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[([^\]]+)\]", 1)).otherwise(F.regexp_extract(authority, "^[^:]*", 0))
    found = F.regexp_replace(F.lower(name), r"\.+$", "")
    return F.when(found != "", found)


def with_parents(name: str) -> Column:
    """A host and its parent domains; an IP address has none."""
    parents = F.expr(f"transform(sequence(1, size(split({name}, '[.]'))), i -> array_join(slice(split({name}, '[.]'), i, size(split({name}, '[.]'))), '.'))")
    return F.when(F.col(name).rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|:"), F.array(name)).otherwise(parents)


def intervals(events: DataFrame) -> DataFrame:
    """(list, domain, since, until): when an entry holds, ``until`` not included and null where it still does."""
    known = events.where("domain IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    last = known.groupBy("list", F.lower("domain").alias("domain"), "at").agg(F.max("action").alias("action"))
    following = F.lead("at").over(Window.partitionBy("list", "domain").orderBy("at"))
    return last.withColumn("until", following).where("action = 'add'").select("list", "domain", F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, events: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with host, blocked, and the matched domain (the longest), its list and since when it is listed."""
    captures = captures.drop("host", "blocked", "listed_domain", "list", "since")
    held = intervals(events)
    if held.count() <= BROADCAST_INTERVALS:
        held = F.broadcast(held)
    named = captures.withColumn("host", host(url))
    asked = named.select("host", F.col(at).alias("time")).where("host IS NOT NULL AND time IS NOT NULL").distinct()
    each = asked.select("host", "time", F.explode(with_parents("host")).alias("domain"))
    met = each.join(held, "domain").where("since <= time AND (until IS NULL OR time < until)")
    best = met.groupBy("host", "time").agg(F.max_by(F.struct("domain", "list", "since"), F.struct(F.length("domain"), "list")).alias("statuslake_m")).withColumnsRenamed({"host": "statuslake_host", "time": "statuslake_time"})
    out = named.join(best, (named["host"] == best["statuslake_host"]) & (named[at] == best["statuslake_time"]), "left")
    return out.select(*captures.columns, "host", F.col("statuslake_m").isNotNull().alias("blocked"), F.col("statuslake_m.domain").alias("listed_domain"), F.col("statuslake_m.list").alias("list"), F.col("statuslake_m.since").alias("since"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures, at a date that follows from the page's id."""
    return pages.select("page_id", "url", F.expr("date_add(DATE'2024-01-01', CAST(page_id * 7919 % 730 AS INT))").alias("fetched_at"))


def page_events(pages: DataFrame) -> DataFrame:
    """List events drawn from the pages' own hosts: a third of the pages list or clear their host at some date."""
    day = F.expr("date_add(DATE'2024-01-01', CAST(page_id * 31 % 700 AS INT))")
    action = F.expr("CASE WHEN page_id % 10 IN (3, 5) THEN 'add' WHEN page_id % 10 = 7 THEN 'remove' END")
    name = F.expr("IF(page_id % 4 = 1, 'malware', 'adult')")
    return pages.select(name.alias("list"), host("url").alias("domain"), action.alias("action"), day.alias("at"))


ORACLE = r"""
WITH a AS (SELECT *, string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '@')[-1] AS auth FROM pages),
p AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 7919 % 730 AS INTEGER) AS DATE) AS fetched_at,
       CAST(DATE '2024-01-01' + CAST(page_id * 31 % 700 AS INTEGER) AS DATE) AS day,
       nullif(rtrim(lower(CASE WHEN auth LIKE '[%' THEN string_split(auth[2:], ']')[1] ELSE string_split(auth, ':')[1] END), '.'), '') AS host FROM a),
e AS (SELECT CASE WHEN page_id % 4 = 1 THEN 'malware' ELSE 'adult' END AS list, host AS domain, day,
       max(CASE WHEN page_id % 10 IN (3, 5) THEN 'add' ELSE 'remove' END) AS action
      FROM p WHERE page_id % 10 IN (3, 5, 7) AND host IS NOT NULL GROUP BY ALL),
i AS (SELECT * FROM (SELECT list, domain, day AS since, action, lead(day) OVER (PARTITION BY list, domain ORDER BY day) AS until FROM e) WHERE action = 'add'),
m AS (SELECT p.page_id, domain, list, since FROM p JOIN i ON (p.host = i.domain OR (ends_with(p.host, '.' || i.domain) AND NOT regexp_full_match(p.host, '[0-9]{1,3}(\.[0-9]{1,3}){3}') AND NOT contains(p.host, ':'))) AND since <= fetched_at AND (until IS NULL OR fetched_at < until)
      QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(domain) DESC, list DESC) = 1)
SELECT p.page_id, p.url, p.fetched_at, p.host, m.domain IS NOT NULL AS blocked, m.domain AS listed_domain, m.list, m.since FROM p LEFT JOIN m USING (page_id)
"""
