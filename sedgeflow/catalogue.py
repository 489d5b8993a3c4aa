"""The registered queries over the driver's tables, and the same in SQL.

The tables stand in for the engine's inputs by the adapters below: `events` for facts, `orders` for
a change log, `lineitem` with `part` and `supplier` for joins.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeflow.operators import attribution, dedup, dimensions, history, joins, metrics, public, retention, sessions
from sedgeflow.sources import lake

CUTOFF = datetime(2024, 1, 28, 15, 59, 59, tzinfo=timezone.utc)
UTC = timezone.utc
#: Users of the tables act every eleven hours or so: a journey from click to completion may take five days.
JOURNEY_MINUTES = 7200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- adapters -------------------------------------------------------------------------------


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as facts. Views are page views of the path /k, clicks entry clicks, signups arrivals,
    errors observed requests, every third of them a selected character, purchases completed requests
    that succeed from a value of 5. Ids of jumps and requests repeat within three days of a user."""
    e = read(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "page_view", "click", "entry_click", "signup", "entry_arrival", "error", "request_observed", "purchase", "request_complete")]), F.col("event_type"))
    kind = F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "character_select").otherwise(kind)
    days = F.floor(F.unix_seconds(at) / 259200).cast("string")
    user = F.col("user_id").cast("string")
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        F.when(F.col("event_id") % 4 == 0, "synthetic").otherwise("real").alias("source"),
        F.when(F.col("event_type").isin("view", "click"), "site").otherwise("game").alias("app"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"),
        kind.alias("event_type"),
        at.alias("event_time"),
        (at + F.expr("INTERVAL 1 SECOND")).alias("accepted"),
        user.alias("anonymous_id"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("/"), F.regexp_extract("props", r":\s*(\d+)", 1))).alias("path"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string"))).alias("character_id"),
        F.concat(user, F.lit("-"), days).alias("jump_id"),
        F.concat(F.lit("ch"), (F.col("user_id") % 3).cast("string")).alias("channel"),
        F.concat(user, F.lit("-"), days).alias("request_id"),
        (F.col("value") >= 5).alias("success"),
        "value",
    )


FACTS = """f AS (SELECT event_id + 1 AS seq, CASE WHEN event_id % 4 = 0 THEN 'synthetic' ELSE 'real' END AS source,
  CASE WHEN event_type IN ('view', 'click') THEN 'site' ELSE 'game' END AS app, lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id,
  CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'entry_click' WHEN 'signup' THEN 'entry_arrival' WHEN 'error' THEN (CASE WHEN event_id % 3 = 0 THEN 'character_select' ELSE 'request_observed' END) WHEN 'purchase' THEN 'request_complete' END AS event_type,
  ts AS event_time, ts + INTERVAL 1 SECOND AS accepted, CAST(user_id AS VARCHAR) AS anonymous_id,
  CASE WHEN event_type = 'view' THEN '/' || regexp_extract(props, ':\\s*(\\d+)', 1) END AS path,
  CASE WHEN event_type = 'error' THEN 'c' || CAST(event_id % 7 AS VARCHAR) END AS character_id,
  CAST(user_id AS VARCHAR) || '-' || CAST(CAST(floor(epoch(ts) / 259200) AS BIGINT) AS VARCHAR) AS jump_id,
  'ch' || CAST(user_id % 3 AS VARCHAR) AS channel,
  CAST(user_id AS VARCHAR) || '-' || CAST(CAST(floor(epoch(ts) / 259200) AS BIGINT) AS VARCHAR) AS request_id,
  value >= 5 AS success, value, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day FROM events)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a change log of their customers: O opens, F resolves, P is pending; a customer's
    order whose key leaves 9 by 10 is a delete."""
    o = read(spark, sf_dir, "orders")
    status = F.element_at(F.create_map(*map(F.lit, ("O", "open", "F", "resolved", "P", "pending"))), F.col("o_orderstatus"))
    gone = F.col("o_orderkey") % 10 == 9
    after = F.struct(F.lit(None).cast("string").alias("title"), F.col("o_orderpriority").alias("category"), status.alias("status"))
    return o.select(
        F.lit("synthetic").alias("source"),
        F.lit("tickets").alias("table"),
        F.col("o_custkey").cast("string").alias("key"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
        F.col("o_orderkey").alias("version"),
        F.when(gone, "d").otherwise("u").alias("op"),
        F.when(~gone, after).alias("after"),
        F.lit("orders").alias("kafka_topic"),
        F.lit(0).cast("long").alias("kafka_partition"),
        F.col("o_orderkey").alias("kafka_offset"),
    )


CHANGES = """c AS (SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderdate AS t, o_orderkey AS version, CASE WHEN o_orderkey % 10 = 9 THEN 'd' ELSE 'u' END AS op,
  CASE WHEN o_orderkey % 10 <> 9 THEN CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'pending' END END AS status,
  CASE WHEN o_orderkey % 10 <> 9 THEN o_orderpriority END AS category, CAST(o_orderdate + INTERVAL 8 HOUR AS DATE) AS day FROM orders)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def micros(column: str):
    return F.unix_micros(column)


# --- events ---------------------------------------------------------------------------------


@query(f"""WITH {FACTS} SELECT source, app, CAST(day AS VARCHAR) AS business_date, count(*) FILTER (event_type = 'page_view') AS pv, count(DISTINCT anonymous_id) AS uv,
  count(*) FILTER (event_type = 'request_complete') AS requests, count(*) FILTER (event_type = 'request_complete' AND success) AS successes FROM f GROUP BY 1, 2, 3""")
def daily_metrics(spark, sf_dir):
    return metrics.daily(facts(spark, sf_dir)).withColumn("business_date", F.col("business_date").cast("string"))


@query(f"""WITH {FACTS} SELECT source, app, CAST(day AS VARCHAR) AS business_date, count(*) FILTER (event_type = 'page_view') AS pv, count(DISTINCT anonymous_id) AS uv,
  count(*) FILTER (event_type = 'request_complete') AS requests, count(*) FILTER (event_type = 'request_complete' AND success) AS successes
  FROM f WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-11' GROUP BY 1, 2, 3""")
def daily_metrics_window(spark, sf_dir):
    return metrics.daily(facts(spark, sf_dir), date(2024, 1, 5), date(2024, 1, 11)).withColumn("business_date", F.col("business_date").cast("string"))


@query(f"""WITH {FACTS}, d AS (SELECT source, app, day, count(*) FILTER (event_type = 'request_complete') AS r, count(*) FILTER (event_type = 'request_complete' AND success) AS s FROM f GROUP BY 1, 2, 3)
  SELECT source, app, CAST(day AS VARCHAR) AS business_date, round(s / nullif(r, 0), 9) AS rate FROM d""")
def daily_success_rate(spark, sf_dir):
    d = metrics.daily(facts(spark, sf_dir))
    return d.select("source", "app", F.col("business_date").cast("string").alias("business_date"), F.round(metrics.success_rate(F.col("successes"), F.col("requests")), 9).alias("rate"))


@query(f"""WITH {FACTS}, k AS (SELECT source, app, day, CASE WHEN event_type = 'page_view' THEN 'page' ELSE 'character' END AS kind, CASE WHEN event_type = 'page_view' THEN path ELSE character_id END AS name, anonymous_id
  FROM f WHERE event_type = 'page_view' OR (event_type = 'character_select'))
  SELECT source, app, CAST(day AS VARCHAR) AS business_date, kind, name, count(*) AS n, count(DISTINCT anonymous_id) AS visitors FROM k WHERE name IS NOT NULL GROUP BY 1, 2, 3, 4, 5""")
def popularity(spark, sf_dir):
    return metrics.popularity(facts(spark, sf_dir)).withColumn("business_date", F.col("business_date").cast("string"))


def _replayed(spark, sf_dir):
    """facts, and a later delivery of every fifth one, every tenth of those with another value."""
    f = facts(spark, sf_dir)
    late = f.where(F.col("seq") % 5 == 0)
    again = late.withColumns({"seq": F.col("seq") + 10_000_000, "accepted": F.col("accepted") + F.expr("INTERVAL 1 HOUR"), "value": F.when(F.col("seq") % 10 == 0, -F.col("value") - 1).otherwise(F.col("value")), "channel": F.when(F.col("seq") % 10 == 0, "other").otherwise(F.col("channel"))})
    return f.unionByName(again)


REPLAYED = f"""{FACTS}, v AS (SELECT * FROM f UNION ALL SELECT * REPLACE (seq + 10000000 AS seq, accepted + INTERVAL 1 HOUR AS accepted, CASE WHEN seq % 10 = 0 THEN -value - 1 ELSE value END AS value, CASE WHEN seq % 10 = 0 THEN 'other' ELSE channel END AS channel) FROM f WHERE seq % 5 = 0)"""


@query(f"""WITH {REPLAYED}, a AS (SELECT *, row_number() OVER (PARTITION BY source, app, event_id ORDER BY accepted, seq) AS n FROM v),
  b AS (SELECT *, CASE WHEN event_type = 'request_complete' THEN 'request:' || request_id ELSE 'event:' || event_id END AS business_key FROM a WHERE n = 1),
  c AS (SELECT *, row_number() OVER (PARTITION BY source, app, business_key ORDER BY accepted, seq) AS m FROM b) SELECT seq, source, app, event_id, business_key FROM c WHERE m = 1""")
def event_dedup(spark, sf_dir):
    return dedup.deduplicate(_replayed(spark, sf_dir)).select("seq", "source", "app", "event_id", "business_key")


@query(f"WITH {REPLAYED} SELECT source, app, event_id, count(*) AS n, count(DISTINCT value) AS contents FROM v GROUP BY 1, 2, 3 HAVING count(DISTINCT value) > 1")
def event_conflicts(spark, sf_dir):
    return dedup.conflicts(_replayed(spark, sf_dir), ["source", "app", "event_id"], ["event_type", "value"])


@query(f"""WITH {REPLAYED}, s AS (SELECT *, CASE WHEN value < 1 AND value >= 0 THEN 'quarantine' WHEN accepted > TIMESTAMP '2024-01-28 15:59:59' THEN 'after_cutoff' ELSE 'valid' END AS state FROM v),
  k AS (SELECT DISTINCT source, app, CASE WHEN event_type = 'request_complete' THEN 'request:' || request_id ELSE 'event:' || event_id END FROM s WHERE state = 'valid')
  SELECT count(*) AS raw, (SELECT count(*) FROM k) AS valid, count(*) FILTER (state = 'valid') - (SELECT count(*) FROM k) AS duplicates, count(*) FILTER (state = 'quarantine') AS quarantined, count(*) FILTER (state = 'after_cutoff') AS after_cutoff FROM s""")
def quality_counters(spark, sf_dir):
    state = F.when(F.col("value").between(0, 0.9999999999), "quarantine").when(F.col("accepted") > F.lit(CUTOFF), "after_cutoff").otherwise("valid")
    seen = _replayed(spark, sf_dir).withColumn("state", state)
    return dedup.quality_counts(seen, dedup.deduplicate(seen.where("state = 'valid'")))


def _session_sql(gap: str) -> str:
    return f"""WITH {FACTS}, l AS (SELECT *, lag(event_time) OVER w AS p FROM f WHERE event_time <= TIMESTAMP '2024-01-28 15:59:59' WINDOW w AS (PARTITION BY source, app, anonymous_id ORDER BY event_time, event_id)),
  n AS (SELECT *, sum(CASE WHEN p IS NULL OR event_time >= p + INTERVAL {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY source, app, anonymous_id ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING) AS session FROM l),
  s AS (SELECT source, app, anonymous_id, session, min(event_time) AS a, max(event_time) AS b, count(*) AS events FROM n GROUP BY 1, 2, 3, 4),
  x AS (SELECT source, app, anonymous_id, epoch_us(a) AS start_us, epoch_us(b) AS end_us, events, CAST(a + INTERVAL 8 HOUR AS DATE) AS day, (epoch_us(b) - epoch_us(a)) / 1e6 AS duration_seconds, b + INTERVAL {gap} <= TIMESTAMP '2024-01-28 15:59:59' AS closed FROM s)
"""


def _sessions(spark, sf_dir, gap):
    return sessions.sessions(facts(spark, sf_dir), CUTOFF, gap)


def _flat_sessions(s):
    return s.select("source", "app", "anonymous_id", micros("start").alias("start_us"), micros("end").alias("end_us"), "events", F.col("date").cast("string").alias("date"), "duration_seconds", "closed")


@query(_session_sql("30 MINUTES") + "SELECT source, app, anonymous_id, start_us, end_us, events, CAST(day AS VARCHAR) AS date, duration_seconds, closed FROM x")
def sessions_30m(spark, sf_dir):
    return _flat_sessions(_sessions(spark, sf_dir, 30))


@query(_session_sql("1440 MINUTES") + "SELECT source, app, anonymous_id, start_us, end_us, events, CAST(day AS VARCHAR) AS date, duration_seconds, closed FROM x")
def sessions_24h(spark, sf_dir):
    return _flat_sessions(_sessions(spark, sf_dir, 1440))


@query(_session_sql("1440 MINUTES") + """SELECT source, app, CAST(day AS VARCHAR) AS date, count(*) AS sessions, count(DISTINCT anonymous_id) AS users, CAST(sum(events) AS BIGINT) AS events,
  round(sum(duration_seconds), 3) AS duration_seconds, count(*) FILTER (closed) AS closed_sessions FROM x GROUP BY 1, 2, 3""")
def session_daily(spark, sf_dir):
    d = sessions.session_daily(_sessions(spark, sf_dir, 1440))
    return d.withColumns({"date": F.col("date").cast("string"), "duration_seconds": F.round("duration_seconds", 3)})


@query(f"""WITH {FACTS}, d AS (SELECT DISTINCT source, app, anonymous_id, day FROM f WHERE event_time <= TIMESTAMP '2024-01-28 15:59:59' AND day <= DATE '2024-01-27'),
  c AS (SELECT source, app, anonymous_id, min(day) AS cohort_date FROM d GROUP BY 1, 2, 3),
  r AS (SELECT c.*, EXISTS (SELECT 1 FROM d WHERE d.source = c.source AND d.app = c.app AND d.anonymous_id = c.anonymous_id AND d.day = c.cohort_date + 1) AS r1,
        EXISTS (SELECT 1 FROM d WHERE d.source = c.source AND d.app = c.app AND d.anonymous_id = c.anonymous_id AND d.day = c.cohort_date + 7) AS r7 FROM c)
  SELECT source, app, CAST(cohort_date AS VARCHAR) AS cohort_date, count(*) AS users, CASE WHEN cohort_date + 1 <= DATE '2024-01-27' THEN count(*) ELSE 0 END AS eligible_d1,
  CASE WHEN cohort_date + 1 <= DATE '2024-01-27' THEN count(*) FILTER (r1) END AS retained_d1, CASE WHEN cohort_date + 7 <= DATE '2024-01-27' THEN count(*) ELSE 0 END AS eligible_d7,
  CASE WHEN cohort_date + 7 <= DATE '2024-01-27' THEN count(*) FILTER (r7) END AS retained_d7 FROM r GROUP BY source, app, r.cohort_date""")
def retention_d1_d7(spark, sf_dir):
    return retention.retention(facts(spark, sf_dir), CUTOFF).withColumn("cohort_date", F.col("cohort_date").cast("string"))


@query(f"""WITH {FACTS}, d AS (SELECT DISTINCT source, app, anonymous_id, day FROM f WHERE event_time <= TIMESTAMP '2024-01-28 15:59:59' AND day <= DATE '2024-01-27'),
  c AS (SELECT source, app, anonymous_id, min(day) AS cohort_date FROM d GROUP BY 1, 2, 3),
  r AS (SELECT c.*, EXISTS (SELECT 1 FROM d WHERE d.source = c.source AND d.app = c.app AND d.anonymous_id = c.anonymous_id AND d.day = c.cohort_date + 1) AS r1 FROM c WHERE cohort_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-28'),
  s AS (SELECT *, CASE WHEN cohort_date + 2 > DATE '2024-01-28' THEN 'pending' WHEN cohort_date < DATE '2024-01-03' OR cohort_date <= DATE '2024-01-04' THEN 'incomplete' ELSE 'complete_accepted_prefix' END AS status_d1 FROM r)
  SELECT source, app, CAST(cohort_date AS VARCHAR) AS cohort_date, count(*) AS users, status_d1, CASE WHEN status_d1 = 'complete_accepted_prefix' THEN count(*) ELSE 0 END AS eligible_d1,
  CASE WHEN status_d1 = 'complete_accepted_prefix' THEN count(*) FILTER (r1) END AS retained_d1 FROM s GROUP BY source, app, s.cohort_date, status_d1""")
def retention_covered(spark, sf_dir):
    from datetime import timedelta

    start = datetime(2024, 1, 2, 16, tzinfo=UTC)  # Hong Kong's 3 January
    gap = (datetime(2024, 1, 3, 18, tzinfo=UTC), datetime(2024, 1, 3, 20, tzinfo=UTC))
    days = [date(2024, 1, 1) + timedelta(days=n) for n in range(28)]
    out = retention.covered_retention(facts(spark, sf_dir), CUTOFF, start, [gap], start, days, (1,))
    return out.withColumn("cohort_date", F.col("cohort_date").cast("string"))


ATTRIBUTION = f"""WITH {FACTS}, clicks AS (SELECT source, jump_id, channel, event_time AS click_time, event_time + INTERVAL 120 HOUR AS until, day FROM (SELECT *, row_number() OVER (PARTITION BY source, jump_id ORDER BY event_time, event_id) AS n FROM f WHERE event_type = 'entry_click') WHERE n = 1),
  arrivals AS (SELECT * FROM (SELECT f.source, f.jump_id, f.anonymous_id, c.channel, click_time, until, f.event_time AS arrival_time, row_number() OVER (PARTITION BY f.source, f.jump_id ORDER BY f.event_time, f.event_id) AS n FROM f JOIN clicks c ON f.source = c.source AND f.jump_id = c.jump_id AND f.event_time BETWEEN click_time AND until WHERE f.event_type = 'entry_arrival') WHERE n = 1),
  observed AS (SELECT source, request_id, anonymous_id, event_time AS observed_time FROM (SELECT *, row_number() OVER (PARTITION BY source, request_id ORDER BY event_time, event_id) AS n FROM f WHERE event_type = 'request_observed') WHERE n = 1),
  requested AS (SELECT a.*, request_id, observed_time FROM arrivals a JOIN observed o ON a.source = o.source AND a.anonymous_id = o.anonymous_id AND observed_time BETWEEN arrival_time AND until),
  selected AS (SELECT source, jump_id FROM arrivals a WHERE EXISTS (SELECT 1 FROM f WHERE f.event_type = 'character_select' AND f.source = a.source AND f.anonymous_id = a.anonymous_id AND f.event_time BETWEEN arrival_time AND until)),
  completions AS (SELECT r.*, f.event_time AS complete_time FROM requested r JOIN f ON f.source = r.source AND f.request_id = r.request_id AND f.event_type = 'request_complete' AND f.success AND f.event_time BETWEEN observed_time AND until),
  lastc AS (SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY source, request_id ORDER BY click_time DESC, jump_id DESC, complete_time) AS n FROM completions) WHERE n = 1),
  conv AS (SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY source, jump_id ORDER BY complete_time, request_id) AS n FROM lastc) WHERE n = 1)
"""


@query(ATTRIBUTION + "SELECT source, jump_id, request_id, channel, CAST(CAST(click_time + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS date FROM conv")
def attribution_conversions(spark, sf_dir):
    parts = attribution.steps(facts(spark, sf_dir), JOURNEY_MINUTES)
    return attribution.conversions(parts).withColumn("date", F.col("date").cast("string"))


@query(ATTRIBUTION + """SELECT c.source, c.channel, CAST(c.day AS VARCHAR) AS date, count(*) AS clicks, count(a.jump_id) AS arrived, count(*) FILTER (EXISTS (SELECT 1 FROM selected s WHERE s.source = c.source AND s.jump_id = c.jump_id)) AS selected,
  count(*) FILTER (EXISTS (SELECT 1 FROM requested r WHERE r.source = c.source AND r.jump_id = c.jump_id)) AS requested, count(*) FILTER (EXISTS (SELECT 1 FROM conv v WHERE v.source = c.source AND v.jump_id = c.jump_id)) AS converted
  FROM clicks c LEFT JOIN arrivals a ON a.source = c.source AND a.jump_id = c.jump_id GROUP BY c.source, c.channel, c.day""")
def attribution_funnel(spark, sf_dir):
    parts = attribution.steps(facts(spark, sf_dir), JOURNEY_MINUTES)
    return attribution.funnel(parts, attribution.conversions(parts)).withColumn("date", F.col("date").cast("string"))


@query(f"""WITH {REPLAYED}, o AS (SELECT *, CASE WHEN event_type = 'request_complete' THEN 'request:' || request_id ELSE 'event:' || event_id END AS business_key FROM v),
  live AS (SELECT * FROM o WHERE accepted + INTERVAL 7 DAY > TIMESTAMP '2024-01-20 00:00:00'), r AS (SELECT *, row_number() OVER (PARTITION BY source, app, business_key ORDER BY accepted, seq) AS n FROM live)
  SELECT seq, source, app, business_key, epoch_us(accepted) AS accepted_us FROM r WHERE n = 1""")
def state_merge(spark, sf_dir):
    from sedgeflow.functions.contract import business_key

    all_rows = _replayed(spark, sf_dir).withColumn("business_key", business_key(F.col("event_type"), F.col("request_id"), F.col("event_id")))
    merged = dedup.state_merge(all_rows.where("seq < 10000000"), all_rows.where("seq >= 10000000"), datetime(2024, 1, 20, tzinfo=UTC), 7)
    return merged.select("seq", "source", "app", "business_key", micros("accepted").alias("accepted_us"))


PUBLIC = f"""WITH {FACTS}, r AS (SELECT *, CAST(day AS TIMESTAMP) + INTERVAL 3 DAY + INTERVAL 15 MINUTE - INTERVAL 8 HOUR AS cutoff_at FROM f WHERE source = 'real'),
  k AS (SELECT * FROM r WHERE accepted < cutoff_at),
  b AS (SELECT app, day, cutoff_at, count(*) FILTER (event_type = 'page_view') AS pv, count(DISTINCT CASE WHEN event_type <> 'request_complete' THEN anonymous_id END) AS uv, count(*) FILTER (event_type = 'request_complete') AS requests, count(*) FILTER (event_type = 'request_complete' AND success) AS successes FROM k GROUP BY 1, 2, 3),
  g AS (SELECT app, day, min(v) AS least, count(*) AS categories FROM (SELECT app, day, CASE WHEN event_type = 'page_view' THEN 'page:' || path ELSE 'character:' || character_id END AS c, count(DISTINCT anonymous_id) AS v FROM k WHERE event_type IN ('page_view', 'character_select') GROUP BY 1, 2, 3) GROUP BY 1, 2),
  s AS (SELECT b.*, least, categories, cutoff_at > TIMESTAMP '2024-01-27 16:15:00' AS pending FROM b LEFT JOIN g ON b.app = g.app AND b.day = g.day),
  p AS (SELECT *, CASE WHEN pending THEN 'pending' WHEN pv = 0 AND uv = 0 THEN 'empty' WHEN uv >= 10 THEN 'published' ELSE 'suppressed' END AS access,
    CASE WHEN pending THEN 'pending' WHEN requests = 0 THEN 'empty' WHEN requests >= 10 AND (successes = 0 OR successes >= 10) AND (requests - successes = 0 OR requests - successes >= 10) THEN 'published' ELSE 'suppressed' END AS quality,
    CASE WHEN pending THEN 'pending' WHEN categories IS NULL THEN 'empty' WHEN least < 10 THEN 'suppressed' ELSE 'published' END AS popularity FROM s)
  SELECT app, CAST(day AS VARCHAR) AS date, epoch_us(cutoff_at) AS cutoff_us, access, quality, popularity, CASE WHEN access = 'published' THEN pv END AS pv, CASE WHEN access = 'published' THEN uv END AS uv,
    CASE WHEN quality = 'published' THEN requests END AS requests, CASE WHEN quality = 'published' THEN successes END AS successes, CASE WHEN popularity = 'published' THEN categories END AS categories FROM p"""


def _projected(spark, sf_dir, now=CUTOFF):
    return public.projection(facts(spark, sf_dir), now)


def _flat_public(p):
    return p.select("app", F.col("date").cast("string").alias("date"), micros("cutoff_at").alias("cutoff_us"), "access", "quality", "popularity", "pv", "uv", "requests", "successes", "categories")


@query(PUBLIC)
def public_projection(spark, sf_dir):
    return _flat_public(_projected(spark, sf_dir))


@query(PUBLIC.replace("AS categories FROM p", "AS categories FROM p WHERE access <> 'pending'"))
def public_freeze(spark, sf_dir):
    """Days frozen a week before, and those that came due since."""
    earlier = _projected(spark, sf_dir, datetime(2024, 1, 21, tzinfo=UTC)).where("access <> 'pending'")
    return _flat_public(public.freeze(earlier, _projected(spark, sf_dir)))


@query(f"""WITH {FACTS}, d AS (SELECT source, app, day, count(*) FILTER (event_type = 'page_view') AS pv, count(DISTINCT anonymous_id) AS uv, count(*) FILTER (event_type = 'request_complete') AS requests, count(*) FILTER (event_type = 'request_complete' AND success) AS successes FROM f GROUP BY 1, 2, 3)
  SELECT source, app, CAST(day AS VARCHAR) AS business_date, pv, uv, requests, successes FROM d WHERE ((pv = 0 AND uv = 0) OR uv >= 10) AND (requests = 0 OR (requests >= 10 AND (successes = 0 OR successes >= 10) AND (requests - successes = 0 OR requests - successes >= 10)))""")
def public_legacy(spark, sf_dir):
    return public.legacy(metrics.daily(facts(spark, sf_dir))).withColumn("business_date", F.col("business_date").cast("string"))


# --- dimensions -----------------------------------------------------------------------------

RELEASES = (("r1", 3, 10), ("r2", 10, 17), ("r3", 18, 25))


def _dims(spark):
    """Three releases of one app with a gap in what was covered; r2 lacks the pages /0 to /9 of r1."""
    rel = spark.createDataFrame([("real", "site", r, datetime(2024, 1, a, tzinfo=UTC), datetime(2024, 1, b, tzinfo=UTC)) for r, a, b in RELEASES], "source string, app string, release_id string, covered_from timestamp, covered_to timestamp")
    order = rel.select("source", "app", "release_id", F.col("covered_from").alias("release_at"))
    keys = spark.range(0, 60).select(F.concat(F.lit("/"), F.col("id").cast("string")).alias("key"), "id")
    parts = [keys.where(c).select(F.lit("real").alias("source"), F.lit("site").alias("app"), F.lit(r).alias("release_id"), F.lit("page").alias("kind"), "key", F.concat(F.lit(r + ":"), F.col("key")).alias("dimension_id")) for r, c in (("r1", "id < 40"), ("r2", "id >= 10 AND id < 50"), ("r3", "id < 60"))]
    return rel, order, parts[0].union(parts[1]).union(parts[2])


DIMS = """cov AS (SELECT * FROM (VALUES ('r1', TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-10', 0, 40), ('r2', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-17', 10, 50), ('r3', TIMESTAMP '2024-01-18', TIMESTAMP '2024-01-25', 0, 60)) AS t(r, a, b, lo, hi)),
  p AS (SELECT *, CAST(substr(path, 2) AS INTEGER) AS k FROM f WHERE event_type = 'page_view')"""


@query(f"""WITH {FACTS}, {DIMS} SELECT seq AS fact_ordinal, source, app, 'page' AS kind, r AS release_id, CASE WHEN k >= lo AND k < hi THEN r || ':' || path END AS dimension_id,
  CASE WHEN r IS NULL THEN 'unknown' WHEN k >= lo AND k < hi THEN 'present' ELSE 'not_present' END AS dimension_status FROM p LEFT JOIN cov ON source = 'real' AND event_time >= a AND event_time < b""")
def dim_at_event(spark, sf_dir):
    rel, order, entries = _dims(spark)
    found = dimensions.facts_of(facts(spark, sf_dir)).where("kind = 'page'")
    return dimensions.at_event(found, rel, dimensions.with_tombstones(entries, order)).select(*dimensions.OUT)


@query(f"""WITH {FACTS}, {DIMS} SELECT seq AS fact_ordinal, source, app, 'page' AS kind, CASE WHEN source = 'real' THEN 'r2' END AS release_id, CASE WHEN source = 'real' AND k >= 10 AND k < 50 THEN 'r2:' || path END AS dimension_id,
  CASE WHEN source <> 'real' THEN 'unknown' WHEN k >= 10 AND k < 50 THEN 'present' ELSE 'not_present' END AS dimension_status FROM p""")
def dim_current(spark, sf_dir):
    rel, order, entries = _dims(spark)
    seen = rel.withColumnsRenamed({"covered_from": "observed_at", "covered_to": "checked_through"})
    found = dimensions.facts_of(facts(spark, sf_dir)).where("kind = 'page'")
    return dimensions.current(found, seen, dimensions.with_tombstones(entries, order), datetime(2024, 1, 17, tzinfo=UTC)).select(*dimensions.OUT)


@query("""SELECT r || '' AS release_id, k AS n, t AS tombstones FROM (VALUES ('r1', 40, 0), ('r2', 50, 10), ('r3', 60, 0)) AS x(r, k, t)""")
def dim_tombstones(spark, sf_dir):
    _, order, entries = _dims(spark)
    made = dimensions.with_tombstones(entries, order)
    return made.groupBy("release_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(~F.col("present")).cast("int").alias("tombstones"))


# --- histories ------------------------------------------------------------------------------

SCD = f"""WITH {CHANGES}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, t ORDER BY version DESC) AS n FROM c) WHERE n = 1),
  s AS (SELECT key, t AS valid_from, lead(t) OVER (PARTITION BY key ORDER BY t) AS valid_to, version, category, status, op = 'd' AS deleted FROM o)
"""


@query(SCD + "SELECT 'synthetic' AS source, key, epoch_us(valid_from) AS from_us, epoch_us(valid_to) AS to_us, version, category, status, deleted FROM s")
def scd2_orders(spark, sf_dir):
    return history.scd2(changes(spark, sf_dir)).select("source", "key", micros("valid_from").alias("from_us"), micros("valid_to").alias("to_us"), "version", "after.category", "after.status", "deleted")


@query(SCD + "SELECT key, version, status FROM s WHERE valid_to IS NULL AND NOT deleted")
def scd2_current(spark, sf_dir):
    return history.at_instant(history.scd2(changes(spark, sf_dir))).select("key", "version", "after.status")


@query(SCD + "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_linenumber, version, status FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN s ON s.key = CAST(o_custkey AS VARCHAR) AND NOT deleted AND l_shipdate >= valid_from AND (valid_to IS NULL OR l_shipdate < valid_to)")
def scd2_point_lookup(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    asked = lines.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("shipped"), F.col("o_custkey").cast("string").alias("key"))
    found = history.point_lookup(asked, history.scd2(changes(spark, sf_dir)), "shipped", ("key",))
    return found.select("l_orderkey", "l_linenumber", "version", "after.status")


ROUNDS = f"""WITH {CHANGES}, m AS (SELECT *, CASE WHEN status = 'open' AND (lag(status) OVER w IS NULL OR lag(status) OVER w = 'resolved') THEN 1 ELSE 0 END AS starts FROM c WINDOW w AS (PARTITION BY key ORDER BY t, version)),
  n AS (SELECT *, sum(starts) OVER (PARTITION BY key ORDER BY t, version ROWS UNBOUNDED PRECEDING) AS round FROM m),
  g AS (SELECT key, round, min(CASE WHEN starts = 1 THEN t END) AS o, min(CASE WHEN status = 'resolved' THEN t END) AS r FROM n WHERE round > 0 GROUP BY 1, 2)
"""


@query(ROUNDS + """SELECT key, CAST(round AS BIGINT) AS round, epoch_us(o) AS opened_us, epoch_us(r) AS resolved_us, (epoch_us(r) - epoch_us(o)) / 1e6 AS duration_seconds, epoch_us(min(r) OVER (PARTITION BY key)) AS first_us, epoch_us(max(r) OVER (PARTITION BY key)) AS latest_us FROM g""")
def order_rounds(spark, sf_dir):
    r = history.rounds(changes(spark, sf_dir))
    return r.select("key", "round", micros("opened_at").alias("opened_us"), micros("resolved_at").alias("resolved_us"), "duration_seconds", micros("first_resolved_at").alias("first_us"), micros("latest_resolved_at").alias("latest_us"))


@query(ROUNDS + "SELECT key, count(*) AS stray FROM n WHERE round = 0 GROUP BY 1")
def stray_changes(spark, sf_dir):
    return history.stray_changes(changes(spark, sf_dir)).groupBy("key").agg(F.count(F.lit(1)).alias("stray"))


DAILY_STATE = f"""WITH {CHANGES}, cal AS (SELECT CAST(x AS DATE) AS d FROM generate_series(TIMESTAMP '1997-01-01', TIMESTAMP '1997-03-31', INTERVAL 1 DAY) AS g(x)),
  l AS (SELECT key, d, c.*, row_number() OVER (PARTITION BY key, d ORDER BY t DESC, version DESC) AS n FROM cal JOIN c ON c.day <= d) """


@query(DAILY_STATE + "SELECT key, CAST(d AS VARCHAR) AS day, epoch_us(t) AS at_us, version, op, status FROM l WHERE n = 1")
def daily_status_snapshot(spark, sf_dir):
    s = history.daily_state(changes(spark, sf_dir), date(1997, 1, 1), date(1997, 3, 31))
    return s.select("key", F.col("day").cast("string").alias("day"), micros("at").alias("at_us"), "version", "op", "after.status")


@query(DAILY_STATE + "SELECT 'synthetic' AS source, CAST(d AS VARCHAR) AS day, CASE WHEN op = 'd' THEN 'deleted' ELSE status END AS status, count(*) AS n FROM l WHERE n = 1 GROUP BY 1, 2, 3")
def daily_status_counts(spark, sf_dir):
    s = history.daily_state(changes(spark, sf_dir), date(1997, 1, 1), date(1997, 3, 31))
    return history.status_counts(s).withColumn("day", F.col("day").cast("string"))


@query(SCD + "SELECT 'synthetic' AS source, category, count(*) AS n FROM s WHERE valid_to IS NULL AND NOT deleted GROUP BY 1, 2")
def current_categories(spark, sf_dir):
    return history.current_categories(history.scd2(changes(spark, sf_dir)))


# --- joins and sets -------------------------------------------------------------------------

BY_TYPE = "SELECT p_type AS category, count(*) AS rows, CAST(sum(p_size) AS BIGINT) AS weight_sum FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"


def _by_type(spark, sf_dir, strategy):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey", "l_linenumber")
    dim = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_type", "p_size")
    return joins.join(lines, dim, ["k"], strategy).groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("rows"), F.sum("p_size").alias("weight_sum"))


@query(BY_TYPE)
def join_auto(spark, sf_dir):
    return _by_type(spark, sf_dir, "auto")


@query(BY_TYPE)
def join_merge(spark, sf_dir):
    return _by_type(spark, sf_dir, "merge")


@query(BY_TYPE)
def join_broadcast(spark, sf_dir):
    return _by_type(spark, sf_dir, "broadcast")


@query(BY_TYPE)
def join_salted(spark, sf_dir):
    return _by_type(spark, sf_dir, "salted")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 50 * c_acctbal)")
def join_semi(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return c.join(o, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > 50 * F.col("c_acctbal")), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""SELECT a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 30 MINUTE WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def join_range(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    a = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("a"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("b"))
    return a.join(b, "user_id").where(F.col("b").between(F.col("a"), F.col("a") + F.expr("INTERVAL 30 MINUTES"))).select("click_id", "purchase_id")


@query("""SELECT 'as it is' AS other, CAST(0 AS BIGINT) AS differing UNION ALL SELECT 'first lines twice', count(*) FROM lineitem WHERE l_linenumber = 1
  UNION ALL SELECT 'without returns', count(*) FROM lineitem WHERE l_returnflag = 'R'""")
def multiset_equal(spark, sf_dir):
    """lineitem against itself dealt anew, with rows twice, and without some."""
    a = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    others = {"as it is": a.repartition("l_partkey"), "first lines twice": a.union(a.where("l_linenumber = 1")), "without returns": a.where("l_returnflag <> 'R'")}
    found = [joins.differing_rows(a, b).agg(F.count(F.lit(1)).alias("differing")).select(F.lit(name).alias("other"), "differing") for name, b in others.items()]
    return found[0].union(found[1]).union(found[2])


@query("SELECT l_suppkey, count(*) AS surplus FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def multiset_difference(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem")
    return joins.differing_rows(a.select("l_suppkey"), a.where("l_returnflag <> 'R'").select("l_suppkey"))


@query("SELECT DISTINCT n_name AS name FROM nation UNION SELECT DISTINCT r_name FROM region")
def union_distinct(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return n.unionByName(read(spark, sf_dir, "region").select(F.col("r_name").alias("name"))).distinct()


@query("SELECT event_id, event_type FROM events WHERE event_id > 250 ORDER BY event_id LIMIT 500")
def page_keyset(spark, sf_dir):
    return joins.page(read(spark, sf_dir, "events"), 250, 500, "event_id").select("event_id", "event_type")


@query("SELECT count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max, true AS complete FROM events")
def quantiles(spark, sf_dir):
    return metrics.quantiles(read(spark, sf_dir, "events"), "value")


@query("""SELECT * FROM (SELECT lag(k) OVER (ORDER BY k) AS after, k AS before FROM (SELECT DISTINCT user_id * 1000 + event_id % 997 AS k FROM events)) WHERE before - after > 1""")
def sequence_gaps(spark, sf_dir):
    """Numbers of users' events, of which many are missing."""
    return metrics.gaps(read(spark, sf_dir, "events").select((F.col("user_id") * 1000 + F.col("event_id") % 997).alias("k")), "k", 1000)


@query("SELECT count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS total, CAST(sum(length(event_type)) AS BIGINT) AS chars FROM events")
def checksum(spark, sf_dir):
    return metrics.checksum(read(spark, sf_dir, "events"), "event_id", "event_type")


@query("SELECT CAST(user_id % 7 AS INTEGER) AS partition, count(*) AS rows FROM events GROUP BY 1")
def partition_histogram(spark, sf_dir):
    """events dealt over seven partitions by user."""
    return metrics.partition_histogram(read(spark, sf_dir, "events").repartitionById(7, (F.col("user_id") % 7).cast("int")))


@query("SELECT o_custkey, CAST(o_orderdate AS VARCHAR)[1:10] AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_grains(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("day"))
    return metrics.duplicate_grains(o, ["o_custkey", "day"])


@query(f"WITH {FACTS} SELECT source, app, CAST(day AS VARCHAR) AS business_date, event_type, count(*) AS n, max(seq) AS last_seq FROM f WHERE seq > 500 GROUP BY 1, 2, 3, 4")
def incremental_counts(spark, sf_dir):
    return metrics.increments(facts(spark, sf_dir), 500).withColumn("business_date", F.col("business_date").cast("string"))


# --- lake and publication -------------------------------------------------------------------


def _orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _table(spark):
    from sedgeflow.sources.shared import scratch

    return lake.Table(spark, scratch(spark))


def _merged(spark, sf_dir):
    o = _orders(spark, sf_dir)
    t = _table(spark)
    t.append(o.where("o_orderkey % 3 <> 0"))
    t.merge(o.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), ["o_orderkey"])
    t.delete(F.col("o_orderkey") % 5 == 0)
    t.compact(2)
    return t


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE (o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0) AND o_orderkey % 5 <> 0")
def lake_merge_delete_compact(spark, sf_dir):
    return _merged(spark, sf_dir).read()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0")
def lake_time_travel(spark, sf_dir):
    return _merged(spark, sf_dir).read(version=1)


@query("""WITH a AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0), m AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0),
  d AS (SELECT count(*) AS n FROM orders WHERE (o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0) AND o_orderkey % 5 <> 0)
  SELECT 1 AS version, 'append' AS operation, n AS rows FROM a UNION ALL SELECT 2, 'merge', n FROM m UNION ALL SELECT 3, 'delete', n FROM d UNION ALL SELECT 4, 'compact', n FROM d""")
def lake_history(spark, sf_dir):
    """Every version with its operation and its rows."""
    t = _merged(spark, sf_dir)
    counts = [t.read(v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("rows")) for v in range(1, 5)]
    return t.history().select("version", "operation").join(counts[0].union(counts[1]).union(counts[2]).union(counts[3]), "version")


@query(f"""WITH {FACTS}, d AS (SELECT source, app, day, count(*) FILTER (event_type = 'page_view') AS pv, count(DISTINCT anonymous_id) AS uv, count(*) FILTER (event_type = 'request_complete') AS requests, count(*) FILTER (event_type = 'request_complete' AND success) AS successes FROM f WHERE source = 'real' AND day BETWEEN DATE '2023-12-30' AND DATE '2024-01-05' GROUP BY 1, 2, 3),
  cal AS (SELECT CAST(x AS DATE) AS c FROM generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-01-05', INTERVAL 1 DAY) AS t(x))
  SELECT CAST(c AS VARCHAR) AS business_date, app, pv, uv, requests, successes FROM cal LEFT JOIN d ON day = c""")
def publication_read(spark, sf_dir):
    """A week published with its empty days, read through the pointer."""
    from sedgeflow.operators.publication import Publication
    from sedgeflow.sources.shared import scratch

    rows = metrics.daily(facts(spark, sf_dir).where("source = 'real'"), date(2023, 12, 30), date(2024, 1, 5))
    p = Publication(spark, scratch(spark), "real")
    p.publish(rows, date(2023, 12, 30), date(2024, 1, 5), CUTOFF)
    return p.read().select(F.col("business_date").cast("string").alias("business_date"), "app", "pv", "uv", "requests", "successes")


@query(f"""WITH {REPLAYED}, o AS (SELECT *, CASE WHEN event_type = 'request_complete' THEN 'request:' || request_id ELSE 'event:' || event_id END AS business_key FROM v)
  SELECT source, app, business_key, min(seq) AS seq FROM o GROUP BY 1, 2, 3""")
def keyed_upsert(spark, sf_dir):
    from sedgeflow.functions.contract import business_key
    from sedgeflow.streaming.upsert import lowest_sequence

    rows = _replayed(spark, sf_dir).withColumn("business_key", business_key(F.col("event_type"), F.col("request_id"), F.col("event_id")))
    return lowest_sequence(rows).select("source", "app", "business_key", "seq")


@query(f"""WITH {FACTS}, o AS (SELECT *, CASE WHEN event_type = 'request_complete' THEN 'request:' || request_id ELSE 'event:' || event_id END AS business_key, CASE WHEN seq % 3 = 0 THEN accepted - INTERVAL 2 DAY ELSE accepted END AS acc FROM f),
  t AS (SELECT source, app, business_key, arg_min(seq, {{'a': event_time, 'b': seq}}) AS by_time, arg_min(seq, {{'a': acc, 'b': seq}}) AS by_acceptance FROM o GROUP BY 1, 2, 3) SELECT * FROM t WHERE by_time <> by_acceptance""")
def replay_changed_winners(spark, sf_dir):
    from sedgeflow.functions.contract import business_key
    from sedgeflow.operators import replay

    rows = facts(spark, sf_dir).withColumn("business_key", business_key(F.col("event_type"), F.col("request_id"), F.col("event_id")))
    rows = rows.withColumn("accepted", F.when(F.col("seq") % 3 == 0, F.col("accepted") - F.expr("INTERVAL 2 DAYS")).otherwise(F.col("accepted")))
    return replay.changed_winners(rows)


@query("SELECT CAST(o_custkey AS VARCHAR) AS run_id, CAST(o_orderkey AS VARCHAR) AS event_id FROM orders WHERE o_orderkey % 4 <> 0")
def lineage_unacknowledged(spark, sf_dir):
    from sedgeflow.operators import lineage

    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderkey").cast("string").alias("event_id"))
    return lineage.unacknowledged(o, o.where(F.col("event_id").cast("long") % 4 == 0))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS run_id, min(CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS VARCHAR) END) AS started, max(CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS VARCHAR) END) AS ended FROM orders GROUP BY 1""")
def lineage_run_states(spark, sf_dir):
    from sedgeflow.operators import lineage

    state = F.element_at(F.create_map(*map(F.lit, ("O", "START", "F", "COMPLETE", "P", "FAIL"))), F.col("o_orderstatus"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("run_id"), F.lit("j").alias("job"), state.alias("state"), F.col("o_orderdate").cast("string").alias("at"))
    return lineage.run_states(o).select("run_id", "started", "ended")


@query(ATTRIBUTION + "SELECT CAST(0 AS BIGINT) AS faults, count(*) AS unreconciled FROM (SELECT DISTINCT source, channel, CAST(click_time + INTERVAL 8 HOUR AS DATE) FROM conv)")
def model_invariants(spark, sf_dir):
    """Retention rows that break maturity, and funnel rows whose conversions aren't the detail's; and the
    latter where each conversion is counted twice."""
    from sedgeflow.operators import releases

    f = facts(spark, sf_dir)
    parts = attribution.steps(f, JOURNEY_MINUTES)
    found = attribution.conversions(parts)
    funnel = attribution.funnel(parts, found)
    twice = releases.unreconciled(found.union(found), funnel.where("converted > 0"), ["source", "channel", "date"], "converted").agg(F.count(F.lit(1)).alias("unreconciled"))
    bad = releases.unreconciled(found, funnel.where("converted > 0"), ["source", "channel", "date"], "converted").select(F.lit(1).alias("x"))
    bad = bad.union(releases.retention_faults(retention.retention(f, CUTOFF)).select(F.lit(1))).union(attribution.broken(funnel).select(F.lit(1)))
    return bad.agg(F.count(F.lit(1)).alias("faults")).join(F.broadcast(twice))  # a row each


from sedgeflow import catalogue_io  # noqa: E402, F401  (registers its queries here)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)



