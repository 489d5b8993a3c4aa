"""Registered queries of sources, sinks, journals, publication and streams, with their SQL.

Each writes the tables' rows in the form that its operator reads, below the shared folder, and gives what
the operator makes of them.
"""

from __future__ import annotations

import json
import uuid
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedgeflow import catalogue as c
from sedgeflow.operators import dedup, history, joins, metrics, public, retention
from sedgeflow.sources.shared import list_files, read_text, scratch

UTC = timezone.utc
MONTH_END = datetime(2024, 2, 1, tzinfo=UTC)
#: Rows of one file of compressed lines, which one task reads.
BATCH_ROWS = 50_000


def _uuid(text):
    h = F.md5(text)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _events(spark, sf_dir):
    """facts as events of the contract, of one source, with fault (0 or the number of a fault)."""
    f = c.facts(spark, sf_dir)
    kind = F.col("event_type")
    only = lambda value, *kinds: F.when(kind.isin(*kinds), value)
    return f.select(
        "seq", "event_time", (F.col("seq") % 40).alias("fault"), F.lit(1).cast("long").alias("schema_version"), _uuid(F.concat(F.lit("e"), "event_id")).alias("event_id"), "app", "event_type",
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("occurred_at"), F.date_format("accepted", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("accepted_at"),
        F.when(kind != "request_complete", _uuid(F.concat(F.lit("u"), "anonymous_id"))).alias("anonymous_id"), F.lit(None).cast("string").alias("session_id"), "path",
        only(F.concat(F.lit("c"), (F.col("seq") % 7).cast("string")), "character_select", "request_complete").alias("character_id"),
        only(_uuid(F.concat(F.lit("j"), "jump_id")), "entry_click", "entry_arrival").alias("jump_id"), only(F.col("channel"), "entry_click").alias("channel"),
        only(F.col("request_id"), "request_observed", "request_complete").alias("request_id"), only(F.col("success"), "request_complete").alias("success"),
        only(F.col("seq") % 1000, "request_complete").alias("elapsed_ms"),
    )


def _lines(events):
    """Envelopes as JSON lines, broken by their faults."""
    from sedgeflow.functions.contract import FIELDS

    fault = F.col("fault")
    changed = events.withColumns({
        "event_id": F.when(fault == 1, "no-uuid").otherwise(F.col("event_id")),
        "path": F.when((fault == 2) & F.col("path").isNotNull(), F.concat("path", F.lit("?q"))).otherwise(F.col("path")),
        "occurred_at": F.when(fault == 3, F.regexp_replace("occurred_at", "Z$", "")).otherwise(F.col("occurred_at")),
        "schema_version": F.when(fault == 5, 2).otherwise(F.col("schema_version")),
        "app": F.when(fault == 6, "other").otherwise(F.col("app")),
        "channel": F.when(fault == 10, "x y").otherwise(F.col("channel")),
    })
    event = F.to_json(F.struct(*FIELDS))
    event = F.when(fault == 4, F.regexp_replace(event, r"\}$", ',"more":1}')).otherwise(event)
    source, at = F.when(fault == 7, "real").otherwise("synthetic"), F.when(fault == 8, "never").otherwise(F.col("accepted_at"))
    line = F.format_string('{"seq":%d,"source":"%s","accepted_at":"%s","event":%s}', "seq", source, at, event)
    return changed.withColumn("line", line).select(F.when(fault == 9, F.concat(F.lit("torn "), "line")).otherwise(F.col("line")).alias("value"))


def _written(spark, lines):
    path = scratch(spark)
    lines.write.text(path)
    return path


FAULTY = "(seq % 40 BETWEEN 1 AND 10 AND (seq % 40 <> 2 OR event_type = 'page_view'))"


@c.query(f"""WITH {c.FACTS} SELECT CASE WHEN seq % 40 <> 9 THEN seq END AS seq, CASE WHEN {FAULTY} THEN 'quarantine' WHEN accepted > TIMESTAMP '2024-01-28 15:59:59' THEN 'after_cutoff' ELSE 'valid' END AS state,
  CASE WHEN {FAULTY} THEN 'invalid_contract' END AS reason FROM f""")
def envelope_states(spark, sf_dir):
    """Envelopes as JSON lines, ten kinds of them broken: unknown fields, other types, torn lines."""
    from sedgeflow.sources.envelopes import read_events

    path = _written(spark, _lines(_events(spark, sf_dir)))
    return dedup.classify(read_events(spark, path), "synthetic", c.CUTOFF).select("seq", "state", "reason")


@c.query(f"""WITH {c.FACTS}, v AS (SELECT * FROM f WHERE NOT {FAULTY} AND accepted <= TIMESTAMP '2024-01-28 15:59:59'), k AS (SELECT app, CASE WHEN event_type = 'request_complete' THEN request_id ELSE event_id END AS k, event_type = 'request_complete' AS r, min(seq) AS seq FROM v GROUP BY 1, 2, 3)
  SELECT count(*) AS raw, (SELECT count(*) FROM k) AS valid, count(*) FILTER (NOT {FAULTY} AND accepted <= TIMESTAMP '2024-01-28 15:59:59') - (SELECT count(*) FROM k) AS duplicates,
  count(*) FILTER ({FAULTY}) AS quarantined, count(*) FILTER (NOT {FAULTY} AND accepted > TIMESTAMP '2024-01-28 15:59:59') AS after_cutoff FROM f""")
def envelope_quality(spark, sf_dir):
    from sedgeflow.sources.envelopes import read_events

    seen = dedup.classify(read_events(spark, _written(spark, _lines(_events(spark, sf_dir)))), "synthetic", c.CUTOFF)
    return dedup.quality_counts(seen, dedup.deduplicate(seen.where("state = 'valid'")))


@c.query(f"""WITH {c.REPLAYED}, a AS (SELECT *, row_number() OVER (PARTITION BY source, app, event_id ORDER BY accepted, seq) AS n, count(DISTINCT channel) OVER (PARTITION BY source, app, event_id) AS contents FROM v),
  b AS (SELECT *, CASE WHEN event_type = 'request_complete' THEN 'request:' || request_id ELSE 'event:' || event_id END AS business_key FROM a WHERE n = 1 AND contents = 1),
  d AS (SELECT *, row_number() OVER (PARTITION BY source, app, business_key ORDER BY accepted, seq) AS m FROM b) SELECT seq, source, app, event_id, business_key FROM d WHERE m = 1""")
def event_dedup_quarantine(spark, sf_dir):
    """Events that came with several contents are no facts."""
    return dedup.deduplicate(c._replayed(spark, sf_dir), "quarantine").select("seq", "source", "app", "event_id", "business_key")


@c.query(f"""WITH {c.REPLAYED}, a AS (SELECT *, first(channel) OVER (PARTITION BY source, app, event_id ORDER BY accepted, seq) AS c0 FROM v) SELECT seq, 'event_id_conflict' AS reason FROM a WHERE channel <> c0""")
def event_conflicting(spark, sf_dir):
    return dedup.conflicting(c._replayed(spark, sf_dir)).select("seq", "reason")


@c.query("""WITH o AS (SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1997-03-31 15:59:59') SELECT CAST(o_custkey AS VARCHAR) AS key, epoch_us(o_orderdate) AS at_us, CASE WHEN o_orderkey % 10 = 9 THEN 'd' ELSE 'u' END AS op, o_orderkey AS kafka_offset,
  CASE WHEN o_orderkey % 10 <> 9 THEN o_orderpriority END AS category FROM o""")
def change_log(spark, sf_dir):
    """Change lines, every fourth delivered twice and every third with a time in milliseconds."""
    from sedgeflow.sources.envelopes import read_changes

    o = c.changes(spark, sf_dir)
    at = F.when(F.col("version") % 3 == 0, F.unix_millis("at").cast("string")).otherwise(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    o = o.withColumn("at", at).withColumn("times", F.when(F.col("version") % 4 == 0, 2).otherwise(1))
    path = _written(spark, o.withColumn("n", F.explode(F.sequence(F.lit(1), "times"))).drop("n", "times").select(F.to_json(F.struct("source", "table", "key", "at", "version", "op", "after", "kafka_topic", "kafka_partition", "kafka_offset")).alias("value")))
    seen = history.visible(history.normalise(read_changes(spark, path)), datetime(1997, 3, 31, 15, 59, 59, tzinfo=UTC), date(1997, 3, 31))
    return seen.select("key", F.unix_micros("at").alias("at_us"), "op", "kafka_offset", F.col("after.category").alias("category"))


@c.query(f"""WITH {c.FACTS} SELECT app, event_type, count(*) AS n, max(seq) AS last FROM f GROUP BY 1, 2""")
def snapshot_scan(spark, sf_dir):
    """Batches of envelopes of bounded length, named with their hashes by a manifest, read through it."""
    from sedgeflow.sources import envelopes

    path = scratch(spark)
    _lines(_events(spark, sf_dir).withColumn("fault", F.lit(0))).write.option("maxRecordsPerFile", BATCH_ROWS).text(path, compression="gzip")
    hashes = envelopes.digests(spark, [p for p, _ in list_files(spark, path) if p.endswith(".txt.gz")])
    batches = [{"batch_id": f"b{k:06d}", "path": at, "sha256": h, "valid": 1, "quarantined": 0} for k, (at, h) in enumerate(sorted(hashes.items()))]
    paths, _ = envelopes.resolve_snapshot(spark, envelopes.write_snapshot(spark, scratch(spark), "events", "synthetic", batches), "events", "synthetic")
    return envelopes.read_events(spark, paths).groupBy("event.app", "event.event_type").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


@c.query(f"WITH {c.FACTS} SELECT source, CAST(day AS VARCHAR) AS business_date, count(*) AS n FROM f GROUP BY 1, 2")
def registered_facts(spark, sf_dir):
    """Facts written by source and day, registered in the catalog, verified and read by its name."""
    from sedgeflow.functions.time import business_date
    from sedgeflow.sources import envelopes

    f = c.facts(spark, sf_dir).select("event_id", "app", "source", business_date(F.col("event_time")).alias("business_date"))
    path, name = envelopes.write_facts(f, scratch(spark), 0), f"facts_{uuid.uuid4().hex}"
    envelopes.register(spark, name, path, f.count())
    try:
        envelopes.verify(spark, name, path, {"event_id": "string", "app": "string", "source": "string", "business_date": "date"}, ("source", "business_date"))
        counts = spark.table(name).groupBy("source", "business_date").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each folder
    finally:
        envelopes.unregister(spark, name)
    return spark.createDataFrame([(r["source"], str(r["business_date"]), r["n"]) for r in counts], "source string, business_date string, n long")


@c.query("""WITH l AS (SELECT user_id % 3 AS p, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS off, event_id FROM events),
  t AS (SELECT p, count(*) AS n, least(count(*), CASE p WHEN 0 THEN 100 ELSE 100 END) AS take FROM l GROUP BY p)
  SELECT 't:' || p AS partition, CAST(CASE WHEN off < take THEN 1 ELSE 2 END AS INTEGER) AS batch, count(*) AS n, min(off) AS first, max(off) AS last, CAST(sum(event_id) AS BIGINT) AS total FROM l JOIN t USING (p) GROUP BY 1, 2""")
def landing_batches(spark, sf_dir):
    """A log of three partitions: 300 rows, fairly shared, are captured, landed and acknowledged, then
    the rest."""
    from sedgeflow.sources.landing import Landing

    e = c.read(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("p"), "event_id")
    number = F.row_number().over(Window.partitionBy("p").orderBy("event_id")) - 1
    log = e.select(F.concat(F.lit("t:"), F.col("p").cast("string")).alias("partition"), number.cast("long").alias("offset"), F.col("event_id").cast("string").alias("value"))
    top = scratch(spark)
    log.write.parquet(f"{top}/log")
    log = spark.read.parquet(f"{top}/log")
    bounds = {r["partition"]: (0, r["n"]) for r in log.groupBy("partition").agg(F.count(F.lit(1)).alias("n")).collect()}
    here, seen = Landing(spark, f"{top}/journal", f"{top}/ods"), []
    for most in (300, 1 << 40):
        here.capture(log, bounds, most, 1 << 40)
        here.land()
        seen.append(here.acknowledge(lambda offsets: None)["offsets"])
    first = F.lit(None).cast("long")
    for p, end in seen[0].items():
        first = F.when(F.col("partition") == p, end).otherwise(first)
    rows = here.read().withColumn("batch", F.when(F.col("offset") < first, 1).otherwise(2))
    return rows.groupBy("partition", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"), F.sum(F.col("value").cast("long")).alias("total"))


@c.query("SELECT c_custkey + 1 AS seq, c_name AS name FROM customer")
def synced_pages(spark, sf_dir):
    """Pages of 500 customers, archived before the cursor moves, and read back."""
    from sedgeflow.sources.envelopes import Sync

    rows = c.read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("seq"), F.col("c_name").alias("name"))
    here, pages = Sync(spark, scratch(spark)), []
    while here.once(lambda after, n: [r.asDict() for r in joins.page(rows, after, n).collect()], pages.append):
        pass
    return spark.read.schema("seq long, name string").json(pages)


@c.query(f"WITH {c.FACTS} SELECT app, CAST(day AS VARCHAR) AS business_date, count(*) FILTER (event_type = 'page_view') AS pv, count(DISTINCT anonymous_id) AS uv FROM f WHERE source = 'real' GROUP BY 1, 2 HAVING count(DISTINCT anonymous_id) > 12")
def serving_read(spark, sf_dir):
    """Daily rows written to a database by JDBC (the one that Spark brings along), and read with a filter
    that the database applies."""
    from sedgeflow.sources import serving

    url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = metrics.daily(c.facts(spark, sf_dir).where("source = 'real'")).select(F.col("app").alias("APP"), F.col("business_date").cast("string").alias("DAY"), F.col("pv").alias("PV"), F.col("uv").alias("UV"))
    serving.write_table(rows, url, "DAILY", driver=driver)
    back = serving.read_table(spark, url, "DAILY", driver, where="UV > 12")
    return back.select(F.col("APP").alias("app"), F.col("DAY").alias("business_date"), F.col("PV").alias("pv"), F.col("UV").alias("uv"))


@c.query(f"""WITH {c.FACTS}, h AS (SELECT seq, request_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('request/' || request_id)) AS h FROM f WHERE event_type = 'request_complete')
  SELECT request_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INTEGER % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS event_id, count(*) AS n FROM h GROUP BY 1, 2""")
def log_identities(spark, sf_dir):
    """Completion logs as events: the same request has the same id, the standard's name-based one."""
    from sedgeflow.sources.envelopes import log_events

    f = c.facts(spark, sf_dir).where("event_type = 'request_complete'")
    made = log_events(f.select("request_id", F.lit("c").alias("character_id"), "success", F.lit(1).alias("elapsed_ms"), F.col("event_time").cast("string").alias("at")))
    return made.groupBy("request_id", "event_id").agg(F.count(F.lit(1)).alias("n"))


@c.query("""SELECT 't' || (i % 100) AS key, epoch_us(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * i) AS at_us, CASE WHEN i % 17 = 16 THEN 'd' ELSE 'u' END AS op,
  CASE WHEN i % 17 <> 16 THEN ['open', 'pending', 'resolved'][(i // 100) % 3 + 1] END AS status, i AS version FROM range((SELECT count(*) FROM orders)) AS t(i)""")
def archived_changes(spark, sf_dir):
    """A made change log, as long as orders, archived in two runs by a stream and read back."""
    from sedgeflow.sources import simulate
    from sedgeflow.sources.envelopes import read_changes

    top = scratch(spark)
    log = simulate.changes(spark, c.read(spark, sf_dir, "orders").count())
    for half in (F.col("kafka_partition") == 0, F.col("kafka_partition") != 0):
        simulate.write_log(log.where(half), f"{top}/in")
        simulate.archive(spark, f"{top}/in", f"{top}/out", f"{top}/checkpoint")
    seen = history.normalise(read_changes(spark, f"{top}/out"))
    return seen.select("key", F.unix_micros("at").alias("at_us"), "op", F.col("after.status").alias("status"), "version")


# --- versioned tables -----------------------------------------------------------------------


@c.query("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS priority FROM orders""")
def lake_new_column(spark, sf_dir):
    """Rows appended before and after a column joined the schema."""
    o, t = c.read(spark, sf_dir, "orders"), c._table(spark)
    t.append(o.where("o_orderkey % 2 = 1").select("o_orderkey", "o_orderstatus"))
    t.append(o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("priority")))
    return t.read()


@c.query("""SELECT '' AS spec, count(*) AS rows FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 'o_orderstatus', count(*) FROM orders WHERE o_orderkey % 2 = 0""")
def lake_spec_counts(spark, sf_dir):
    """Rows by the partitioning under which they were written."""
    o, t = c.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), c._table(spark)
    t.append(o.where("o_orderkey % 2 = 1"))
    t.repartition_spec(["o_orderstatus"], rewrite=False)
    t.append(o.where("o_orderkey % 2 = 0"))
    return t.spec_counts().select("spec", "rows")


@c.query("""SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1""")
def lake_new_partitions(spark, sf_dir):
    """A table laid out anew by another column."""
    t = c._table(spark)
    t.append(c.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))
    t.repartition_spec(["o_orderstatus"])
    return t.read().groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"))


@c.query("SELECT 3 AS files, count(*) AS rows, CAST(1 AS BIGINT) AS versions FROM orders")
def file_inventory(spark, sf_dir):
    """Files and rows of a compacted copy, counted from the rows' own file names."""
    from sedgeflow.plans import layout

    t = c._table(spark)
    t.append(c.read(spark, sf_dir, "orders").select("o_orderkey").repartition(12))
    t.compact(3)
    listed = t.files().agg(F.countDistinct("folder").alias("versions"))
    return layout.files_of(t.read()).agg(F.count(F.lit(1)).cast("int").alias("files"), F.sum("rows").alias("rows")).join(F.broadcast(listed))  # a row each


@c.query("SELECT n_nationkey, n_name FROM nation")
def bounded_readback(spark, sf_dir):
    """A small table through the driver, which refuses more rows than were foreseen."""
    rows = joins.bounded_rows(c.read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 100)
    return spark.createDataFrame(rows, c.read(spark, sf_dir, "nation").select("n_nationkey", "n_name").schema)


# --- windows, expiry, publication -----------------------------------------------------------


@c.query("""SELECT event_id, ts BETWEEN TIMESTAMP '2024-01-15' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-15' + INTERVAL 5 MINUTE AS accepted,
  ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-15' AND ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-15' AS retained,
  event_type <> 'view' OR CAST(regexp_extract(props, ':\\s*(\\d+)', 1) AS INTEGER) < 50 AS allowed FROM events""")
def acceptance(spark, sf_dir):
    """The collector's window, the window of real events, and an allowlist of paths."""
    from sedgeflow.functions import contract

    now, at = F.lit(datetime(2024, 1, 15, tzinfo=UTC)), F.col("event_time")
    f = c.facts(spark, sf_dir).withColumn("character_id", F.lit(None).cast("string"))
    real = contract.retained(at, F.lit(datetime(2024, 1, 10, tzinfo=UTC)), F.lit(datetime(2024, 1, 17, tzinfo=UTC)), now)
    return f.select((F.col("seq") - 1).alias("event_id"), contract.accepted_now(at, now).alias("accepted"), real.alias("retained"), contract.allowed_values([f"/{n}" for n in range(50)]).alias("allowed"))


@c.query(f"""WITH {c.FACTS} SELECT count(*) AS rows, epoch_us(min(accepted)) AS oldest_us, epoch_us(min(accepted) + INTERVAL 30 DAY) AS expires_us FROM f""")
def state_manifest(spark, sf_dir):
    m = dedup.state_manifest(c.facts(spark, sf_dir))
    return m.select("rows", F.unix_micros("oldest").alias("oldest_us"), F.unix_micros("expires_at").alias("expires_us"))


@c.query("""SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n, CASE WHEN TIMESTAMP '2024-01-31' - max(ts) > INTERVAL 26 HOUR THEN 'stale' ELSE 'fresh' END AS freshness FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1""")
def expiry(spark, sf_dir):
    """Rows of the last seven days, and whether a public value that ends with a day would be stale."""
    now = datetime(2024, 1, 31, tzinfo=UTC)
    kept = public.expire(c.facts(spark, sf_dir), "event_time", now, 7).groupBy(F.to_date("event_time").cast("string").alias("day"))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.max("event_time").alias("last")).select("day", "n", public.stale(F.col("last"), F.lit(now), public=True).alias("freshness"))


CALENDAR = c.PUBLIC[: c.PUBLIC.index("  SELECT app, CAST(day AS VARCHAR) AS date")] + """,
  cal AS (SELECT CAST(x AS DATE) AS d, a FROM generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '2024-01-28', INTERVAL 1 DAY) AS t(x), (VALUES ('site'), ('game')) AS v(a)),
  cat AS (SELECT app, day, string_agg(kind || ' ' || name || ' ' || n, ',' ORDER BY kind, name) AS popular FROM (SELECT app, day, CASE WHEN event_type = 'page_view' THEN 'page' ELSE 'character' END AS kind,
    CASE WHEN event_type = 'page_view' THEN path ELSE character_id END AS name, count(*) AS n FROM k WHERE event_type IN ('page_view', 'character_select') GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
  w AS (SELECT *, CASE WHEN CAST(d AS TIMESTAMP) + INTERVAL 3 DAY + INTERVAL 15 MINUTE - INTERVAL 8 HOUR > TIMESTAMP '2024-01-27 16:15:00' THEN 'pending' ELSE 'empty' END AS gone FROM cal)
  SELECT a AS app, CAST(d AS VARCHAR) AS date, coalesce(access, gone) AS access, coalesce(quality, gone) AS quality, coalesce(popularity, gone) AS popularity, CASE WHEN access = 'published' THEN pv END AS pv,
    CASE WHEN access = 'published' THEN uv END AS uv, CASE WHEN quality = 'published' THEN requests END AS requests, round(CASE WHEN quality = 'published' THEN successes / requests END, 9) AS success_rate,
    CASE WHEN popularity = 'published' THEN popular END AS popular FROM w LEFT JOIN p ON p.app = a AND p.day = d LEFT JOIN cat ON cat.app = a AND cat.day = d"""


@c.query(CALENDAR)
def public_calendar(spark, sf_dir):
    """Every app and day, empty and pending ones too, with categories where they may be shown."""
    made = public.calendar(c.facts(spark, sf_dir), c.CUTOFF, date(2023, 12, 20))
    popular = F.array_join(F.transform("popular", lambda x: F.concat_ws(" ", x["kind"], x["name"], x["n"].cast("string"))), ",")
    return made.select("app", F.col("date").cast("string").alias("date"), "access", "quality", "popularity", "pv", "uv", "requests", F.round("success_rate", 9).alias("success_rate"), popular.alias("popular"))


@c.query(f"""WITH {c.FACTS}, d AS (SELECT source, app, day, count(*) FILTER (event_type = 'page_view') AS pv, count(DISTINCT anonymous_id) AS uv, count(*) FILTER (event_type = 'request_complete') AS requests, count(*) FILTER (event_type = 'request_complete' AND success) AS successes FROM f WHERE source = 'real' AND day BETWEEN DATE '2023-12-30' AND DATE '2024-01-05' GROUP BY 1, 2, 3),
  l AS (SELECT day, '{{"app":"' || app || '","business_date":"' || day || '","pv":' || pv || ',"requests":' || requests || ',"source":"' || source || '","successes":' || successes || ',"uv":' || uv || '}}' AS line FROM d),
  h AS (SELECT day, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS hash FROM l GROUP BY 1), cal AS (SELECT CAST(x AS DATE) AS c FROM generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-01-05', INTERVAL 1 DAY) AS t(x))
  SELECT CAST(c AS VARCHAR) AS business_date, coalesce(n, 0) AS n, coalesce(hash, sha256('')) AS hash, CAST(1706457599000000 AS BIGINT) AS version FROM cal LEFT JOIN h ON day = c""")
def publication_hashes(spark, sf_dir):
    """The pointers of a published week: each day's hash and version; another content at the same
    cutoff, and an older cutoff, are refused."""
    from sedgeflow.operators.publication import Publication, day_hashes

    start, end = date(2023, 12, 30), date(2024, 1, 5)
    rows = metrics.daily(c.facts(spark, sf_dir).where("source = 'real'"), start, end)
    p = Publication(spark, scratch(spark), "real")
    p.publish(rows, start, end, c.CUTOFF)
    for other, cutoff in ((rows.withColumn("pv", F.col("pv") + 1), c.CUTOFF), (rows, c.CUTOFF - timedelta(days=1))):
        try:
            p.publish(other, start, end, cutoff)
        except ValueError:
            continue
        raise AssertionError("a publication that must be refused was not")
    pointers = spark.createDataFrame([(d, x["hash"], x["version"]) for d, x in p.pointers().items()], "business_date string, hash string, version long")
    counts = day_hashes(rows, start, end).select(F.col("business_date").cast("string").alias("business_date"), "n")
    return pointers.join(counts, "business_date")


@c.query(c.ATTRIBUTION + """, g AS (SELECT source, channel, day, count(*) AS clicks FROM clicks GROUP BY 1, 2, 3),
  a AS (SELECT DISTINCT source, app, anonymous_id, day FROM f WHERE event_time <= TIMESTAMP '2024-01-28 15:59:59' AND day <= DATE '2024-01-27'), k AS (SELECT source, app, anonymous_id, min(day) AS cohort FROM a GROUP BY 1, 2, 3)
  SELECT 'funnel' AS name, count(*) AS n FROM g UNION ALL SELECT 'retention', count(*) FROM (SELECT DISTINCT source, app, cohort FROM k)""")
def paired_release(spark, sf_dir):
    """Both packages published at once, read back through the pointer: rows of each table."""
    from sedgeflow.operators import attribution, releases

    f = c.facts(spark, sf_dir)
    parts = attribution.steps(f, c.JOURNEY_MINUTES)
    funnel, kept = attribution.funnel(parts, attribution.conversions(parts)), retention.retention(f, c.CUTOFF)
    path, window = scratch(spark), ("2024-01-01", "2024-01-28")
    name = releases.release(spark, path, releases.package({"funnel": funnel}, "in", window), releases.package({"retention": kept}, "in", window), funnel, kept)
    latest = json.loads(read_text(spark, f"{path}/latest.json"))["release"]
    body = json.loads(read_text(spark, f"{path}/{latest}.json"))
    assert latest == name
    return spark.createDataFrame([(n, len(lines)) for part in body.values() for n, lines in part["tables"].items()], "name string, n long")


@c.query(c.SQL["retention_d1_d7"].replace("SELECT source, app, CAST(cohort_date", "SELECT source, app, cohort_date, CASE WHEN eligible_d1 > 0 THEN CAST(round(retained_d1 / eligible_d1, 6) AS VARCHAR) ELSE 'immature' END AS d1, CASE WHEN eligible_d7 > 0 THEN CAST(round(retained_d7 / eligible_d7, 6) AS VARCHAR) ELSE 'immature' END AS d7 FROM (SELECT source, app, CAST(cohort_date") + ")")
def retention_rates(spark, sf_dir):
    r = retention.retention(c.facts(spark, sf_dir), c.CUTOFF)
    return r.select("source", "app", F.col("cohort_date").cast("string").alias("cohort_date"), retention.rate("retained_d1", "eligible_d1").alias("d1"), retention.rate("retained_d7", "eligible_d7").alias("d7"))


@c.query("""WITH r AS (SELECT * FROM (VALUES ('r1', 3, 12), ('r2', 10, 17), ('r3', 17, 25), ('r4', 17, 26)) AS t(id, a, b))
  SELECT 'overlap' AS fault, y.id AS release_id FROM r x JOIN r y ON x.id < y.id AND y.a < x.b AND (x.a, x.b) < (y.a, y.b) UNION ALL
  SELECT DISTINCT 'crossing', x.id FROM r x JOIN r y ON x.id <> y.id AND y.a > x.a AND y.a < x.b UNION ALL SELECT 'same_instant', min(id) FROM r GROUP BY a HAVING count(*) > 1""")
def dim_faults(spark, sf_dir):
    """Coverage that overlaps, crosses a later release, and two releases of one instant."""
    from sedgeflow.operators import dimensions

    at = lambda d: datetime(2024, 1, d, tzinfo=UTC)
    made = [("real", "site", r, at(a), at(b)) for r, a, b in (("r1", 3, 12), ("r2", 10, 17), ("r3", 17, 25), ("r4", 17, 26))]
    cov = spark.createDataFrame(made, "source string, app string, release_id string, covered_from timestamp, covered_to timestamp")
    return dimensions.coverage_faults(cov, cov.select("source", "app", "release_id", F.col("covered_from").alias("release_at"))).select("fault", "release_id")


@c.query("SELECT * FROM (VALUES ('r1', 1704844800000000), ('r2', NULL), ('r3', NULL)) AS t(release_id, valid_to_us)")
def dim_validity(spark, sf_dir):
    """r1's coverage ends as r2 starts; r2's ends a day before r3 does."""
    from sedgeflow.operators import dimensions

    rel, order, _ = c._dims(spark)
    return dimensions.validity(order, rel).select("release_id", F.unix_micros("valid_to").alias("valid_to_us"))


@c.query("SELECT 'site' AS app, 'page' AS kind, '/' || CAST(p_size AS VARCHAR) AS key FROM part GROUP BY p_size UNION ALL SELECT 'game', 'page', '/play' UNION ALL SELECT DISTINCT 'game', 'character', 'c' || CAST(n_regionkey AS VARCHAR) FROM nation")
def catalogue_entries(spark, sf_dir):
    """A published catalogue of pages and characters, checked against its own hashes."""
    from sedgeflow.operators import catalogues

    pages = [f"/{r[0]}" for r in c.read(spark, sf_dir, "part").select("p_size").distinct().collect()]  # fifty sizes
    characters = [f"c{r[0]}" for r in c.read(spark, sf_dir, "nation").select("n_regionkey").distinct().collect()]
    base = {"release_sha": "0" * 40, "release_at": "2024-01-01T00:00:00+00:00", "origin": "https://x.example"}
    made = catalogues.snapshot("published", {"site": base | {"paths": pages, "characters": []}, "game": base | {"paths": ["/play"], "characters": characters}}, MONTH_END)
    catalogues.check(made)
    return catalogues.entries(spark, made)


# --- streams --------------------------------------------------------------------------------

LATER = f"""{c.FACTS}, m AS (SELECT max(epoch_ms(event_time)) - 30000 AS mark FROM f WHERE seq % 40 NOT IN (3, 9)),
  good AS (SELECT * FROM f WHERE NOT {FAULTY}),
  one AS (SELECT seq, CASE WHEN {FAULTY} THEN 'quarantine' WHEN event_type = 'request_complete' AND seq > min(CASE WHEN NOT {FAULTY} THEN seq END) OVER (PARTITION BY app, event_type, CASE WHEN event_type = 'request_complete' THEN request_id ELSE event_id END) THEN 'duplicate' ELSE 'fact' END AS class FROM f),
  two AS (SELECT seq + 10000000 AS seq, CASE WHEN seq % 10 = 0 THEN 'quarantine' ELSE 'duplicate' END AS class, CASE WHEN seq % 10 = 0 THEN 'event_id_conflict' ELSE 'event_duplicate' END AS reason FROM good WHERE seq % 5 = 0),
  three AS (SELECT seq + 20000000 AS seq, CASE WHEN epoch_ms(event_time) < mark - 1 - 600000 THEN 'late' ELSE 'fact' END AS class, CASE WHEN epoch_ms(event_time) < mark - 1 - 600000 THEN 'late' END AS reason FROM good, m WHERE event_type = 'page_view')"""


@c.query(f"""WITH {LATER} SELECT CASE WHEN seq % 40 <> 9 THEN seq END AS seq, class, CASE class WHEN 'quarantine' THEN 'invalid_contract' WHEN 'duplicate' THEN 'request_duplicate' END AS reason FROM one
  UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three""")
def stream_classes(spark, sf_dir):
    """A stream of all events, then one of repeats, conflicts and page views that weren't seen before:
    facts, duplicates, late and quarantined rows, each with its reason."""
    from sedgeflow.plans.session import STREAM_SETTINGS
    from sedgeflow.sources.envelopes import stream_events
    from sedgeflow.streaming import dedup as streams

    e, top = _events(spark, sf_dir), scratch(spark)
    good = e.where(~(F.col("fault").between(1, 10) & ((F.col("fault") != 2) | (F.col("event_type") == "page_view")))).withColumn("fault", F.lit(0))
    again = good.where("seq % 5 = 0").withColumn("anonymous_id", F.when(F.col("seq") % 10 == 0, _uuid(F.lit("other"))).otherwise(F.col("anonymous_id")))
    again = again.withColumn("elapsed_ms", F.when((F.col("seq") % 10 == 0) & (F.col("event_type") == "request_complete"), F.lit(5000)).otherwise(F.col("elapsed_ms")))
    again = again.withColumn("anonymous_id", F.when(F.col("event_type") != "request_complete", F.col("anonymous_id"))).withColumn("seq", F.col("seq") + 10_000_000)
    new = good.where("event_type = 'page_view'").withColumn("event_id", _uuid(F.concat(F.lit("new"), "event_id"))).withColumn("seq", F.col("seq") + 20_000_000)
    before = {k: spark.conf.get(k, None) for k in STREAM_SETTINGS}
    for k, v in STREAM_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        for lines in (_lines(e), _lines(again.unionByName(new))):
            lines.write.mode("append").option("maxRecordsPerFile", BATCH_ROWS).text(f"{top}/in", compression="gzip")
            streams.run(stream_events(spark, f"{top}/in"), "synthetic", f"{top}/out").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(f"{top}/out/rows").select("seq", "class", "reason")


@c.query(f"""WITH {c.REPLAYED}, o AS (SELECT *, CASE WHEN event_type = 'request_complete' THEN 'request:' || request_id ELSE 'event:' || event_id END AS business_key FROM v),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, app, business_key ORDER BY seq) AS n FROM o) WHERE n = 1),
  d AS (SELECT source, app, day, count(*) FILTER (event_type = 'page_view') AS pv, count(DISTINCT anonymous_id) AS uv, count(*) FILTER (event_type = 'request_complete') AS requests, count(*) FILTER (event_type = 'request_complete' AND success) AS successes FROM k GROUP BY 1, 2, 3)
  SELECT source, app, CAST(day AS VARCHAR) AS business_date, CASE WHEN day < DATE '2024-01-10' THEN pv + 1000 ELSE pv END AS pv, uv, requests, successes, CASE WHEN day < DATE '2024-01-10' THEN 2 ELSE 1 END AS business_version FROM d""")
def realtime_daily(spark, sf_dir):
    """A stream of rows into a keyed table, the daily view over it, and corrections of some days."""
    from sedgeflow.functions.contract import business_key
    from sedgeflow.streaming import upsert

    top, t = scratch(spark), c._table(spark)
    rows = c._replayed(spark, sf_dir).withColumn("business_key", business_key(F.col("event_type"), F.col("request_id"), F.col("event_id")))
    rows.repartition(2).write.parquet(f"{top}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    stream.writeStream.foreachBatch(upsert.sink(t)).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    daily = metrics.daily(t.read()).withColumn("business_date", F.col("business_date").cast("string")).withColumn("business_version", F.lit(1))
    fixed = daily.where("business_date < '2024-01-10'").withColumns({"pv": F.col("pv") + 1000, "business_version": F.lit(2)})
    return upsert.overlay(daily, fixed)


@c.query(c._session_sql("1440 MINUTES").replace("WHERE event_time <= TIMESTAMP '2024-01-28 15:59:59' ", "") + "SELECT source, app, anonymous_id, start_us, end_us, events FROM x")
def stream_sessions(spark, sf_dir):
    """Sessions by a streaming session window, all of a stream's."""
    from sedgeflow.streaming import dedup as streams

    top = scratch(spark)
    rows = c.facts(spark, sf_dir).select("source", "app", "anonymous_id", "event_time", "event_id")
    rows.write.parquet(f"{top}/in")
    made = streams.sessions(spark.readStream.schema(rows.schema).parquet(f"{top}/in"), 1440)
    flat = made.select("source", "app", "anonymous_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{top}/out")

    flat.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{top}/out")


@c.query("SELECT CAST(n_regionkey AS INTEGER) AS job, count(*) AS n, min(n_name) AS first FROM nation GROUP BY 1")
def lineage_files(spark, sf_dir):
    """A journal of small files, each event written twice and told once."""
    from sedgeflow.operators import lineage

    path = scratch(spark)
    for _ in range(2):
        for r in c.read(spark, sf_dir, "nation").collect():  # 25 rows
            lineage.record(spark, path, f"r{r['n_nationkey']}", str(r["n_regionkey"]), "START", r["n_name"])
    events, _ = lineage.journal(spark, path)
    return events.groupBy(F.col("job").cast("int").alias("job")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
