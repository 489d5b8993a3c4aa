"""WARC: what a not-modified revisit stood for. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeflow.llm.common import lower_ascii, partitions, pick, shared_dir, stage

# Header fields that a 304 response may renew (RFC 9110, section 15.4.5; RFC 9111, section 3.2).
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't tell pages apart.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"
#: Most rows, about, of captures that one task orders.
SPAN = 1_000_000
#: The time of captures without one: before any other.
NO_TIME = -(1 << 62)

RECORD = "record_id long, type string, url string, at long, status int, headers map<string,string>, payload string"


def canonical_url(url: Column) -> Column:
    """Without scheme, www., default port, fragment, tracking parameters and final slash; the host in
    lower case. Null stays null."""
    rest = F.regexp_replace(url, r"(?s)\A[A-Za-z][A-Za-z0-9+.-]*://|#.*\z", "")
    host = F.regexp_replace(lower_ascii(F.regexp_extract(rest, r"\A([^/?]*)", 1)), r"\Awww\.|:(80|443)\z", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"\A[^/?]*([^?]*)", 1), r"/+\z", "")
    query = F.regexp_extract(rest, r"(?s)\?(.*)\z", 1)
    query = F.regexp_replace(query, rf"(?<![^&]){TRACKING}=[^&]*(&|\z)", "")
    query = F.regexp_replace(query, r"&\z", "")
    return F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def _lower_keys(headers: Column) -> Column:
    """Field names in lower case; of names that differ in case only, the last."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(lower_ascii(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))
    return F.coalesce(last, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def resolve_revisits(records: DataFrame, span: int = SPAN) -> DataFrame:
    """One row for each record: record_id, url, canonical, at, type, status, source_id, outcome,
    headers, payload.

    records has the columns of RECORD: type is response or revisit, at is in seconds. A revisit
    (status 304) takes the latest earlier full response (type response, status 200) of its canonical
    url, of equal times that of the greatest record_id. outcome is

    - full: no revisit; headers and payload are its own;
    - other: a revisit with another status than 304 (null is taken for it); all is its own;
    - resolved: the validators agree: etags that both have are equal after a weak mark, else
      Last-Modified fields that both have are equal, else neither sent one to compare. payload is
      the response's, headers are the response's with the RENEWED fields of the revisit;
    - changed: the validators differ; no payload, its own headers;
    - orphan: no earlier full response; no payload, its own headers.

    The as-of join needs no task with all captures of a url: captures are cut into pieces of about
    as many rows, at most `span`, by url, time and id, whatever their times are. Each piece is ordered
    by itself and takes over, where it has no earlier response of its own, the last one of the pieces
    before it. A time can go on over pieces, so each piece hands on two responses: its last, and its
    last before its greatest time. Only record ids are moved so. Responses that no revisit asks for
    are left out before any payload is shuffled; both sides of that join are written tables, so
    that a response which a third of all revisits ask for is split over tasks.

    A null time is earlier than any other; records without url, id or type are kept as they are
    (outcome full, or orphan for a revisit). Of responses that repeat an id, the joined one is that
    with the least url, payload. Repeated rows give a row each; empty tables give empty ones; other
    columns are ignored, whatever their names.
    """
    spark = records.sparkSession
    kinds = dict(x.strip().split(" ", 1) for x in RECORD.replace("map<string,string>", "map").split(","))
    kinds["headers"] = "map<string,string>"
    held = pick(records, **kinds).withColumn("headers", _lower_keys(F.col("headers"))).withColumn("canonical", canonical_url(F.col("url")))
    full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull() & F.col("canonical").isNotNull()
    held = held.withColumn("full", F.coalesce(full, F.lit(False))).withColumn("revisit", F.coalesce((F.col("type") == "revisit") & F.coalesce(F.col("status") == 304, F.lit(True)), F.lit(False)))
    folder = shared_dir(spark)
    revisits = stage(held.where("revisit").drop("payload", "full").withColumn("_n", F.monotonically_increasing_id()), f"{folder}/revisits")

    time = F.coalesce("at", F.lit(NO_TIME)).alias("at")
    sources = held.where("full").select(F.lit(None).cast("long").alias("_n"), "canonical", time, "record_id")
    narrow = sources.unionByName(revisits.where("canonical IS NOT NULL").select("_n", "canonical", time, F.lit(None).cast("long").alias("record_id")))
    narrow = stage(narrow, f"{folder}/times")
    pieces = max(partitions(spark), -(-narrow.count() // span))
    ranged = narrow.repartitionByRange(pieces, "canonical", "at", "record_id", "_n").withColumn("piece", F.spark_partition_id())
    ranged = stage(ranged, f"{folder}/pieces")
    is_full = F.col("_n").isNull()
    mine = F.when(is_full, F.struct("at", "record_id"))
    own = ("canonical", "piece")
    group = Window.partitionBy(*own).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = ranged.withColumn("near", F.max(mine).over(group))
    # A piece's last response, and its last before its greatest time.
    ends = ranged.groupBy(*own).agg(F.min("at").alias("start"), F.max("at").alias("end"), F.max(mine).alias("last"))
    ends = stage(ends, f"{folder}/ends")
    below = near.join(ends.select(*own, "end"), list(own)).where("at = end").groupBy(*own).agg(F.max("near").alias("below"))
    handed = ends.join(below, list(own), "left").select("canonical", "piece", "start", F.explode(F.array("last", "below", F.lit(None))).alias("x"))
    handed = handed.select("canonical", "x", F.when(F.col("x").isNull(), F.col("piece")).alias("piece"), F.coalesce("x.at", "start").alias("at"))
    before = Window.partitionBy("canonical").orderBy("at")
    strict = F.max("x").over(before.rangeBetween(Window.unboundedPreceding, -1))
    loose = F.max("x").over(before.rangeBetween(Window.unboundedPreceding, 0))
    carried = handed.select("canonical", "piece", strict.alias("strict"), loose.alias("loose")).where("piece IS NOT NULL").distinct()
    carried = carried.join(ends.select(*own, "start"), list(own))
    taken = F.greatest("near", F.when(F.col("at") == F.col("start"), F.col("strict")).otherwise(F.col("loose")))
    asof = near.where(~is_full).join(carried, list(own)).select("_n", taken["record_id"].alias("source_id"))
    asked = stage(revisits.join(asof, "_n", "left"), f"{folder}/asked")

    # Payloads are shuffled by the id that joins them; other records aren't shuffled at all.
    wanted = stage(asked.where("source_id IS NOT NULL").select(F.col("source_id").alias("record_id")).distinct(), f"{folder}/wanted")
    response = held.where("full").select("record_id", "url", "payload", "headers").join(wanted, "record_id", "left_semi")
    if not sources.groupBy("record_id").count().where("count > 1").isEmpty():
        least = F.min(F.struct("url", "payload", F.map_entries("headers").alias("headers"))).alias("s")
        response = response.groupBy("record_id").agg(least).select("record_id", "s.payload", F.map_from_entries("s.headers").alias("headers"))
    response = stage(response.select(F.col("record_id").alias("source_id"), F.col("payload").alias("_payload"), F.col("headers").alias("_headers")), f"{folder}/responses", "zstd")
    met = asked.join(response, "source_id", "left")
    tag = lambda h: F.regexp_replace(F.element_at(h, F.lit("etag")), r"\AW/", "")
    day = lambda h: F.element_at(h, F.lit("last-modified"))
    own, its = F.col("headers"), F.col("_headers")
    agree = F.coalesce(tag(own) == tag(its), day(own) == day(its), F.lit(True))
    outcome = F.when(F.col("source_id").isNull(), "orphan").when(agree, "resolved").otherwise("changed")
    renewed = F.map_filter(own, lambda k, v: k.isin(*RENEWED))
    merged = F.map_concat(F.map_filter(its, lambda k, v: ~F.map_contains_key(renewed, k)), renewed)
    ok = F.col("outcome") == "resolved"
    same = ("record_id", "url", "canonical", "at", "type", "status")
    resolved = met.withColumn("outcome", outcome).select(*same, F.when(ok, F.col("source_id")).alias("source_id"), "outcome", F.when(ok, merged).otherwise(own).alias("headers"), F.when(ok, F.col("_payload")).alias("payload"))
    others = held.where(~F.col("revisit")).select(*same, F.lit(None).cast("long").alias("source_id"), F.when(F.col("type") == "revisit", "other").otherwise("full").alias("outcome"), "headers", "payload")
    return others.unionByName(resolved)


def captures(pages: DataFrame) -> DataFrame:
    """A crawl log of RECORD made from pages (page_id, url, html), as their table has no revisits: an
    hour for each page in order of id, and of each page two captures. The first is a response, which
    failed (503) if the id leaves 3 by 11, the second a revisit half a year later, which sends another
    etag if the id leaves 5 by 7. Ids that leave 2 by 5 have no etag but a date. Pages without an id
    have captures without id and time."""
    p = pick(pages, page_id="long", url="string", html="string").withColumn("i", F.coalesce("page_id", F.lit(0)))
    first = F.col("k") == 0
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.when(~first & (F.col("i") % 7 == 5), F.lit("-new")).otherwise(F.lit("")), F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("i") % 365).cast("string"))
    validator = F.when(F.col("i") % 5 == 2, F.create_map(F.lit("Last-Modified"), day)).otherwise(F.create_map(F.lit("ETag"), F.when(first, etag).otherwise(F.concat(F.lit("W/"), etag))))
    more = F.when(first, F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), F.lit("then"))).otherwise(F.create_map(F.lit("Content-Type"), F.lit("none"), F.lit("Date"), F.lit("now")))
    return p.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (F.col("page_id") * 2 + F.col("k")).alias("record_id"),
        F.when(first, "response").otherwise("revisit").alias("type"),
        "url",
        (F.col("page_id") * 3600 + F.col("k") * 182 * 86400).alias("at"),
        F.when(first & (F.col("i") % 11 == 3), 503).when(first, 200).otherwise(304).alias("status"),
        F.map_concat(validator, more).alias("headers"),
        F.when(first, F.col("html")).alias("payload"),
    )


def digest(resolved: DataFrame) -> DataFrame:
    """The registered query's columns: the headers as sorted lines, the payload by its hash."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return resolved.select("record_id", "canonical", "at", "status", "source_id", "outcome", lines.alias("headers"), F.sha2(F.col("payload"), 256).alias("payload_sha256"))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(page_id, 0) AS n, url, html, k FROM pages, (VALUES (0), (1)) AS x(k)),
rec AS (
  SELECT page_id * 2 + k AS record_id, k = 1 AS revisit, url, page_id * 3600 + k * 182 * 86400 AS "at", CASE WHEN k = 0 AND n % 11 = 3 THEN 503 WHEN k = 0 THEN 200 ELSE 304 END AS status,
         CASE WHEN n % 5 <> 2 THEN (CASE WHEN k = 1 THEN 'W/' ELSE '' END) || '"' || md5(coalesce(html, '')) || (CASE WHEN k = 1 AND n % 7 = 5 THEN '-new' ELSE '' END) || '"' END AS etag,
         CASE WHEN n % 5 = 2 THEN 'day ' || CAST(n % 365 AS VARCHAR) END AS modified, CASE WHEN k = 0 THEN html END AS payload,
         regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS r0 FROM p),
cut AS (SELECT *, regexp_replace(r0, '(?s)#.*$', '') AS rest FROM rec),
parts AS (
  SELECT *, regexp_replace(regexp_replace(translate(regexp_extract(rest, '^([^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_filter(string_split(regexp_extract(rest, '(?s)\?(.*)$', 1), '&'), lambda x: NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)=')) AS q FROM cut),
can AS (SELECT *, host || path || CASE WHEN array_to_string(q, '&') = '' THEN '' ELSE '?' || array_to_string(q, '&') END AS canonical FROM parts),
met AS (
  SELECT r.*, (SELECT max({'t': s."at", 'id': s.record_id}) FROM can s WHERE NOT s.revisit AND s.status = 200 AND s.record_id IS NOT NULL AND s.canonical = r.canonical AND s."at" < r."at") AS hit
  FROM can r WHERE r.revisit),
judged AS (
  SELECT m.*, s.record_id AS sid, s.payload AS spayload, s.etag AS setag, s.modified AS smodified,
         CASE WHEN s.record_id IS NULL THEN 'orphan'
              WHEN coalesce(regexp_replace(m.etag, '^W/', '') = regexp_replace(s.etag, '^W/', ''), m.modified = s.modified, true) THEN 'resolved' ELSE 'changed' END AS outcome
  FROM met m LEFT JOIN can s ON s.record_id = m.hit.id)
SELECT record_id, canonical, "at", status, CASE WHEN outcome = 'resolved' THEN sid END AS source_id, outcome,
       'content-type: ' || (CASE WHEN outcome = 'resolved' THEN 'text/html' ELSE 'none' END) || chr(10) || 'date: now'
       || coalesce(chr(10) || 'etag: ' || (CASE WHEN outcome = 'resolved' THEN coalesce(etag, setag) ELSE etag END), '')
       || coalesce(chr(10) || 'last-modified: ' || (CASE WHEN outcome = 'resolved' THEN coalesce(modified, smodified) ELSE modified END), '') AS headers,
       CASE WHEN outcome = 'resolved' THEN sha256(spayload) END AS payload_sha256
FROM judged
UNION ALL
SELECT record_id, canonical, "at", status, NULL, 'full', 'content-type: text/html' || chr(10) || 'date: then' || coalesce(chr(10) || 'etag: ' || etag, '') || coalesce(chr(10) || 'last-modified: ' || modified, ''), sha256(payload)
FROM can WHERE NOT revisit
"""
