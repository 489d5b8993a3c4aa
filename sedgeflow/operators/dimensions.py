"""Dimensions that are known only where they were observed: present, not present or unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgeflow.operators.joins import BROADCAST_BYTES, estimated_bytes

FACT = ("fact_ordinal", "source", "app", "kind", "key", "at")
OUT = ("fact_ordinal", "source", "app", "kind", "release_id", "dimension_id", "dimension_status")


def facts_of(events: DataFrame) -> DataFrame:
    """fact_ordinal, source, app, kind, key, at: page views by path, selections by character."""
    kind = F.when(F.col("event_type") == "page_view", "page").when(F.col("event_type") == "character_select", "character")
    key = F.when(F.col("event_type") == "page_view", F.col("path")).otherwise(F.col("character_id"))
    return events.select(F.col("seq").alias("fact_ordinal"), "source", "app", kind.alias("kind"), key.alias("key"), F.col("event_time").alias("at")).where("kind IS NOT NULL AND key IS NOT NULL")


def _resolve(facts: DataFrame, ranges: DataFrame, dims: DataFrame, inside) -> DataFrame:
    """Facts with the one release that covers them, then with its dimension. Facts that no release
    covers, or several, are unknown.

    Each source and app has one array of its releases' ranges, which is broadcast if its size allows
    and in which a fact's own are looked up: no fact is shuffled, repeated or merged for it."""
    r = ranges.groupBy(F.col("source").alias("_s"), F.col("app").alias("_a")).agg(F.collect_set(F.struct(F.col("release_id").alias("id"), "lo", "hi")).alias("all"))
    met = facts.join(F.broadcast(r) if estimated_bytes(r) <= BROADCAST_BYTES else r, (F.col("source") == F.col("_s")) & (F.col("app") == F.col("_a")), "left")
    ids = F.array_distinct(F.transform(F.filter("all", inside), lambda x: x["id"]))
    one = met.withColumn("_ids", ids).select(*facts.columns, F.when(F.size("_ids") == 1, F.element_at("_ids", 1)).alias("release_id"))
    known = one.join(dims.select("source", "app", "release_id", "kind", "key", "dimension_id", "present"), ["source", "app", "release_id", "kind", "key"], "left")
    status = F.when(F.col("release_id").isNull(), "unknown").when(F.col("present"), "present").otherwise("not_present")
    return known.select("fact_ordinal", "source", "app", "kind", "release_id", F.when(F.col("present"), F.col("dimension_id")).alias("dimension_id"), status.alias("dimension_status"))


def at_event(facts: DataFrame, coverage: DataFrame, dims: DataFrame) -> DataFrame:
    """OUT for each fact by the release whose coverage (covered_from <= at < covered_to) holds it."""
    ranges = coverage.withColumnsRenamed({"covered_from": "lo", "covered_to": "hi"})
    return _resolve(facts, ranges, dims, lambda x: (F.col("at") >= x["lo"]) & (F.col("at") < x["hi"]))


def current(facts: DataFrame, observations: DataFrame, dims: DataFrame, as_of) -> DataFrame:
    """OUT for each fact by the release that was observed at as_of (observed_at <= t <= checked_through)."""
    ranges = observations.withColumnsRenamed({"observed_at": "lo", "checked_through": "hi"})
    return _resolve(facts, ranges, dims, lambda x: (F.lit(as_of) >= x["lo"]) & (F.lit(as_of) <= x["hi"]))


def coverage_faults(coverage: DataFrame, releases: DataFrame) -> DataFrame:
    """fault, source, app, release_id: overlap (with another release's range), crossing (a later
    release starts inside), same_instant (two releases with one start)."""
    order = Window.partitionBy("source", "app").orderBy("covered_from", "covered_to")
    before = coverage.withColumn("_hi", F.max("covered_to").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_r", F.lag("release_id").over(order))
    overlap = before.where("covered_from < _hi AND _r <> release_id").select(F.lit("overlap").alias("fault"), "source", "app", "release_id")
    r = releases.select(F.col("source").alias("s"), F.col("app").alias("a"), F.col("release_id").alias("r"), "release_at")
    crossing = coverage.join(r, (F.col("source") == F.col("s")) & (F.col("app") == F.col("a")) & (F.col("release_id") != F.col("r")) & (F.col("release_at") > F.col("covered_from")) & (F.col("release_at") < F.col("covered_to")), "left_semi")
    same = releases.groupBy("source", "app", "release_at").agg(F.countDistinct("release_id").alias("n"), F.min("release_id").alias("release_id")).where("n > 1")
    return overlap.unionByName(crossing.select(F.lit("crossing").alias("fault"), "source", "app", "release_id")).unionByName(same.select(F.lit("same_instant").alias("fault"), "source", "app", "release_id"))


def releases(snapshots: DataFrame, now) -> DataFrame:
    """Adds release_id to published snapshots up to now: a hash of source, app, sha and release_at."""
    good = snapshots.where((F.col("status") == "published") & (F.col("release_at") <= F.lit(now)))
    return good.withColumn("release_id", F.sha2(F.concat_ws("|", "source", "app", "sha", F.col("release_at").cast("string")), 256))


def with_tombstones(entries: DataFrame, release_order: DataFrame) -> DataFrame:
    """dims: each release's entries, and present = false for keys of earlier releases that it lacks.

    A key's rows are spread from its first release on over the later ones: releases are few and
    keys many, so the small side is grouped into one array for each (source, app)."""
    order = release_order.groupBy("source", "app").agg(F.sort_array(F.collect_list(F.struct("release_at", "release_id"))).alias("all"))
    seen = entries.join(release_order, ["source", "app", "release_id"])
    first = seen.groupBy("source", "app", "kind", "key").agg(F.min("release_at").alias("since"), F.map_from_entries(F.collect_list(F.struct("release_id", "dimension_id"))).alias("own"))
    spread = first.join(order, ["source", "app"]).withColumn("r", F.explode(F.filter("all", lambda x: x["release_at"] >= F.col("since"))))
    own = F.element_at("own", F.col("r.release_id"))
    return spread.select("source", "app", F.col("r.release_id").alias("release_id"), "kind", "key", own.alias("dimension_id"), own.isNotNull().alias("present"))


def validity(release_order: DataFrame, coverage: DataFrame) -> DataFrame:
    """Releases with valid_to: the earliest later release's start at which a coverage of this one ends."""
    ends = coverage.select("source", "app", "release_id", F.col("covered_to").alias("end"))
    starts = release_order.select(F.col("source").alias("s"), F.col("app").alias("a"), F.col("release_at").alias("start"))
    met = release_order.join(ends, ["source", "app", "release_id"], "left").join(starts, (F.col("source") == F.col("s")) & (F.col("app") == F.col("a")) & (F.col("end") == F.col("start")) & (F.col("start") > F.col("release_at")), "left")
    return met.groupBy("source", "app", "release_id", "release_at").agg(F.min("start").alias("valid_to"))
