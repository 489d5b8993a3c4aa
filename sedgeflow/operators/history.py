"""Histories from a change log: versions (SCD2), rounds of a status, daily states."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgeflow.functions.time import business_date, instant, utc

KEYS = ("source", "table", "key")


def normalise(raw: DataFrame) -> DataFrame:
    """Change rows with at as a timestamp; positions that Kafka delivered twice stand once."""
    at = F.when(F.col("at").rlike(r"^\d+$"), F.timestamp_millis(F.try_to_number("at", F.lit("9999999999999999")).cast("long"))).otherwise(instant(F.col("at")))
    return raw.withColumn("at", at).dropDuplicates(["source", "kafka_topic", "kafka_partition", "kafka_offset"])


def visible(changes: DataFrame, cutoff: datetime, as_of: date) -> DataFrame:
    return changes.where((F.col("at") <= utc(cutoff)) & (business_date(F.col("at")) <= F.lit(as_of)))


def scd2(changes: DataFrame) -> DataFrame:
    """source, table, key, valid_from, valid_to, version, after, deleted. Of changes at one instant
    the greatest (version, kafka_offset) stands; the next instant closes it, a delete too."""
    latest = F.max_by(F.struct("version", "after", "op"), F.struct("version", "kafka_offset")).alias("r")
    one = changes.groupBy(*KEYS, "at").agg(latest)
    order = Window.partitionBy(*KEYS).orderBy("at")
    return one.select(*KEYS, F.col("at").alias("valid_from"), F.lead("at").over(order).alias("valid_to"), "r.version", "r.after", (F.col("r.op") == "d").alias("deleted"))


def at_instant(versions: DataFrame, at: datetime | None = None) -> DataFrame:
    """The versions that hold at an instant, or now; deleted ones aren't there."""
    if at is None:
        return versions.where("valid_to IS NULL AND NOT deleted")
    t = utc(at)
    return versions.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to"))) & ~F.col("deleted"))


def point_lookup(facts: DataFrame, versions: DataFrame, at: str, keys: tuple[str, ...] = ("source", "table", "key")) -> DataFrame:
    """facts with the version that held at their own time (after, version), null if none did."""
    v = versions.where("NOT deleted").select(*[F.col(k).alias(f"_{k}") for k in keys], "valid_from", "valid_to", "version", "after")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k) == F.col(f"_{k}")
    inside = same & (F.col(at) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return facts.join(v, inside, "left").select(*facts.columns, "version", "after")


def rounds(changes: DataFrame, opened: str = "open", closed: str = "resolved") -> DataFrame:
    """source, key, round, opened_at, resolved_at, duration_seconds, first_resolved_at,
    latest_resolved_at.

    A round starts where the status is open and the one before is none or resolved. Rows before the
    first round (the first status isn't open) are left to stray_changes()."""
    marked = _numbered(changes, opened, closed)
    made = marked.where("round > 0").groupBy("source", "key", "round").agg(F.min(F.when(F.col("starts") == 1, F.col("at"))).alias("opened_at"), F.min(F.when(F.col("status") == closed, F.col("at"))).alias("resolved_at"))
    every = Window.partitionBy("source", "key")
    seconds = (F.unix_micros("resolved_at") - F.unix_micros("opened_at")) / 1e6
    return made.select("source", "key", "round", "opened_at", "resolved_at", seconds.alias("duration_seconds"), F.min("resolved_at").over(every).alias("first_resolved_at"), F.max("resolved_at").over(every).alias("latest_resolved_at"))


def _numbered(changes: DataFrame, opened: str, closed: str) -> DataFrame:
    order = Window.partitionBy("source", "key").orderBy("at", "version", "kafka_offset")
    status = F.col("after.status")
    before = F.lag(status).over(order)
    starts = ((status == opened) & (before.isNull() | (before == closed))).cast("long")
    marked = changes.select("source", "key", "at", "version", "kafka_offset", status.alias("status"), F.coalesce(starts, F.lit(0)).alias("starts"))
    return marked.withColumn("round", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def stray_changes(changes: DataFrame, opened: str = "open", closed: str = "resolved") -> DataFrame:
    """Changes before a key's first round, for the quality report."""
    return _numbered(changes, opened, closed).where("round = 0")


def daily_state(changes: DataFrame, start: date, as_of: date, most: int = 365) -> DataFrame:
    """source, key, day, at, version, op, after: the last change of each key by the end of each day,
    from its first change's day (or start) to as_of.

    Changes are reduced to each day's last one, which holds until the day before the next: each
    row is spread over its own days, so no calendar is joined with a history."""
    if not 0 <= (as_of - start).days <= most:
        raise ValueError(f"a report has at most {most} days")
    days = changes.withColumn("day", business_date(F.col("at"))).where(F.col("day") <= F.lit(as_of))
    last = days.groupBy("source", "key", "day").agg(F.max_by(F.struct("at", "version", "op", "after"), F.struct("at", "version")).alias("r"))
    until = F.coalesce(F.date_sub(F.lead("day").over(Window.partitionBy("source", "key").orderBy("day")), 1), F.lit(as_of))
    held = last.select("source", "key", F.greatest("day", F.lit(start)).alias("lo"), until.alias("hi"), "r.*").where("lo <= hi")
    return held.select("source", "key", F.explode(F.sequence("lo", "hi")).alias("day"), "at", "version", "op", "after")


def status_counts(states: DataFrame) -> DataFrame:
    status = F.when(F.col("op") == "d", "deleted").otherwise(F.col("after.status"))
    return states.groupBy("source", "day", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def current_categories(versions: DataFrame) -> DataFrame:
    return at_instant(versions).groupBy("source", F.col("after.category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


