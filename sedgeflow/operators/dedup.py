"""Validation, quarantine, cutoff and two levels of first-accept deduplication."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeflow.functions.contract import APPS, FIELDS, business_key, fingerprint, known_fields, valid_envelope
from sedgeflow.functions.time import instant, utc


def flatten(raw: DataFrame) -> DataFrame:
    """Envelope rows with the event's fields as columns and event_time, accepted (timestamps)."""
    more = [c for c in raw.columns if c in ("_corrupt_record", "event_json")]
    flat = raw.select("seq", "source", "accepted_at", *more, "event.*")
    return flat.withColumn("event_time", instant(F.col("occurred_at"))).withColumn("accepted", instant(F.col("accepted_at")))


def classify(raw: DataFrame, source: str, cutoff: datetime, apps: tuple[str, str] = APPS) -> DataFrame:
    """Adds state: quarantine (with reason), after_cutoff or valid. accepted_at = cutoff is valid.
    Where the event's own JSON is kept (event_json), fields that the contract doesn't name break it."""
    flat = flatten(raw)
    ok = valid_envelope(source, "_corrupt_record" if "_corrupt_record" in flat.columns else None, apps)
    if "event_json" in flat.columns:
        ok = F.coalesce(ok & known_fields(F.col("event_json")), F.lit(False))
    state = F.when(~ok, "quarantine").when(F.col("accepted") > utc(cutoff), "after_cutoff").otherwise("valid")
    return flat.withColumn("state", state).withColumn("reason", F.when(~ok, "invalid_contract"))


def first_accepted(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ("accepted", "seq")) -> DataFrame:
    """The first row of each key by acceptance.

    A key's rows are reduced to one where they lie before they are shuffled, so a key that holds a
    third of all rows costs one row for each task."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first).select("r.*")


def conflicts(rows: DataFrame, keys: list[str], body: list[str]) -> DataFrame:
    """Keys whose rows differ in content: n (rows) and contents (distinct fingerprints)."""
    marked = rows.select(*keys, fingerprint(*body).alias("f"))
    return marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("f").alias("contents")).where("contents > 1")


MODES = ("duplicate", "quarantine")


def deduplicate(valid: DataFrame, conflict: str = "duplicate") -> DataFrame:
    """Facts with business_key: one row for each event, then for each business key.

    conflict says what becomes of an event_id that comes with several contents: its first accepted
    row stands and the others are duplicates, or (quarantine) none of its rows is a fact."""
    if conflict not in MODES:
        raise ValueError(f"{conflict} is none of {MODES}")
    keys = ["source", "app", "event_id"]
    if conflict == "duplicate":
        events = first_accepted(valid, keys)
    else:
        first = F.min_by(F.struct(*valid.columns), F.struct("accepted", "seq")).alias("r")
        contents = valid.withColumn("_f", fingerprint(*_body(valid))).groupBy(*[F.col(k).alias(f"_{k}") for k in keys])
        events = contents.agg(first, F.min("_f").alias("lo"), F.max("_f").alias("hi")).where("lo = hi").select("r.*")
    keyed = events.withColumn("business_key", business_key(F.col("event_type"), F.col("request_id"), F.col("event_id")))
    return first_accepted(keyed, ["source", "app", "business_key"])


def _body(rows: DataFrame) -> list[str]:
    return [f for f in FIELDS if f in rows.columns]


def conflicting(valid: DataFrame) -> DataFrame:
    """Rows that repeat an event_id with other content than the first accepted row has.

    The first row's fingerprint is found by one aggregation of an event's rows, and only events of
    several contents are joined back."""
    keys = ["source", "app", "event_id"]
    marked = valid.withColumn("_f", fingerprint(*_body(valid)))
    first = marked.groupBy(*keys).agg(F.min_by("_f", F.struct("accepted", "seq")).alias("_first"), F.min("_f").alias("_lo"), F.max("_f").alias("_hi"))
    first = first.where("_lo <> _hi").drop("_lo", "_hi")
    return marked.join(first, keys).where("_f <> _first").select(*valid.columns).withColumn("reason", F.lit("event_id_conflict"))


def quality_counts(classified: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: raw, valid, duplicates, quarantined, after_cutoff; raw is the sum of the others."""
    seen = classified.agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(F.col("state") == "valid").alias("accepted"),
        F.count_if(F.col("state") == "quarantine").alias("quarantined"),
        F.count_if(F.col("state") == "after_cutoff").alias("after_cutoff"),
    )
    kept = facts.agg(F.count(F.lit(1)).alias("valid"))
    # Each side is a single row.
    return seen.join(F.broadcast(kept)).select("raw", "valid", (F.col("accepted") - F.col("valid")).alias("duplicates"), "quarantined", "after_cutoff")


def state_merge(old: DataFrame, new: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """Union of old and new state without what was accepted `days` ago or earlier, one row for each
    (source, app, business_key). Ages count from the original acceptance, so merging renews nothing."""
    alive = F.col("accepted") + F.expr(f"INTERVAL {days} DAYS") > utc(now)
    return first_accepted(old.unionByName(new).where(alive), ["source", "app", "business_key"])


def state_manifest(state: DataFrame, days: int = 30) -> DataFrame:
    oldest: Column = F.min("accepted")
    return state.agg(F.count(F.lit(1)).alias("rows"), oldest.alias("oldest"), (oldest + F.expr(f"INTERVAL {days} DAYS")).alias("expires_at"))
