"""Versioned publication: content-addressed snapshots, a pointer that moves only forward."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sedgeflow.functions.time import aware
from sedgeflow.operators.metrics import duplicate_grains, gate
from sedgeflow.sources.shared import exists, move, read_text, remove, write_text

FIELDS = ("source", "app", "business_date", "pv", "uv", "requests", "successes")
MOST_DAYS = 366


def calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("business_date"))


def day_hashes(rows: DataFrame, start: date, end: date) -> DataFrame:
    """business_date, n, hash of each day of the window, empty days too."""
    line = F.to_json(F.struct(*sorted(FIELDS)))
    per = rows.groupBy("business_date").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(line)).alias("lines"))
    days = calendar(rows.sparkSession, start, end).join(per, "business_date", "left")
    return days.select("business_date", F.coalesce("n", F.lit(0)).alias("n"), F.sha2(F.concat_ws("\n", F.coalesce("lines", F.array().cast("array<string>"))), 256).alias("hash"))


def validate(rows: DataFrame, start: date, end: date, counts: dict[str, int] | None = None) -> None:
    """Raises unless the package is closed: fields, window, grain, invariants, reconciled counts."""
    if set(rows.columns) != set(FIELDS):
        raise ValueError("the rows have other fields")
    if not 0 <= (end - start).days < MOST_DAYS:
        raise ValueError(f"a window has 1 to {MOST_DAYS} days")
    if not gate(rows).isEmpty() or not duplicate_grains(rows, ["source", "app", "business_date"]).isEmpty():
        raise ValueError("rows break an invariant or repeat a grain")
    if not rows.where(~F.col("business_date").between(F.lit(start), F.lit(end))).isEmpty():
        raise ValueError("rows lie outside the window")
    if counts and counts["raw"] != sum(counts[k] for k in ("valid", "duplicates", "quarantined", "after_cutoff")):
        raise ValueError("the counts don't add up")


class Publication:
    """Snapshots of one source's daily rows. Snapshots are folders named by their content; the
    pointer file names, for each day, the snapshot and version (cutoff in microseconds) to read."""

    def __init__(self, spark: SparkSession, path: str, source: str):
        self.spark, self.path, self.source = spark, path, source

    def pointers(self) -> dict[str, dict]:
        at = f"{self.path}/{self.source}/pointer.json"
        return json.loads(read_text(self.spark, at)) if exists(self.spark, at) else {}

    def publish(self, rows: DataFrame, start: date, end: date, cutoff: datetime, counts: dict[str, int] | None = None) -> dict:
        """Rejects a cutoff older than a day's, and the same cutoff with other content.

        The rows are computed once, into a staged folder; while that is written their number and a sum
        of their hashes are observed, and what is read back must have the same. Everything else is
        asked of the copy, which then gets its content's name, before the one pointer write that
        publishes all days."""
        if set(rows.columns) != set(FIELDS):
            raise ValueError("the rows have other fields")
        version = int(aware(cutoff).timestamp() * 1_000_000)
        seen, staged = Observation(), f"{self.path}/{self.source}/staged-{uuid.uuid4().hex}"
        mark = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*FIELDS).cast("decimal(38,0)")).alias("mark"))
        rows.select(*FIELDS).observe(seen, *mark).coalesce(1).write.parquet(staged)  # a row for each app and day of 366 days
        copy = self.spark.read.parquet(staged)
        try:
            if copy.agg(*mark).first().asDict() != seen.get:
                raise ValueError("what was written differs")
            validate(copy, start, end, counts)
            if not copy.where(F.col("source") != self.source).isEmpty():
                raise ValueError("rows of another source")
            days = {str(r["business_date"]): r["hash"] for r in day_hashes(copy, start, end).collect()}  # at most 366 rows
            known = self.pointers()
            for day, digest in days.items():
                old = known.get(day)
                if old and (old["version"] > version or (old["version"] == version and old["hash"] != digest)):
                    raise ValueError(f"{day}: an older cutoff, or other content at the same one")
        except ValueError:
            remove(self.spark, staged)
            raise
        snapshot = hashlib.sha256(json.dumps([version, sorted(days.items())]).encode()).hexdigest()
        move(self.spark, staged, f"{self.path}/{self.source}/{snapshot}")
        known.update({day: {"snapshot": snapshot, "version": version, "hash": digest} for day, digest in days.items()})
        write_text(self.spark, f"{self.path}/{self.source}/pointer.json", json.dumps(known, sort_keys=True))
        return {"snapshot_id": snapshot, "version": version}

    def read(self) -> DataFrame:
        """Published days with their rows and provenance; days without rows have one of nulls."""
        known = self.pointers()
        point = self.spark.createDataFrame([(date.fromisoformat(d), p["snapshot"], p["version"]) for d, p in known.items()], "business_date date, snapshot_id string, version long")
        parts = [self.spark.read.parquet(f"{self.path}/{self.source}/{s}").withColumn("snapshot_id", F.lit(s)) for s in sorted({p["snapshot"] for p in known.values()})]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return point.join(rows, ["business_date", "snapshot_id"], "left")

