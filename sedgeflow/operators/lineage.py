"""A lineage journal: runs' START, COMPLETE and FAIL events, each sent until it is acknowledged."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeflow.sources.shared import exists, write_text

STATES = ("START", "COMPLETE", "FAIL")
SCHEMA = "event_id string, run_id string, job string, state string, at string"


def record(spark: SparkSession, path: str, run_id: str, job: str, state: str, at: str) -> str:
    """Writes an event as one small file named by its content; again, it changes nothing."""
    if state not in STATES:
        raise ValueError(f"{state} is none of {STATES}")
    body = {"run_id": run_id, "job": job, "state": state, "at": at}
    event_id = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
    where = f"{path}/events/{event_id}.json"
    if not exists(spark, where):
        write_text(spark, where, json.dumps(body | {"event_id": event_id}), replace=False)
    return event_id


def acknowledge(spark: SparkSession, path: str, event_id: str) -> None:
    where = f"{path}/acks/{event_id}.json"
    if not exists(spark, where):
        write_text(spark, where, json.dumps({"event_id": event_id}), replace=False)


def journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events and acknowledgements."""
    events = spark.read.schema(SCHEMA).json(f"{path}/events") if exists(spark, f"{path}/events") else spark.createDataFrame([], SCHEMA)
    acks = spark.read.schema("event_id string").json(f"{path}/acks") if exists(spark, f"{path}/acks") else spark.createDataFrame([], "event_id string")
    return events, acks


def unacknowledged(events: DataFrame, acks: DataFrame, key: str = "event_id") -> DataFrame:
    return events.join(acks.select(key), key, "left_anti")


def run_states(events: DataFrame) -> DataFrame:
    """run_id, job, started, ended, state: the last event's, running without an end."""
    end = F.col("state").isin("COMPLETE", "FAIL")
    per = events.groupBy("run_id", "job").agg(F.min(F.when(F.col("state") == "START", F.col("at"))).alias("started"), F.max(F.when(end, F.struct("at", "state"))).alias("e"))
    return per.select("run_id", "job", "started", F.col("e.at").alias("ended"), F.coalesce("e.state", F.lit("RUNNING")).alias("state"))
