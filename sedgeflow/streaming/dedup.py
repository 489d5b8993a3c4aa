"""Stream deduplication with explicit classes: fact, duplicate, late, quarantine.

The order of tests is the contract's: contract, event fingerprint, lateness, business key. Duplicates
and late rows write no state. Late rows are classified, not dropped, so the processors run in
processing time and compare with the watermark themselves.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sedgeflow.functions.contract import APPS, FIELDS, business_key, fingerprint, known_fields, valid_envelope
from sedgeflow.functions.time import instant

WATERMARK = "30 seconds"
LATENESS_MS = 600_000
#: Groups of keys. A call takes all rows of a group, so that its cost is shared by many keys; a group's state
#: is a map, of which only the keys of the batch are asked for. It is part of what checkpoints hold.
GROUPS = 1024
#: Groups of rows that need no state.
ALONE = 256
#: Days for which a seen id is remembered.
STATE_DAYS = {"synthetic": 8, "real": 30}

ROW = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("source", "app", "event_id", "event_type", "business_key")],
        T.StructField("event_time", T.TimestampType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)
_KEY = T.StructType([T.StructField("key", T.StringType())])
_SEEN = T.StructType([T.StructField("fingerprint", T.StringType())])


class _Keyed(StatefulProcessor):
    """One value for each key of a group, forgotten after days."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", _KEY, _SEEN, ttlDurationMs=self.days * 86_400_000)

    def handleInputRows(self, group, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).drop(columns=["group"]).sort_values("seq", kind="stable").reset_index(drop=True)
        keys = batch.pop("key").tolist()
        any_seen = self.seen.exists()
        mark = timerValues.getCurrentWatermarkInMs()
        known: dict[str, str | None] = {}
        new: dict[str, str] = {}
        classes, reasons = [], []
        for key, row in zip(keys, batch.itertuples(index=False), strict=True):
            if key is None:  # a row that needs no state
                said, why, now = self.judge(row, None, mark)
            else:
                if key not in known:
                    held = self.seen.getValue((key,)) if any_seen else None
                    known[key] = held[0] if held is not None else None
                said, why, now = self.judge(row, known[key], mark)
                if now is not None and now != known[key]:
                    known[key] = new[key] = now
            classes.append(said)
            reasons.append(why)
        for key, value in new.items():
            self.seen.updateValue((key,), (value,))
        yield batch.assign(**{"class": classes, "reason": reasons})

    def judge(self, row, known, mark) -> tuple[str, str | None, str | None]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Events(_Keyed):
    def judge(self, row, known, mark):
        if row[-2] == "quarantine":
            return "quarantine", "invalid_contract", known
        if known is not None:
            return ("duplicate", "event_duplicate", known) if known == row.fingerprint else ("quarantine", "event_id_conflict", known)
        # The watermark is compared as bounded out-of-orderness has it, 1 ms earlier; 0 is none yet.
        if mark > 0 and int(row.event_time.timestamp() * 1000) < mark - 1 - LATENESS_MS:
            return "late", "late", known
        return "fact", None, row.fingerprint


class Requests(_Keyed):
    def judge(self, row, known, mark):
        said, why = row[-2], row[-1]
        if said != "fact" or row.event_type != "request_complete":
            return said, why, known
        return ("duplicate", "request_duplicate", known) if known is not None else ("fact", None, row.event_id)


def prepared(raw: DataFrame, source: str, apps: tuple[str, str] = APPS) -> DataFrame:
    """ROW of a stream of envelopes; class is quarantine where the contract is broken."""
    more = [c for c in ("_corrupt_record", "event_json") if c in raw.columns]
    flat = raw.select("seq", "source", "accepted_at", *more, "event.*").withColumn("event_time", instant(F.col("occurred_at")))
    ok = valid_envelope(source, "_corrupt_record" if "_corrupt_record" in more else None, apps)
    if "event_json" in more:
        ok = F.coalesce(ok & known_fields(F.col("event_json")), F.lit(False))
    rows = flat.select(
        "seq",
        "source",
        "app",
        "event_id",
        "event_type",
        business_key(F.col("event_type"), F.col("request_id"), F.col("event_id")).alias("business_key"),
        "event_time",
        fingerprint(*FIELDS).alias("fingerprint"),
        F.when(~ok, "quarantine").otherwise("fact").alias("class"),
        F.lit(None).cast("string").alias("reason"),
    )
    return rows.withWatermark("event_time", WATERMARK)


def _grouped(rows: DataFrame, key: Column):
    """Rows by the group of their key; rows without a key are dealt evenly over groups of their own."""
    alone = F.pmod(F.xxhash64("seq", "event_id", "business_key"), F.lit(ALONE)) + F.lit(GROUPS)
    group = F.when(key.isNull(), alone).otherwise(F.pmod(F.xxhash64(key), F.lit(GROUPS)))
    return rows.withColumns({"key": key, "group": group}).groupBy("group")


def classified(rows: DataFrame, source: str) -> DataFrame:
    """ROW with every row's class and reason; call it on what prepared() returns."""
    days = STATE_DAYS[source]
    event = F.when(F.col("class") != "quarantine", F.concat_ws(":", F.lit("id"), "source", "app", "event_id"))
    first = _grouped(rows, event).transformWithStateInPandas(Events(days), ROW, "append", "ProcessingTime")
    request = F.when((F.col("class") == "fact") & (F.col("event_type") == "request_complete"), F.concat_ws(":", F.lit("key"), "source", "app", "business_key"))
    return _grouped(first, request).transformWithStateInPandas(Requests(days), ROW, "append", "ProcessingTime")


def run(raw: DataFrame, source: str, path: str, interval: str | None = None):
    """Starts the stream: facts, duplicates, late and quarantined rows under path, by class and
    micro-batch. A batch that is run again replaces what it wrote. Without an interval one
    micro-batch is run: processors in processing time always ask for another one, so a trigger that
    waits for the last one would never end."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("class", "batch").parquet(f"{path}/rows")

    made = classified(prepared(raw, source), source).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{path}/checkpoint")
    return (made.trigger(processingTime=interval) if interval else made.trigger(once=True)).start()


def supervised(start, attempts: int = 10, delay: float = 5.0, sleep=time.sleep) -> int:
    """Starts a stream (start() gives its query) and starts it again from its checkpoint after a
    failure, at most `attempts` times with a fixed delay. Returns how often it was started again."""
    for n in range(attempts + 1):
        try:
            start().awaitTermination()
            return n
        except StreamingQueryException:
            if n == attempts:
                raise
            sleep(delay)
    return attempts


def check_start(source: str, partitions: int, lane: str, epoch: str | None = None, since: datetime | None = None, until: datetime | None = None, days: int = 7) -> None:
    """Raises unless a stream may start: its input is one ordered partition; a real one has an epoch
    with a safe name, whose lane is that name, and which is `days` long."""
    if source not in STATE_DAYS:
        raise ValueError(f"{source} is none of {sorted(STATE_DAYS)}")
    if partitions != 1:
        raise ValueError("the input must be one ordered partition")
    if source == "real":
        if not epoch or not re.fullmatch(r"[a-z][a-z0-9-]{2,23}", epoch) or lane != epoch.replace("-", "_"):
            raise ValueError("the lane isn't the epoch's")
        if not since or not until or until - since != timedelta(days=days):
            raise ValueError(f"an epoch has {days} days")


def sessions(rows: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Streaming sessions with the batch rule's boundary: a gap of exactly gap_minutes splits, so the
    window's gap is a microsecond shorter."""
    gap = f"{gap_minutes * 60_000_000 - 1} microseconds"
    known = rows.where("anonymous_id IS NOT NULL")
    return known.groupBy("source", "app", "anonymous_id", F.session_window("event_time", gap)).agg(F.min("event_time").alias("start"), F.max("event_time").alias("end"), F.count(F.lit(1)).alias("events"))
