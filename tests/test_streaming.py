"""Streaming classes in phases, one event a micro-batch where the watermark matters."""

import json
import uuid

import pandas as pd
import pytest

from sedgeflow.plans.session import STREAM_SETTINGS
from sedgeflow.sources.envelopes import stream_events
from sedgeflow.sources.lake import Table
from sedgeflow.sources.shared import scratch
from sedgeflow.streaming import dedup, upsert


@pytest.fixture
def stream_spark(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for k, v in (STREAM_SETTINGS | {"spark.sql.shuffle.partitions": "1"}).items():
        spark.conf.set(k, v)
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def row(seq, event_id, at, kind="page_view", **more):
    e = {"schema_version": 1, "event_id": event_id, "app": "game", "event_type": kind, "occurred_at": at}
    e |= {"path": "/a"} if kind == "page_view" else {"request_id": "r", "character_id": "c", "success": True, "elapsed_ms": 1}
    return {"seq": seq, "source": "synthetic", "accepted_at": at, "event": e | more}


def test_classes(stream_spark, tmp_path):
    a, b, c, d, e, f = (str(uuid.uuid4()) for _ in range(6))
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    phases = [
        [row(1, a, "2026-01-01T16:00:00Z"), row(2, a, "2026-01-01T16:00:00Z"), row(3, a, "2026-01-01T16:00:00Z", path="/b"), row(4, b, "2026-01-01T16:00:00Z", "request_complete"), row(5, "bad", "2026-01-01T16:00:00Z")],
        [row(6, c, "2026-01-01T16:15:00Z", "request_complete")],
        # The watermark is 16:14:30, less 1 ms: 16:04:29.999 is accepted, the millisecond before is late.
        [row(7, d, "2026-01-01T16:04:29.999Z"), row(8, e, "2026-01-01T16:04:29.998Z"), row(9, a, "2026-01-01T16:00:00Z")],
        [row(10, e, "2026-01-01T16:04:29.998Z"), row(11, f, "2026-01-01T16:15:30Z")],
    ]
    for n, rows in enumerate(phases):
        (src / f"{n}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        q = dedup.run(stream_events(stream_spark, str(src)), "synthetic", str(out))
        assert q.awaitTermination(300)
    got = {r.seq: (r["class"], r.reason) for r in stream_spark.read.parquet(str(out / "rows")).collect()}
    fact = ("fact", None)
    assert got == {
        1: fact, 2: ("duplicate", "event_duplicate"), 3: ("quarantine", "event_id_conflict"), 4: fact, 5: ("quarantine", "invalid_contract"),
        6: ("duplicate", "request_duplicate"), 7: fact, 8: ("late", "late"), 9: ("duplicate", "event_duplicate"), 10: ("late", "late"), 11: fact,
    }


class Timers:
    def getCurrentWatermarkInMs(self):
        return 0


class Asked(dict):
    """A map state that counts what is asked for and written."""

    asked = written = 0

    def exists(self):
        return bool(self)

    def getValue(self, key):
        self.asked += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.written += 1
        self[key] = value


def test_many_keys_a_call():
    """A call takes the rows of many keys, asks once for each key and writes the new ones."""
    held, at = dedup.Events(8), pd.Timestamp("2026-01-01")
    held.seen = Asked()

    def call(*rows):
        made = [(s, "x", "site", k, "page_view", k, at, f, "fact" if k else "quarantine", None, k, 7) for s, k, f in rows]
        frame = pd.DataFrame(made, columns=[*dedup.ROW.names, "key", "group"])
        (out,) = held.handleInputRows((7,), iter([frame[:2], frame[2:]]), Timers())
        return dict(zip(out["seq"], out["class"], strict=True))

    first = call((3, "a", "f"), (1, "a", "f"), (2, "b", "g"), (4, "a", "h"), (5, None, None))
    assert list(first.values()) == ["fact", "fact", "duplicate", "quarantine", "quarantine"]
    assert (held.seen.asked, held.seen.written, len(held.seen)) == (0, 2, 2)
    assert list(call((6, "a", "f"), (7, "c", "f"), (8, "a", "x"), (9, "c", "f")).values()) == ["duplicate", "fact", "quarantine", "duplicate"]
    assert (held.seen.asked, held.seen.written, len(held.seen)) == (2, 3, 3)


def test_upsert_batches_again(spark):
    t = Table(spark, scratch(spark))
    rows = spark.createDataFrame([("s", "a", "k", 5, 1), ("s", "a", "k", 3, 2), ("s", "a", "l", 4, 3)], "source string, app string, business_key string, seq long, v int")
    write = upsert.sink(t)
    for n in (0, 0):
        write(rows, n)
    write(rows.where("seq = 3").selectExpr("source", "app", "business_key", "7L AS seq", "v"), 1)
    assert {(r.business_key, r.seq) for r in t.read().collect()} == {("k", 3), ("l", 4)}
    daily = spark.createDataFrame([("s", "a", "2026-01-01", 1, 10), ("s", "a", "2026-01-02", 2, 10)], "source string, app string, business_date string, pv int, business_version long")
    fixed = spark.createDataFrame([("s", "a", "2026-01-01", 9, 11)], daily.schema)
    assert {(r.business_date, r.pv) for r in upsert.overlay(daily, fixed).collect()} == {("2026-01-01", 9), ("2026-01-02", 2)}
