"""Paired releases, the lineage journal, replay order, event logs, driver entry points."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sedgeflow.functions.time import report_window
from sedgeflow.operators import lineage, releases, replay
from sedgeflow.sources import event_log
from sedgeflow.sources.envelopes import log_events
from sedgeflow.sources.shared import read_text, scratch

UTC = timezone.utc


def test_release(spark):
    path = scratch(spark)
    funnel = spark.createDataFrame([(3, 2, 1, 1, 1)], "clicks int, arrived int, selected int, requested int, converted int")
    kept = spark.createDataFrame([(5, 5, 2, 0, None)], "users int, eligible_d1 int, retained_d1 int, eligible_d7 int, retained_d7 int")
    a = releases.package({"funnel": funnel}, "in", ("a", "b"))
    b = releases.package({"x": kept}, "in", ("a", "b"))
    name = releases.release(spark, path, a, b, funnel, kept)
    assert json.loads(read_text(spark, f"{path}/latest.json"))["release"] == name == releases.release(spark, path, a, b, funnel, kept)
    with pytest.raises(ValueError):
        releases.release(spark, path, a, b | {"input": "other"}, funnel, kept)
    with pytest.raises(ValueError):
        releases.release(spark, path, a, b, funnel.withColumn("converted", F.lit(9)), kept)
    with pytest.raises(ValueError):
        releases.release(spark, path, a, b, funnel, kept.withColumn("retained_d7", F.lit(0)))


def test_lineage(spark):
    path = scratch(spark)
    ids = [lineage.record(spark, path, "r1", "job", s, t) for s, t in (("START", "1"), ("START", "1"), ("COMPLETE", "2"))]
    assert ids[0] == ids[1]
    lineage.acknowledge(spark, path, ids[0])
    events, acks = lineage.journal(spark, path)
    assert [r.state for r in lineage.unacknowledged(events, acks).collect()] == ["COMPLETE"]
    assert [tuple(r) for r in lineage.run_states(events).collect()] == [("r1", "job", "1", "2", "COMPLETE")]


def test_replay(spark):
    t = datetime(2026, 1, 1, tzinfo=UTC)
    schema = "source string, app string, business_key string, seq long, event_time timestamp, accepted timestamp"
    rows = [("s", "a", "k", 1, t + timedelta(hours=1), t), ("s", "a", "l", 2, t, t)]
    assert [r.seq for r in replay.replay_order(spark.createDataFrame(rows, schema)).collect()] == [2, 1]
    with pytest.raises(ValueError):
        replay.replay_order(spark.createDataFrame([*rows, ("s", "a", "k", 3, t, t + timedelta(hours=2))], schema))


def test_event_log(spark, tmp_path):
    task = {"Event": "SparkListenerTaskEnd", "Stage ID": 1, "Task Metrics": {"Executor Run Time": 5, "Shuffle Write Metrics": {"Shuffle Bytes Written": 7}}}
    (tmp_path / "log").write_text("\n".join(map(json.dumps, ({"Event": "SparkListenerJobStart", "Job ID": 0, "Stage IDs": [1], "Properties": {"spark.jobGroup.id": "g"}}, task, task))))
    r = event_log.stage_metrics(event_log.read_log(spark, str(tmp_path / "log"))).first()
    assert (r.job_group, r.tasks, r.run_ms, r.shuffle_written) == ("g", 2, 10, 14)


def test_log_events_have_stable_ids(spark):
    df = spark.createDataFrame([("r1", "c", True, 5, "2026-01-01T00:00:00Z")] * 2, "request_id string, character_id string, success boolean, elapsed_ms long, at string")
    ids = {r.event_id for r in log_events(df).collect()}
    import uuid

    assert len(ids) == 1 and uuid.UUID(next(iter(ids))).version == 5


def test_report_window():
    w = report_window(datetime(2026, 1, 10, 17, tzinfo=UTC), "a/b")
    assert (w.end.day, (w.end - w.start).days) == (10, 6) and "/" not in w.run_id
    with pytest.raises(ValueError):
        report_window(datetime(2026, 1, 10, tzinfo=UTC), "r", date_to=datetime(2026, 1, 10).date())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
