"""Manifests, capture, versioned tables, publication, layout."""

import hashlib
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from sedgeflow.operators import dimensions, metrics
from sedgeflow.operators.joins import bounded_rows, same_rows
from sedgeflow.operators.publication import Publication, day_hashes, validate
from sedgeflow.plans import layout
from sedgeflow.sources import envelopes
from sedgeflow.sources.lake import Table
from sedgeflow.sources.shared import read_text, scratch, write_text

UTC = timezone.utc


def test_files_are_hashed_by_executors(spark, monkeypatch):
    """The driver reads the manifest alone, and streams what is too long for a task."""
    top = scratch(spark)
    bodies = {f"{top}/{n} %41.jsonl": "x\u00e9\n" * n for n in (0, 1, 5, 900)}
    for at, body in bodies.items():
        write_text(spark, at, body)
    told = []
    monkeypatch.setattr(envelopes, "read_text", lambda spark, at: told.append(at) or read_text(spark, at))
    monkeypatch.setattr(envelopes, "WHOLE_BYTES", 1000)
    expected = {at: hashlib.sha256(body.encode()).hexdigest() for at, body in bodies.items()}
    assert envelopes.digests(spark, list(bodies)) == expected
    batches = [{"batch_id": at, "path": at, "sha256": h, "valid": 1, "quarantined": 0} for at, h in expected.items()]
    made = envelopes.write_snapshot(spark, top, "events", "synthetic", batches)
    assert sorted(envelopes.resolve_snapshot(spark, made, "events", "synthetic")[0]) == sorted(bodies)
    assert told == [made]


def test_manifest_checks(spark):
    top = scratch(spark)
    write_text(spark, f"{top}/a.jsonl", "{}\n")
    batch = {"batch_id": "a", "path": f"{top}/a.jsonl", "sha256": hashlib.sha256(b"{}\n").hexdigest(), "valid": 1, "quarantined": 0}
    at = envelopes.write_snapshot(spark, top, "events", "synthetic", [batch])
    assert envelopes.resolve_snapshot(spark, at, "events", "synthetic")[0] == [f"{top}/a.jsonl"]
    with pytest.raises(envelopes.SnapshotError):
        envelopes.resolve_snapshot(spark, at, "events", "real")
    for bad in ({"quarantined": 1}, {"sha256": "0"}):
        other = envelopes.write_snapshot(spark, top, "events", "synthetic", [batch | bad])
        with pytest.raises(envelopes.SnapshotError):
            envelopes.resolve_snapshot(spark, other, "events", "synthetic")
    with pytest.raises(envelopes.SnapshotError):
        envelopes.resolve_snapshot(spark, envelopes.write_snapshot(spark, top, "events", "synthetic", [batch, batch]), "events", "synthetic")


def test_sync_is_idempotent(spark):
    s, seen = envelopes.Sync(spark, scratch(spark)), []
    pages = lambda after, limit: [{"seq": n} for n in range(after + 1, min(after + limit, 5) + 1)]
    assert [s.once(pages, seen.append, 3) for _ in range(3)] == [3, 2, 0] and s.cursor() == 5 and len(seen) == 2
    with pytest.raises(ValueError):
        s.once(lambda a, n: [{"seq": 4}], seen.append)


def test_capture_is_bounded_and_contiguous(spark):
    rows = spark.range(10).select(F.lit(0).cast("long").alias("kafka_partition"), (F.col("id") + 7).alias("kafka_offset"))
    got = envelopes.bounded_capture(rows, {0: 15}, 5)
    assert sorted(r.kafka_offset for r in got.collect()) == [7, 8, 9, 10, 11]
    assert envelopes.contiguity(got).first().contiguous and not envelopes.contiguity(got.where("kafka_offset <> 9")).first().contiguous


def test_table_versions(spark):
    t = Table(spark, scratch(spark))
    rows = spark.range(6).withColumn("v", F.lit("a"))
    t.append(rows)
    t.append(spark.createDataFrame([(9, "z", 1)], "id long, v string, more int"))
    assert t.read(1).columns == ["id", "v"] and t.read().where("id = 0").first().more is None
    t.merge(spark.createDataFrame([(0, "new", 5), (20, "in", 6)], "id long, v string, more int"), ["id"])
    t.delete(F.col("id") == 1)
    before = t.read()
    t.compact(1)
    t.repartition_spec(["v"])
    assert same_rows(before, t.read()) and t.files(5).count() == 1
    assert {(r.id, r.v) for r in t.read().collect()} == {(0, "new"), (20, "in"), (9, "z"), (2, "a"), (3, "a"), (4, "a"), (5, "a")}
    assert [r.operation for r in t.history().collect()] == ["append", "append", "merge", "delete", "compact", "partition"]
    assert t.read(1).count() == 6
    with pytest.raises(ValueError):
        t.merge(spark.createDataFrame([(0, "x", 1), (0, "y", 1)], "id long, v string, more int"), ["id"])


DAILY = "source string, app string, business_date date, pv long, uv long, requests long, successes long"


def test_publication(spark):
    p = Publication(spark, scratch(spark), "real")
    day = date(2026, 1, 1)
    rows = spark.createDataFrame([("real", "a", day, 3, 2, 1, 1)], DAILY)
    first = p.publish(rows, day, date(2026, 1, 3), datetime(2026, 1, 5, tzinfo=UTC))
    assert p.publish(rows, day, date(2026, 1, 3), datetime(2026, 1, 5, tzinfo=UTC)) == first
    got = {r.business_date: r.pv for r in p.read().collect()}
    assert got == {day: 3, date(2026, 1, 2): None, date(2026, 1, 3): None}
    other = rows.withColumn("pv", F.lit(4).cast("long"))
    for cutoff in (datetime(2026, 1, 5, tzinfo=UTC), datetime(2026, 1, 4, tzinfo=UTC)):
        with pytest.raises(ValueError):
            p.publish(other, day, date(2026, 1, 3), cutoff)
    p.publish(other, day, day, datetime(2026, 1, 6, tzinfo=UTC))
    assert {r.business_date: r.pv for r in p.read().collect()}[day] == 4
    assert day_hashes(rows, day, date(2026, 1, 2)).where("n = 0").count() == 1


@pytest.mark.parametrize("bad", [("real", "a", date(2026, 1, 1), 1, 1, 1, 2), ("real", "a", date(2025, 1, 1), 1, 1, 1, 1)])
def test_broken_packages(spark, bad):
    with pytest.raises(ValueError):
        validate(spark.createDataFrame([bad], DAILY), date(2026, 1, 1), date(2026, 1, 2))


def test_dimension_faults(spark):
    at = lambda d: datetime(2026, 1, d, tzinfo=UTC)
    cov = spark.createDataFrame([("s", "a", "r1", at(1), at(5)), ("s", "a", "r2", at(4), at(8))], "source string, app string, release_id string, covered_from timestamp, covered_to timestamp")
    rel = spark.createDataFrame([("s", "a", "r1", at(1)), ("s", "a", "r2", at(4)), ("s", "a", "r3", at(4))], "source string, app string, release_id string, release_at timestamp")
    faults = {r.fault for r in dimensions.coverage_faults(cov, rel).collect()}
    assert faults == {"overlap", "crossing", "same_instant"}
    ends = spark.createDataFrame([("s", "a", "r1", at(1), at(4))], cov.schema)
    assert {(r.release_id, r.valid_to is not None) for r in dimensions.validity(rel, ends).collect()} == {("r1", True), ("r2", False), ("r3", False)}


def test_layout_prunes(spark, tmp_path):
    facts = spark.range(1000).select(F.col("id").cast("string").alias("event_id"), F.lit("real").alias("source"), F.date_add(F.lit(date(2026, 1, 1)), (F.col("id") % 3).cast("int")).alias("business_date"), F.lit("a").alias("app"), F.lit("page_view").alias("event_type"), F.lit("u").alias("anonymous_id"), F.lit(True).alias("success"))
    with pytest.raises(ValueError):
        envelopes.write_facts(facts, str(tmp_path / "x"), 1)
    path = envelopes.write_facts(facts, str(tmp_path / "facts"), 0)
    made = metrics.daily(spark.read.parquet(path), date(2026, 1, 2), date(2026, 1, 2))
    assert made.first().pv == 333 and "business_date" in layout.partition_filters(made)[0]
    assert "event_id" not in layout.read_columns(made)
    assert layout.compact(spark, path, str(tmp_path / "small")) == 1
    assert same_rows(spark.read.parquet(path), spark.read.parquet(str(tmp_path / "small")))
    with pytest.raises(ValueError):
        bounded_rows(facts, 10)
    assert len(read_text(spark, f"{path}/_SUCCESS")) == 0
