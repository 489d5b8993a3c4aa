"""The contract, quarantine, deduplication and counts, against loops over the same rows."""

import json
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sedgeflow.functions.contract import known_fields
from sedgeflow.operators import dedup
from sedgeflow.sources.envelopes import read_events

UTC = timezone.utc
CUTOFF = datetime(2026, 1, 2, 12, tzinfo=UTC)


def event(kind="page_view", **more):
    base = {"schema_version": 1, "event_id": str(uuid.uuid4()), "app": "site", "event_type": kind, "occurred_at": "2026-01-02T08:00:00Z"}
    if kind == "page_view":
        base |= {"path": "/a", "anonymous_id": str(uuid.uuid4())}
    if kind == "request_complete":
        base |= {"app": "game", "request_id": "r1", "character_id": "c", "success": True, "elapsed_ms": 5}
    return base | more


def envelope(seq, e, at="2026-01-02T09:00:00Z", source="synthetic"):
    return {"seq": seq, "source": source, "accepted_at": at, "event": e}


def lines(tmp_path, rows):
    at = tmp_path / "events.jsonl"
    at.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(at)


GOOD = [
    event(),
    event(app="game"),
    event("character_select", app="game", character_id="c_1"),
    event("entry_click", jump_id=str(uuid.uuid4()), channel="home"),
    event("entry_arrival", app="game", jump_id=str(uuid.uuid4())),
    event("request_observed", app="game", request_id="r-1"),
    event("request_complete"),
    event("request_complete", success=False, elapsed_ms=86_400_000),
]
BAD = [
    event(event_id="no-uuid"),
    event(path="a"),
    event(path="/a?b"),
    event(path="/" + "x" * 200),
    event(path=None),
    event(jump_id=str(uuid.uuid4())),
    event(occurred_at="2026-01-02T08:00:00"),
    event(occurred_at="soon"),
    event(schema_version=2),
    event(app="other"),
    event("entry_click", app="game", jump_id=str(uuid.uuid4()), channel="home"),
    event("entry_click", jump_id=str(uuid.uuid4()), channel="a b"),
    event("request_complete", anonymous_id=str(uuid.uuid4())),
    event("request_complete", elapsed_ms=86_400_001),
    event("request_complete", elapsed_ms=-1),
    event("request_complete", request_id=None),
    event("unknown"),
]


def test_contract_accepts_and_rejects(spark, tmp_path):
    rows = [envelope(n + 1, e) for n, e in enumerate(GOOD + BAD)]
    rows += [envelope(0, event()), envelope(100, event(), source="real"), envelope(101, event(), at="never"), "{not json"]
    found = dedup.classify(read_events(spark, lines(tmp_path, rows)), "synthetic", CUTOFF).select("seq", "state", "reason").collect()
    ok = {r.seq for r in found if r.state == "valid"}
    assert ok == set(range(1, len(GOOD) + 1))
    assert sum(r.state == "quarantine" and r.reason == "invalid_contract" for r in found) == len(BAD) + 4


def test_unknown_fields(spark):
    df = spark.createDataFrame([('{"app": "x", "path": "/"}',), ('{"app": "x", "more": 1}',), (None,)], "j string")
    assert [r[0] for r in df.select(known_fields(F.col("j"))).collect()] == [True, False, False]


def test_cutoff_is_inclusive(spark, tmp_path):
    rows = [envelope(1, event(), at="2026-01-02T12:00:00Z"), envelope(2, event(), at="2026-01-02T12:00:00.001Z")]
    found = {r.seq: r.state for r in dedup.classify(read_events(spark, lines(tmp_path, rows)), "synthetic", CUTOFF).collect()}
    assert found == {1: "valid", 2: "after_cutoff"}


def test_dedup_and_counts_reconcile(spark, tmp_path):
    a, done, other = event(), event("request_complete"), event("request_complete", success=False)
    rows = [
        envelope(3, a, at="2026-01-02T09:00:03Z"),
        envelope(1, a, at="2026-01-02T09:00:05Z"),  # accepted later, in spite of its number
        envelope(4, done),
        envelope(5, other, at="2026-01-02T10:00:00Z"),  # the same request again
        envelope(6, event(path="bad")),
        envelope(7, event(), at="2026-01-02T13:00:00Z"),
    ]
    seen = dedup.classify(read_events(spark, lines(tmp_path, rows)), "synthetic", CUTOFF)
    facts = dedup.deduplicate(seen.where("state = 'valid'"))
    assert {(r.seq, r.success) for r in facts.collect()} == {(3, None), (4, True)}
    counts = dedup.quality_counts(seen, facts).first().asDict()
    assert counts == {"raw": 6, "valid": 2, "duplicates": 2, "quarantined": 1, "after_cutoff": 1}
    assert counts["raw"] == sum(v for k, v in counts.items() if k != "raw")


def test_conflicts_are_later_rows_with_other_content(spark, tmp_path):
    a = event()
    rows = [envelope(1, a), envelope(2, a), envelope(3, a | {"path": "/other"}, at="2026-01-02T10:00:00Z")]
    seen = dedup.classify(read_events(spark, lines(tmp_path, rows)), "synthetic", CUTOFF)
    assert [r.seq for r in dedup.conflicting(seen).collect()] == [3]
    assert dedup.conflicts(seen, ["event_id"], ["path"]).first().contents == 2


def test_state_is_not_renewed(spark):
    schema = "source string, app string, business_key string, accepted timestamp, seq long"
    now = datetime(2026, 2, 1, tzinfo=UTC)
    row = lambda key, days, seq: ("real", "a", key, now - timedelta(days=days), seq)
    old = spark.createDataFrame([row("x", 20, 1), row("gone", 30, 2)], schema)
    new = spark.createDataFrame([row("x", 1, 9), row("y", 2, 3)], schema)
    merged = dedup.state_merge(old, new, now)
    assert {(r.business_key, r.seq) for r in merged.collect()} == {("x", 1), ("y", 3)}
    m = dedup.state_manifest(merged).first()
    assert m.rows == 2 and m.oldest.day == 12


@pytest.mark.parametrize("rows", [[], ["{broken"]])
def test_empty_and_broken_inputs(spark, tmp_path, rows):
    seen = dedup.classify(read_events(spark, lines(tmp_path, rows)), "synthetic", CUTOFF)
    counts = dedup.quality_counts(seen, dedup.deduplicate(seen.where("state = 'valid'"))).first().asDict()
    assert counts["raw"] == len(rows) == counts["quarantined"]
