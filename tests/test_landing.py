"""Landing, serving tables, catalogues, start checks, identities, atomic texts."""

import uuid
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sedgeflow.functions import contract
from sedgeflow.operators import catalogues, dedup, public, retention
from sedgeflow.sources import envelopes, landing, serving
from sedgeflow.sources.lake import Table
from sedgeflow.sources.shared import exists, list_names, read_text, scratch, write_text
from sedgeflow.streaming import dedup as streams

UTC = timezone.utc


def test_shares_go_round():
    assert landing.shares({"a": 0, "b": 0, "c": 5}, {"a": 2, "b": 100, "c": 100}, 32) == {"a": 2, "b": 15, "c": 20}
    assert landing.shares({"a": 0, "b": 0}, {"a": 9, "b": 9}, 1) == {"a": 1, "b": 0}


def log(spark, n=10):
    return spark.range(n).select(F.explode(F.array(F.lit("t:0"), F.lit("t:1"))).alias("partition"), F.col("id").alias("offset"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"))


def test_landing_recovers(spark):
    top, told = scratch(spark), []
    here = landing.Landing(spark, f"{top}/journal", f"{top}/ods")
    bounds = {"t:0": (0, 10), "t:1": (0, 10)}
    first = here.capture(log(spark), bounds, 6)
    assert here.capture(log(spark).limit(0), bounds) == first  # pending batches come before newer rows
    with pytest.raises(landing.LandingError):
        here.acknowledge(told.append)
    receipt = here.land()
    assert here.land() == receipt
    here.acknowledge(told.append)
    assert told == [{"t:0": 3, "t:1": 3}] and here.state()["snapshot"] == receipt["snapshot"]
    here.capture(log(spark), bounds, 100)
    here.land()
    here.acknowledge(told.append)
    assert here.capture(log(spark), bounds) is None
    assert here.read().count() == 20 and here.read(receipt["snapshot"]).count() == 6
    with pytest.raises(landing.LandingError):
        here.capture(log(spark), {"t:0": (0, 12), "t:1": (0, 10)})  # rows that aren't there
    with pytest.raises(landing.LandingError):
        here.capture(log(spark), {"t:0": (11, 12), "t:1": (0, 10)})
    with pytest.raises(landing.LandingError):
        here.capture(log(spark), {"t:0": (0, 10)})
    other = landing.Landing(spark, f"{top}/more", f"{top}/ods2")
    with pytest.raises(landing.LandingError):
        other.capture(log(spark), bounds, max_bytes=10)
    with pytest.raises(landing.LandingError):
        other.capture(log(spark).unionByName(log(spark, 1)), bounds)


def test_serving(spark):
    url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.createDataFrame([(date(2026, 1, 1), "s1", 5), (date(2026, 1, 1), "s2", 9)], "business_date date, snapshot_id string, pv long")
    serving.write_table(rows.withColumnsRenamed({c: c.upper() for c in rows.columns}), url, "DAILY", driver=driver)
    back = serving.read_table(spark, url, "DAILY", driver, split=("PV", 0, 10, 2)).where("PV > 5")
    assert "PushedFilters: [*IsNotNull(PV), *GreaterThan(PV,5)" in back._jdf.queryExecution().executedPlan().toString()
    assert [r.SNAPSHOT_ID for r in back.collect()] == ["s2"]
    days = spark.createDataFrame([(date(2026, 1, 1), "s2"), (date(2026, 1, 2), "s3")], "business_date date, snapshot_id string")
    assert {(r.business_date.day, r.pv) for r in serving.published(days, rows).collect()} == {(1, 9), (2, None)}


def test_database_of_the_driver_alone(spark, monkeypatch):
    """No task connects to it: the driver inserts and reads, batch by batch."""
    monkeypatch.setattr(serving, "beyond_executors", lambda spark, url: True)
    url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    made = [(date(2026, 1, 1 + n % 3), f"s{n}", None if n == 4 else n) for n in range(25)]
    rows = spark.createDataFrame(made, "BUSINESS_DATE date, SNAPSHOT_ID string, PV long").repartition(3)
    serving.write_table(rows.where("PV < 3"), url, "DAILY", driver=driver)
    serving.write_table(rows, url, "DAILY", "overwrite", driver, batch=4)
    assert sorted(map(tuple, serving.read_table(spark, url, "DAILY", driver).collect())) == sorted(made)
    held = spark.read.format("jdbc").options(url=url, dbtable="DAILY", driver=driver).load()
    assert sorted(r.PV for r in serving.copied(held, url, "DAILY", "PV >= 7", most=5).collect()) == list(range(7, 25))
    assert serving.copied(held, url, "DAILY", "PV > 99").count() == 0


def test_embedded_databases():
    urls = ("jdbc:derby:memory:x;create=true", "jdbc:derby:/data/x", "jdbc:derby://host:1527/x", "jdbc:postgresql://host/x")
    assert [bool(serving.EMBEDDED.match(u)) for u in urls] == [True, True, False, False]


def test_kafka_needs_its_connector(spark):
    with pytest.raises(Exception, match="kafka"):
        envelopes.kafka_events(spark, "localhost:1", "t", 5)


APP = {"release_sha": "a" * 40, "release_at": "2026-01-01T00:00:00+00:00", "origin": "https://x.example", "paths": ["/b", "/a"], "characters": ["c"]}


def test_catalogues(spark):
    now = datetime(2026, 1, 2, tzinfo=UTC)
    made = catalogues.snapshot("published", {"game": APP}, now)
    catalogues.check(made)
    assert {tuple(r) for r in catalogues.entries(spark, made).collect()} == {("game", "page", "/a"), ("game", "page", "/b"), ("game", "character", "c")}
    assert made["snapshot_id"] == catalogues.snapshot("published", {"game": APP | {"paths": ["/a", "/b"]}}, now)["snapshot_id"]
    for bad in ({"release_sha": "a"}, {"release_at": "2027-01-01T00:00:00+00:00"}, {"paths": []}, {"paths": ["/a/../b"]}, {"paths": ["/a?b"]}, {"characters": ["a b"]}, {"release_at": None}, {"more": 1}):
        with pytest.raises(ValueError):
            catalogues.snapshot("published", {"game": APP | bad}, now)
    with pytest.raises(ValueError):
        catalogues.check(made | {"stage": "candidate"})
    assert catalogues.dictionary(spark).count() == len(catalogues.METRICS)


def test_starts_are_checked():
    day = datetime(2026, 1, 1, tzinfo=UTC)
    streams.check_start("synthetic", 1, "lane")
    streams.check_start("real", 1, "abc_1", "abc-1", day, day + timedelta(days=7))
    for bad in (("synthetic", 2, "lane"), ("other", 1, "lane"), ("real", 1, "abc-1", "abc-1", day, day + timedelta(days=7)), ("real", 1, "abc_1", "abc-1", day, day + timedelta(days=6))):
        with pytest.raises(ValueError):
            streams.check_start(*bad)


def test_streams_are_started_again(spark):
    from pyspark.errors import StreamingQueryException

    calls, waits = [], []

    class Query:
        def awaitTermination(self):
            calls.append(1)
            if len(calls) < 3:
                raise StreamingQueryException("lost")

    assert streams.supervised(Query, 5, 2.0, waits.append) == 2 and waits == [2.0, 2.0]
    calls.clear()
    with pytest.raises(StreamingQueryException):
        streams.supervised(Query, 1, 0.0, waits.append)


def test_ids_are_those_of_uuid5(spark):
    df = spark.createDataFrame([("r1",), ("é",), ("",)], "request_id string")
    got = {r.request_id: r.u for r in df.select("request_id", envelopes.uuid5(F.concat(F.lit("request/"), F.col("request_id"))).alias("u")).collect()}
    assert got == {x: str(uuid.uuid5(uuid.NAMESPACE_URL, "request/" + x)) for x in ("r1", "é", "")}


def test_texts_are_replaced_at_once(spark):
    at = f"{scratch(spark)}/x.json"
    write_text(spark, at, "one", replace=False)
    with pytest.raises(FileExistsError):
        write_text(spark, at, "two", replace=False)
    write_text(spark, at, "three")
    assert read_text(spark, at) == "three" and list_names(spark, at.rsplit("/", 1)[0]) == ["x.json"]


def test_only_touched_folders_are_written(spark):
    t = Table(spark, scratch(spark))
    for lo in (0, 10, 20):
        t.append(spark.range(lo, lo + 10).withColumn("v", F.lit("a")))
    before = t.log()["folders"]
    t.merge(spark.createDataFrame([(12, "b"), (99, "c")], "id long, v string"), ["id"])
    assert [f in t.log()["folders"] for f in before] == [True, False, True]
    t.delete(F.col("id") == 25)
    assert t.log()["folders"][0] == before[0] and before[2] not in t.log()["folders"]
    assert {r.id: r.v for r in t.read().collect()} == {**{n: "a" for n in range(30) if n != 25}, 12: "b", 99: "c"}
    t.repartition_spec(["v"], rewrite=False)
    t.append(spark.createDataFrame([(50, "d")], "id long, v string"))
    assert {r.spec: r.rows for r in t.spec_counts().collect()} == {"": 30, "v": 1}


def test_conflict_modes(spark):
    schema = "seq long, source string, app string, event_id string, event_type string, request_id string, path string, accepted timestamp"
    at = datetime(2026, 1, 1, tzinfo=UTC)
    row = lambda n, e, path: (n, "real", "game", e, "page_view", None, path, at + timedelta(seconds=n))
    rows = spark.createDataFrame([row(1, "a", "/x"), row(2, "a", "/y"), row(3, "b", "/x"), row(4, "b", "/x")], schema)
    assert {r.seq for r in dedup.deduplicate(rows).collect()} == {1, 3}
    assert {r.seq for r in dedup.deduplicate(rows, "quarantine").collect()} == {3}
    assert {r.seq for r in dedup.conflicting(rows).collect()} == {2}
    with pytest.raises(ValueError):
        dedup.deduplicate(rows, "other")


def test_windows_and_lists(spark):
    now = datetime(2026, 1, 10, tzinfo=UTC)
    at = spark.createDataFrame([(n, now - timedelta(days=n) + timedelta(seconds=1)) for n in (0, 1, 6, 7, 8)] + [(9, None)], "n long, t timestamp")
    lit = lambda d: F.lit(d)
    ok = contract.accepted_now(F.col("t"), lit(now))
    assert [r.n for r in at.where(ok).orderBy("n").collect()] == [0, 1, 6, 7]
    real = contract.retained(F.col("t"), lit(now - timedelta(days=6, hours=12)), lit(now + timedelta(hours=12)), lit(now))
    assert [r.n for r in at.where(real).orderBy("n").collect()] == [1, 6]
    lists = spark.createDataFrame([("/a", None), ("/z", None), (None, "c"), (None, "d"), (None, None)], "path string, character_id string")
    assert [r[0] for r in lists.select(contract.allowed_values(["/a"], ["c"])).collect()] == [True, False, True, False, True]
    assert lists.where(contract.allowed_values()).count() == 5


def test_expiry_staleness_rates(spark):
    now = datetime(2026, 1, 10, tzinfo=UTC)
    rows = spark.createDataFrame([(n, now - timedelta(days=n)) for n in (1, 6, 7)], "n long, t timestamp")
    assert {r.n for r in public.expire(rows, "t", now, 7).collect()} == {1, 6}
    late = spark.createDataFrame([(now - timedelta(minutes=3),), (now - timedelta(minutes=4),), (now - timedelta(hours=27),)], "t timestamp")
    assert [tuple(r) for r in late.select(public.stale(F.col("t"), F.lit(now)), public.stale(F.col("t"), F.lit(now), True)).collect()] == [("fresh", "fresh"), ("stale", "fresh"), ("stale", "stale")]
    shares = spark.createDataFrame([(1, 3), (None, 0)], "r long, e long").select(retention.rate("r", "e").alias("x"))
    assert [r.x for r in shares.collect()] == ["0.333333", "immature"]
    assert not exists(spark, f"{scratch(spark)}/nothing")


def test_unknown_fields_are_quarantined(spark, tmp_path):
    import json

    e = {"schema_version": 1, "event_id": str(uuid.uuid4()), "app": "site", "event_type": "page_view", "occurred_at": "2026-01-02T08:00:00Z", "path": "/a"}
    rows = [e, e | {"more": 1}, e | {"more": None}, e | {"elapsed_ms": "soon"}, e | {"event_id": 5}]
    (tmp_path / "x.jsonl").write_text("".join(json.dumps({"seq": n + 1, "source": "real", "accepted_at": "2026-01-02T09:00:00Z", "event": x}) + "\n" for n, x in enumerate(rows)))
    seen = dedup.classify(envelopes.read_events(spark, str(tmp_path)), "real", datetime(2026, 2, 1, tzinfo=UTC))
    assert {r.seq: r.state for r in seen.collect()} == {1: "valid", 2: "quarantine", 3: "quarantine", 4: "quarantine", 5: "quarantine"}
