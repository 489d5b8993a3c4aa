"""Sessions, retention, attribution and histories against loops and boundary cases."""

from datetime import date, datetime, timedelta, timezone

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sedgeflow.operators import attribution, history, joins, metrics, public, retention, sessions

UTC = timezone.utc
T0 = datetime(2026, 1, 2, 4, tzinfo=UTC)
FACT = "source string, app string, event_id string, event_type string, event_time timestamp, anonymous_id string, path string, character_id string, jump_id string, channel string, request_id string, success boolean, seq long, accepted timestamp"


def fact(n, kind, at, app="game", who="u", **more):
    row = dict.fromkeys(x.split()[0] for x in FACT.split(", "))
    row |= {"source": "real", "app": app, "event_id": f"e{n:03d}", "event_type": kind, "event_time": at, "anonymous_id": who, "seq": n, "accepted": at} | more
    return tuple(row.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, FACT)


def test_session_boundaries(spark):
    at = [timedelta(0), timedelta(seconds=1799), timedelta(seconds=1799 + 1800), timedelta(seconds=1799 + 3599, milliseconds=999)]
    rows = frame(spark, [fact(n, "page_view", T0 + t) for n, t in enumerate(at)])
    found = sorted((r.events, r.duration_seconds, r.closed) for r in sessions.sessions(rows, T0 + timedelta(hours=1, minutes=59, seconds=58, milliseconds=999)).collect())
    assert found == [(2, 1799.0, True), (2, 1799.999, True)]
    assert not any(r.closed for r in sessions.sessions(rows.where("seq >= 2"), T0 + timedelta(hours=1, minutes=59, seconds=58, milliseconds=998)).collect())


def test_session_belongs_to_its_first_day(spark):
    late = datetime(2026, 1, 2, 15, 50, tzinfo=UTC)  # 23:50 in Hong Kong
    rows = frame(spark, [fact(1, "page_view", late), fact(2, "page_view", late + timedelta(minutes=20))])
    r = sessions.sessions(rows, late + timedelta(days=1)).collect()
    assert [(x.date, x.events) for x in r] == [(date(2026, 1, 2), 2)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 200)), max_size=30))
def test_sessions_match_a_loop(spark, events):
    rows = [fact(n, "page_view", T0 + timedelta(minutes=5 * t), who=f"u{u}") for n, (u, t) in enumerate(events)]
    want = []
    for u in range(3):
        last = None
        for t in sorted(t for v, t in events if v == u):
            if last is None or t - last >= 6:
                want.append([u, t, t, 0])
            want[-1][2:] = [t, want[-1][3] + 1]
            last = t
    got = sessions.sessions(frame(spark, rows), T0 + timedelta(days=30)).collect()
    assert sorted((f"u{u}", T0 + timedelta(minutes=5 * a), n) for u, a, _, n in want) == sorted((r.anonymous_id, r.start.replace(tzinfo=UTC), r.events) for r in got)


def test_retention_maturity(spark):
    rows = frame(spark, [fact(1, "page_view", T0), fact(2, "page_view", T0 + timedelta(days=1)), fact(3, "page_view", T0, who="v"), fact(4, "page_view", T0 + timedelta(days=4), who="w")])
    found = {r.cohort_date.day: r for r in retention.retention(rows, T0 + timedelta(days=5)).collect()}
    assert (found[2].users, found[2].eligible_d1, found[2].retained_d1, found[2].eligible_d7, found[2].retained_d7) == (2, 2, 1, 0, None)
    assert (found[6].eligible_d1, found[6].retained_d1) == (0, None)


def test_observation_status():
    start, cutoff = datetime(2026, 1, 1, tzinfo=UTC), datetime(2026, 1, 10, tzinfo=UTC)
    status = lambda day, gaps=(): retention.observation_status(date(2026, 1, day), 1, cutoff, start, list(gaps), start)
    assert status(9) == "pending" and status(8) == "complete_accepted_prefix" and status(1) == "incomplete"
    assert status(5, [(datetime(2026, 1, 6, tzinfo=UTC), datetime(2026, 1, 6, 1, tzinfo=UTC))]) == "incomplete"
    assert status(5, [(datetime(2026, 1, 2, tzinfo=UTC), datetime(2026, 1, 3, tzinfo=UTC))]) == "complete_accepted_prefix"
    assert retention.retained_from(start, cutoff) == cutoff - timedelta(days=7)


def journey(n, click, done, request="r", success=True, jump=None):
    jump = jump or f"j{n}"
    return [
        fact(10 * n, "entry_click", click, "site", jump_id=jump, channel="home"),
        fact(10 * n + 1, "entry_arrival", click + timedelta(seconds=10), jump_id=jump),
        fact(10 * n + 2, "request_observed", click + timedelta(seconds=20), request_id=request),
        fact(10 * n + 3, "request_complete", done, who=None, request_id=request, success=success),
    ]


def converted(spark, rows):
    parts = attribution.steps(frame(spark, rows))
    found = attribution.conversions(parts)
    funnel = attribution.funnel(parts, found)
    assert attribution.broken(funnel).isEmpty()
    return {(r.jump_id, r.request_id) for r in found.collect()}, funnel.collect()


def test_conversion_limit_is_inclusive(spark):
    half = timedelta(minutes=30)
    assert converted(spark, journey(1, T0, T0 + half))[0] == {("j1", "r")}
    got, funnel = converted(spark, journey(1, T0, T0 + half + timedelta(milliseconds=1)))
    assert got == set() and [(r.clicks, r.arrived, r.selected, r.requested, r.converted) for r in funnel] == [(1, 1, 0, 1, 0)]
    assert converted(spark, journey(1, T0, T0 + half, success=False))[0] == set()


def test_last_click_wins_without_fallback(spark):
    late = T0 + timedelta(minutes=5)
    rows = journey(1, T0, T0 + timedelta(minutes=8), "r1") + journey(2, late, T0 + timedelta(minutes=7), "r2")
    # Both requests are observed after both arrivals, so each may go to either click: both go to the last.
    rows = [r if r[3] != "request_observed" else fact(100 + i, "request_observed", T0 + timedelta(minutes=6), request_id=r[10]) for i, r in enumerate(rows)]
    assert converted(spark, rows)[0] == {("j2", "r2")}


CHANGE = "source string, table string, key string, at timestamp, version long, op string, after struct<title:string,category:string,status:string>, kafka_topic string, kafka_partition long, kafka_offset long"


def change(key, hours, status, version=None, op="u"):
    v = hours if version is None else version
    return ("s", "tickets", key, T0 + timedelta(hours=hours), v, op, None if op == "d" else (None, "c", status), "t", 0, v)


def test_versions_and_lookup(spark):
    log = spark.createDataFrame([change("a", 0, "open", 1), change("a", 0, "resolved", 2), change("a", 5, None, 3, "d"), change("b", 1, "open", 4)], CHANGE)
    v = history.scd2(log)
    assert sorted((r.key, r.version, r.deleted, r.valid_to is None) for r in v.collect()) == [("a", 2, False, False), ("a", 3, True, True), ("b", 4, False, True)]
    assert [r.key for r in history.at_instant(v).collect()] == ["b"]
    asked = spark.createDataFrame([("a", T0), ("a", T0 + timedelta(hours=5)), ("a", T0 - timedelta(hours=1))], "key string, t timestamp")
    assert sorted(str(r.version) for r in history.point_lookup(asked, v, "t", ("key",)).collect()) == ["2", "None", "None"]


def test_rounds(spark):
    log = spark.createDataFrame([change("a", h, s) for h, s in ((0, "open"), (1, "resolved"), (2, "open"), (3, "open"), (4, "resolved"))] + [change("x", 0, "resolved"), change("x", 1, "open")], CHANGE)
    got = sorted((r.key, r.round, r.duration_seconds) for r in history.rounds(log).collect())
    assert got == [("a", 1, 3600.0), ("a", 2, 7200.0), ("x", 1, None)]
    assert history.stray_changes(log).count() == 1


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 200), st.booleans()), min_size=1, max_size=15, unique_by=lambda x: (x[0], x[1])))
def test_daily_state_matches_a_loop(spark, changes):
    log = spark.createDataFrame([change(k, h, "open", n, "d" if gone else "u") for n, (k, h, gone) in enumerate(changes)], CHANGE)
    start, end = date(2026, 1, 3), date(2026, 1, 9)
    want = set()
    for d in range(7):
        day = start + timedelta(days=d)
        for key in "ab":
            held = [(h, n) for n, (k, h, _) in enumerate(changes) if k == key and (T0 + timedelta(hours=h + 8)).date() <= day]
            if held:
                want.add((key, day, max(held)[1]))
    assert {(r.key, r.day, r.version) for r in history.daily_state(log, start, end).collect()} == want


def test_public_states(spark):
    day = [fact(n, "page_view", T0, "site", f"u{n}", path="/a") for n in range(10)]
    few = [fact(100 + n, "page_view", T0, "game", f"u{n}", path="/a") for n in range(9)]
    done = [fact(200 + n, "request_complete", T0, who=None, request_id=f"r{n}", success=n > 0) for n in range(20)]
    late = [fact(300, "page_view", T0, "site", "late", path="/a", accepted=datetime(2026, 1, 4, 16, 15, tzinfo=UTC))]
    rows = frame(spark, day + few + done + late)
    made = public.projection(rows, datetime(2026, 1, 6, tzinfo=UTC))
    got = {r.app: (r.access, r.quality, r.popularity, r.uv) for r in made.collect()}
    assert got == {"site": ("published", "empty", "published", 10), "game": ("suppressed", "suppressed", "suppressed", None)}
    assert {r.access for r in public.projection(rows, datetime(2026, 1, 4, tzinfo=UTC)).collect()} == {"pending"}
    frozen = made.where("app = 'site'")
    again = public.freeze(frozen, public.projection(rows.where("seq < 5 OR seq >= 100"), datetime(2026, 1, 6, tzinfo=UTC)))
    assert {r.app: r.access for r in again.collect()} == {"site": "published", "game": "suppressed"}


def test_quantiles_and_gaps(spark):
    q = metrics.quantiles(spark.range(1, 101), "id", 100).first()
    assert (q.p50, q.p95, q.p99, q.max, q.complete) == (50, 95, 99, 100, True)
    rows = spark.createDataFrame([(x,) for x in (1, 2, 5, 6, 11)], "seq long")
    for width in (1, 3, 100):
        assert sorted(tuple(r) for r in metrics.gaps(rows, "seq", width).collect()) == [(2, 5), (6, 11)]


def test_strategies_agree(spark):
    left = spark.createDataFrame([(0,)] * 500 + [(n % 7,) for n in range(100)], "k int")
    right = spark.createDataFrame([(n, f"c{n}") for n in range(5)], "k int, c string")
    frames = [joins.join(left, right, ["k"], s) for s in ("auto", "merge", "broadcast", "salted")]
    assert all(joins.same_rows(frames[0], f) for f in frames[1:])
    assert not joins.same_rows(left, left.limit(599))
