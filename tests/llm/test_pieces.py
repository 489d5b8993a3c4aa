"""Revisits of one url, cut into pieces by rows."""

import random

import pytest

from sedgeflow.llm import revisits


@pytest.mark.parametrize("span", [3, 40])
def test_any_cut_gives_the_same(spark, span):
    r = random.Random(span)
    rows = []
    for n in range(160):
        kind = r.choice(["response", "revisit"])
        at = r.choice([None, 5, 5, 5, 6, r.randrange(60)])
        rows.append((n, kind, r.choice(["http://a.com/", "http://a.com", "http://b.com"]), at, 304 if kind == "revisit" else 200, {}, str(n) if kind == "response" else None))
    found = revisits.resolve_revisits(spark.createDataFrame(rows, revisits.RECORD), span=span).collect()
    when = lambda x: -1 if x[3] is None else x[3]
    host = lambda x: x[2].rstrip("/")
    want = {}
    for x in rows:
        full = [(when(y), y[0]) for y in rows if y[1] == "response" and host(y) == host(x) and when(y) < when(x)]
        want[x[0]] = max(full)[1] if x[1] == "revisit" and full else None
    assert {x.record_id: x.source_id for x in found} == want and len(found) == len(rows)


def test_a_hot_week_is_cut(spark, monkeypatch):
    """All captures of one url within a second: no task orders them all."""
    seen = []
    held = revisits.stage
    monkeypatch.setattr(revisits, "stage", lambda df, path, *a: seen.append((path, held(df, path, *a))) or seen[-1][1])
    rows = [(n, "revisit", "http://a.com", None, 304, {}, None) for n in range(400)] + [(1000 + n, "response", "http://a.com", None, 200, {}, "x") for n in range(400)]
    revisits.resolve_revisits(spark.createDataFrame(rows, revisits.RECORD), span=100).count()
    pieces = next((df for path, df in seen if path.endswith("/pieces")), None)
    assert pieces is not None and max(x["count"] for x in pieces.groupBy("canonical", "piece").count().collect()) < 300
