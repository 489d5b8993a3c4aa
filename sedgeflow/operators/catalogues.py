"""What an application may publish: its snapshot of pages and characters, and the metrics' dictionary."""

from __future__ import annotations

import hashlib
import json
import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from sedgeflow.functions.time import aware

STAGES = ("candidate", "published")
SHA = re.compile(r"[a-f0-9]{40}")
IDENTIFIER = re.compile(r"[A-Za-z0-9_-]{1,64}")

#: metric, grain, definition.
METRICS = (
    ("pv", "source, app, business date", "page views, each event counted once"),
    ("uv", "source, app, business date", "distinct visitors with an id; days don't add up"),
    ("requests", "source, app, business date", "completed requests, the first accepted of each request id"),
    ("successes", "source, app, business date", "completed requests that succeeded"),
    ("success_rate", "source, app, business date", "successes by requests; null without requests"),
    ("character_popularity", "source, app, business date, character", "selections of a character"),
    ("conversion", "source, channel, business date of the click", "clicks that led to a successful request within the limit, the last click of each request, once a click"),
    ("sessions", "source, app, business date of the start", "runs of events without a gap of the limit or more"),
    ("retained", "source, app, cohort date", "visitors of the first day that came back on the Nth; null before that day is over"),
)


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METRICS), "metric string, grain string, definition string")


def snapshot(stage: str, apps: dict[str, dict], now: datetime) -> dict:
    """A validated catalogue, named by its content. apps: release_sha, release_at (text with a zone, None
    for a candidate), origin, paths, characters of each application."""
    if stage not in STAGES:
        raise ValueError(f"{stage} is none of {STAGES}")
    held = {}
    for app, data in apps.items():
        if set(data) != {"release_sha", "release_at", "origin", "paths", "characters"}:
            raise ValueError(f"{app}: other fields")
        if not SHA.fullmatch(data["release_sha"] or ""):
            raise ValueError(f"{app}: no whole release hash")
        at = data["release_at"]
        if (at is None) != (stage == "candidate") or (at and aware(datetime.fromisoformat(at)) > aware(now)):
            raise ValueError(f"{app}: a published release has a time that has come, a candidate none")
        paths, characters = (list(data[k]) for k in ("paths", "characters"))
        if not paths or len(set(paths)) < len(paths) or len(set(characters)) < len(characters):
            raise ValueError(f"{app}: no pages, or some stand twice")
        if not all(p.startswith("/") and "//" not in p and not re.search("[?#]", p) and not {".", ".."} & set(p.split("/")) for p in paths):
            raise ValueError(f"{app}: a page is no plain path")
        if not all(map(IDENTIFIER.fullmatch, characters)):
            raise ValueError(f"{app}: a character is no identifier")
        body = {"origin": data["origin"], "paths": sorted(paths), "characters": sorted(characters)}
        held[app] = body | {"release_sha": data["release_sha"], "release_at": at, "content": _digest(body)}
    body = {"stage": stage, "apps": held}
    return body | {"snapshot_id": _digest(body)}


def _digest(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def check(made: dict) -> None:
    """Raises if a snapshot's content isn't what its names say."""
    body = {k: made[k] for k in ("stage", "apps")}
    parts = all(a["content"] == _digest({k: a[k] for k in ("origin", "paths", "characters")}) for a in made["apps"].values())
    if not parts or _digest(body) != made["snapshot_id"]:
        raise ValueError("the content has changed")


def entries(spark: SparkSession, made: dict) -> DataFrame:
    """app, kind, key of all that a snapshot names, for allowlists and dimensions."""
    rows = [(app, kind, key) for app, a in made["apps"].items() for kind, keys in (("page", a["paths"]), ("character", a["characters"])) for key in keys]
    return spark.createDataFrame(rows, "app string, kind string, key string")
