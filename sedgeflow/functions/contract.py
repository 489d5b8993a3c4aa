"""The event contract as one Boolean expression tree over nullable columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeflow.functions.time import instant

# Fixed values of the contract.
#: The site where entries are clicked, and the application that they lead to; callers name their own.
APPS = ("site", "game")
SOURCES = ("real", "synthetic")
KINDS = {  # kind: (which of the apps, required fields, further fields)
    "page_view": ((0, 1), ("path",), ("anonymous_id", "session_id")),
    "character_select": ((1,), ("character_id",), ("anonymous_id", "session_id", "path")),
    "entry_click": ((0,), ("jump_id", "channel"), ("anonymous_id", "session_id", "path")),
    "entry_arrival": ((1,), ("jump_id",), ("anonymous_id", "session_id", "path")),
    "request_observed": ((1,), ("request_id",), ("anonymous_id", "session_id", "path")),
    "request_complete": ((1,), ("request_id", "character_id", "success", "elapsed_ms"), ()),
}
COMMON = ("schema_version", "event_id", "app", "event_type", "occurred_at")
FIELDS = (*COMMON, "anonymous_id", "session_id", "path", "character_id", "jump_id", "channel", "request_id", "success", "elapsed_ms")
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
IDENTIFIER = r"^[A-Za-z0-9_-]{1,64}$"
MAX_PATH, MAX_ELAPSED = 200, 86_400_000

EVENT = T.StructType(
    [
        T.StructField("schema_version", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in FIELDS[1:12]],
        T.StructField("success", T.BooleanType()),
        T.StructField("elapsed_ms", T.LongType()),
    ]
)
ENVELOPE = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("source", T.StringType()), T.StructField("accepted_at", T.StringType()), T.StructField("event", EVENT)]
)
CHANGE = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("source", "table", "key", "at")],
        T.StructField("version", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("after", T.StructType([T.StructField(n, T.StringType()) for n in ("title", "category", "status")])),
        T.StructField("transaction", T.StringType()),
        T.StructField("source_position", T.StringType()),
        T.StructField("kafka_topic", T.StringType()),
        T.StructField("kafka_partition", T.LongType()),
        T.StructField("kafka_offset", T.LongType()),
    ]
)


def _shapes() -> dict[str, Column]:
    """What holds for each field that is there; absent fields pass."""
    path = F.col("path")
    return {
        **{n: F.col(n).rlike(UUID) for n in ("event_id", "anonymous_id", "session_id", "jump_id")},
        **{n: F.col(n).rlike(IDENTIFIER) for n in ("character_id", "channel", "request_id")},
        "path": path.startswith("/") & (F.length(path) <= MAX_PATH) & ~path.rlike("[?#]"),
        "elapsed_ms": F.col("elapsed_ms").between(0, MAX_ELAPSED),
    }


def valid_event(apps: tuple[str, str] = APPS) -> Column:
    """True for rows whose event columns keep the contract; never null."""
    kinds = F.lit(False)
    for name, (which, required, more) in KINDS.items():
        absent = [f for f in FIELDS if f not in (*COMMON, *required, *more)]
        rule = (F.col("event_type") == name) & F.col("app").isin(*[apps[k] for k in which])
        for f in required:
            rule &= F.col(f).isNotNull()
        for f in absent:
            rule &= F.col(f).isNull()
        kinds |= rule
    ok = (F.col("schema_version") == 1) & F.col("event_id").isNotNull() & instant(F.col("occurred_at")).isNotNull() & kinds
    for name, shape in _shapes().items():
        ok &= F.col(name).isNull() | shape
    return F.coalesce(ok, F.lit(False))


def valid_envelope(source: str, corrupt: str | None = "_corrupt_record", apps: tuple[str, str] = APPS) -> Column:
    ok = (F.col("source") == source) & (F.col("seq") > 0) & instant(F.col("accepted_at")).isNotNull() & valid_event(apps)
    if corrupt:
        ok &= F.col(corrupt).isNull()
    return F.coalesce(ok, F.lit(False))


def known_fields(event_json: Column) -> Column:
    """False if it is no object, or the event's raw JSON has a field that the contract doesn't name."""
    extra = F.array_except(F.json_object_keys(event_json), F.array(*map(F.lit, FIELDS)))
    return F.coalesce(F.size(extra) == 0, F.lit(False))


def business_key(kind: Column, request_id: Column, event_id: Column) -> Column:
    """What is counted once: a request's completion, else the event. Never null for valid rows."""
    return F.when((kind == "request_complete") & request_id.isNotNull(), F.concat(F.lit("request:"), request_id)).otherwise(F.concat(F.lit("event:"), event_id))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the canonical JSON: sorted keys, nulls left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def sequence_version(seq: Column) -> Column:
    """Greater for smaller seq, for stores that keep the greatest version."""
    return F.lit((1 << 63) - 1) - seq


def allowed_values(paths: list[str] | None = None, characters: list[str] | None = None) -> Column:
    """False where a path or character isn't in its list; absent fields pass, a list of None allows all."""
    ok = F.lit(True)
    for column, allowed in (("path", paths), ("character_id", characters)):
        if allowed is not None:
            ok &= F.col(column).isNull() | F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return ok


def retained(accepted: Column, readable_from: Column, not_after: Column, now: Column, days: int = 7) -> Column:
    """Whether a real event may be read: now is before not_after, which is at most `days` after
    readable_from, and the event was accepted since readable_from, not in the future, and less than
    `days` ago."""
    span = F.expr(f"INTERVAL {days} DAYS")
    window = (now < not_after) & (not_after <= readable_from + span)
    return F.coalesce(window & (accepted >= readable_from) & (accepted <= now) & (accepted + span > now), F.lit(False))


def accepted_now(occurred: Column, now: Column, days: int = 7, minutes: int = 5) -> Column:
    """The collector's window around its clock."""
    return F.coalesce(occurred.between(now - F.expr(f"INTERVAL {days} DAYS"), now + F.expr(f"INTERVAL {minutes} MINUTES")), F.lit(False))
