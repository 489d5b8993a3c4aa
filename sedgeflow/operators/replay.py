"""History replay: events in the order in which they happened, if that changes no winner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("source", "app", "business_key")


def changed_winners(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Keys whose first row by event time isn't their first by acceptance. One aggregation."""
    first = rows.groupBy(*keys).agg(F.min_by("seq", F.struct("event_time", "seq")).alias("by_time"), F.min_by("seq", F.struct("accepted", "seq")).alias("by_acceptance"))
    return first.where("by_time <> by_acceptance")


def replay_order(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """rows, globally sorted by event time, for a stream that must not see them late."""
    if not changed_winners(rows, keys).isEmpty():
        raise ValueError("the order would change which row of a key wins")
    return rows.orderBy("event_time", "seq")
