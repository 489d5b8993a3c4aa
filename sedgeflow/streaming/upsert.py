"""Keyed tables fed by streams: of each business key the lowest sequence number stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("source", "app", "business_key")


def lowest_sequence(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(F.struct(*rows.columns), "seq").alias("r")).select("r.*")


def overlay(realtime: DataFrame, corrected: DataFrame, keys: tuple[str, ...] = ("source", "app", "business_date")) -> DataFrame:
    """Daily rows: of each key that with the greatest business_version; a correction over the stream."""
    both = realtime.unionByName(corrected)
    return both.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(F.struct(*both.columns), "business_version").alias("r")).select("r.*")


def sink(table, keys: tuple[str, ...] = KEYS):
    """For foreachBatch: appends a batch to a versioned table, which keeps the lowest sequence number of
    each key when it is read. So a batch costs its own rows and none of the table's; compaction
    drops what lost. A batch that comes again changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        new = lowest_sequence(batch, keys)
        if not new.isEmpty():
            table.append(new, lowest=(list(keys), "seq"))

    return write
