"""Joins by strategy; the results don't depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Greatest size (Catalyst's estimate) of a side that is broadcast on request.
BROADCAST_BYTES = 64 << 20
SALTS = 16


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join(left: DataFrame, right: DataFrame, keys: list[str], strategy: str = "auto", how: str = "inner", salts: int = SALTS) -> DataFrame:
    """strategy is auto, merge, broadcast (if the right side's estimated size allows, else auto) or
    salted (inner joins: rows of the left are dealt over salts, those of the right repeated)."""
    if strategy == "merge":
        return left.join(right.hint("merge"), keys, how)
    if strategy == "broadcast":
        small = estimated_bytes(right) <= BROADCAST_BYTES
        return left.join(F.broadcast(right) if small else right, keys, how)
    if strategy == "salted":
        if how != "inner":
            raise ValueError("salted joins are inner joins")
        dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
        spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return dealt.join(spread.hint("merge"), [*keys, "_salt"], how).drop("_salt")
    return left.join(right, keys, how)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equality as multisets of rows."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows by which the multisets differ, with surplus: how many more a has. One aggregation."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_n")).union(b.select(*cols, F.lit(-1).alias("_n")))
    return both.groupBy(*cols).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")


def page(rows: DataFrame, after: int, limit: int, key: str = "seq", most: int = 500) -> DataFrame:
    """Keyset page: the next rows after a key."""
    if not 0 < limit <= most:
        raise ValueError(f"limit is 1 to {most}")
    return rows.where(F.col(key) > after).orderBy(key).limit(limit)


def bounded_rows(rows: DataFrame, most: int) -> list:
    """All rows on the driver, or an error if there are more than `most`."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    return found
