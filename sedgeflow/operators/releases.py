"""Paired model releases: both packages from one frozen input, invariants, one pointer."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeflow.operators.attribution import broken
from sedgeflow.sources.shared import exists, read_text, write_text

#: Most aggregate rows of a package.
MOST_ROWS = 10_000


def retention_faults(rows: DataFrame, lags: tuple[int, ...] = (1, 7)) -> DataFrame:
    """Rows that break maturity: eligible is 0 with null retained, or all users with no more retained."""
    bad = F.lit(False)
    for n in lags:
        e, r = F.col(f"eligible_d{n}"), F.col(f"retained_d{n}")
        bad |= ~F.coalesce(((e == 0) & r.isNull()) | ((e == F.col("users")) & r.isNotNull() & (r <= e)), F.lit(False))
    return rows.where(bad)


def unreconciled(detail: DataFrame, sums: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose aggregate isn't the number of detail rows; none is right."""
    counted = detail.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("v"))
    given = sums.groupBy(*keys).agg(F.lit(0).cast("long").alias("n"), F.sum(value).cast("long").alias("v"))
    return counted.unionByName(given).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).where("n <> v")


def package(tables: dict[str, DataFrame], input_id: str, window: tuple[str, str]) -> dict:
    """The tables' rows as canonical JSON lines with the input and window that they come from."""
    out = {"input": input_id, "window": list(window), "tables": {}}
    for name, df in sorted(tables.items()):
        lines = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("j")).limit(MOST_ROWS + 1).collect()
        if len(lines) > MOST_ROWS:
            raise ValueError(f"{name} has more than {MOST_ROWS} rows")
        out["tables"][name] = sorted(r.j for r in lines)
    return out


def release(spark: SparkSession, path: str, behavior: dict, operations: dict, funnel: DataFrame, retention: DataFrame) -> str:
    """Publishes both packages at once; returns the content's id. The pointer is written last."""
    if (behavior["input"], behavior["window"]) != (operations["input"], operations["window"]):
        raise ValueError("the packages come from another input or window")
    if not broken(funnel).isEmpty() or not retention_faults(retention).isEmpty():
        raise ValueError("an invariant is broken")
    body = json.dumps({"behavior": behavior, "operations": operations}, sort_keys=True)
    name = hashlib.sha256(body.encode()).hexdigest()
    at = f"{path}/{name}.json"
    if not exists(spark, at):
        write_text(spark, at, body, replace=False)
    if read_text(spark, at) != body:
        raise ValueError("what was written differs")
    write_text(spark, f"{path}/latest.json", json.dumps({"release": name}))
    return name
