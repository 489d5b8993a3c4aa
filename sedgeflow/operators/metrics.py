"""Daily activity, popularity, freshness, contiguity and checksums."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeflow.functions.time import business_date


def daily(facts: DataFrame, date_from: date | None = None, date_to: date | None = None) -> DataFrame:
    """source, app, business_date, pv, uv, requests, successes.

    A stored business_date is used if there is one, so that the filter prunes partitions."""
    day = F.col("business_date") if "business_date" in facts.columns else business_date(F.col("event_time"))
    rows = facts.select("source", "app", "event_type", "anonymous_id", "success", day.alias("business_date"))
    if date_from and date_to:
        rows = rows.where(F.col("business_date").between(F.lit(date_from), F.lit(date_to)))
    done = F.col("event_type") == "request_complete"
    return rows.groupBy("source", "app", "business_date").agg(
        F.count_if(F.col("event_type") == "page_view").alias("pv"),
        F.countDistinct("anonymous_id").alias("uv"),
        F.count_if(done).alias("requests"),
        F.count_if(done & F.col("success")).alias("successes"),
    )


def gate(daily_rows: DataFrame) -> DataFrame:
    """Rows that break the invariants of daily(); none is right."""
    return daily_rows.where("pv < 0 OR uv < 0 OR successes < 0 OR requests < successes OR pv IS NULL OR uv IS NULL")


def success_rate(successes: Column, requests: Column) -> Column:
    """Null without requests."""
    return F.try_divide(successes, requests)


def popularity(facts: DataFrame) -> DataFrame:
    """source, app, business_date, kind, name, n, visitors: page views by path, selections by character."""
    kind = F.when(F.col("event_type") == "page_view", "page").when(F.col("event_type") == "character_select", "character")
    name = F.when(F.col("event_type") == "page_view", F.col("path")).otherwise(F.col("character_id"))
    rows = facts.select("source", "app", business_date(F.col("event_time")).alias("business_date"), kind.alias("kind"), name.alias("name"), "anonymous_id")
    rows = rows.where("kind IS NOT NULL AND name IS NOT NULL")
    return rows.groupBy("source", "app", "business_date", "kind", "name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("anonymous_id").alias("visitors"))


def increments(facts: DataFrame, cursor: int) -> DataFrame:
    """What rows after a cursor add: (source, app, business_date, event_type, n, last_seq)."""
    rows = facts.where(F.col("seq") > cursor).withColumn("business_date", business_date(F.col("event_time")))
    return rows.groupBy("source", "app", "business_date", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


def checksum(rows: DataFrame, number: str, text: str) -> DataFrame:
    """One row: rows, total (of number), chars (of text)."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(number).alias("total"), F.sum(F.length(text)).alias("chars"))


def partition_histogram(rows: DataFrame) -> DataFrame:
    """Rows of each partition of the DataFrame as it stands."""
    return rows.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def gaps(rows: DataFrame, seq: str, width: int = 1 << 16) -> DataFrame:
    """after, before: neighbours between which numbers are missing.

    Numbers are dealt into ranges of `width`; each range is ordered by itself and the ranges'
    edges, one row a range, are compared last, in one task: a million rows for 65 billion numbers."""
    held = rows.select(F.col(seq).alias("s"), F.floor(F.col(seq) / width).alias("r")).distinct()
    inner = held.withColumn("p", F.lag("s").over(Window.partitionBy("r").orderBy("s"))).where("s - p > 1").select(F.col("p").alias("after"), F.col("s").alias("before"))
    edges = held.groupBy("r").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    outer = edges.withColumn("p", F.lag("hi").over(Window.orderBy("r"))).where("lo - p > 1").select(F.col("p").alias("after"), F.col("lo").alias("before"))
    return inner.unionByName(outer)


def quantiles(samples: DataFrame, value: str, expected: int | None = None, ranges: int | None = None) -> DataFrame:
    """One row: n, p50, p95, p99, max by nearest rank; complete says if n is what was expected.

    The values are dealt into ranges, whose counts say which range holds a rank; only that range's
    values are counted one by one, so no task holds more than a range. A row for each range reaches
    the driver."""
    spark = samples.sparkSession
    held = samples.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    kind = held.schema["v"].dataType.simpleString()
    dealt = held.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), "v").groupBy(F.spark_partition_id().alias("piece"))
    pieces = dealt.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("piece").collect()
    n, found = sum(p["n"] for p in pieces), []
    for q in (50, 95, 99):
        rank, before = -(-q * n // 100), 0
        for p in pieces:
            if rank <= before + p["n"]:
                counts = held.where(F.col("v").between(p["lo"], p["hi"])).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
                upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
                found.append(upto.where(F.col("upto") >= rank - before).agg(F.min("v")).first()[0])
                break
            before += p["n"]
        else:
            found.append(None)
    top = pieces[-1]["hi"] if pieces else None
    return spark.createDataFrame([(n, *found, top, expected is None or n == expected)], f"n long, p50 {kind}, p95 {kind}, p99 {kind}, max {kind}, complete boolean")


def duplicate_grains(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has; none is right."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
