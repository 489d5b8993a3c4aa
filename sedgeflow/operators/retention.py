"""Retention of first-observed cohorts, by mature days and by proven coverage."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeflow.functions.time import aware, business_date, closed_day, day_start, utc

KEYS = ("source", "app", "anonymous_id")
LAGS = (1, 7)


def cohorts(facts: DataFrame, cutoff: datetime, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """One row for each identity: cohort_date and returned_dN. One aggregation to active days, then
    one over them by the same key: the days aren't joined with themselves."""
    days = facts.where(F.col("anonymous_id").isNotNull() & (F.col("event_time") <= utc(cutoff))).select(*KEYS, business_date(F.col("event_time")).alias("day"))
    active = days.where(F.col("day") <= F.lit(closed_day(cutoff))).groupBy(*KEYS).agg(F.min("day").alias("cohort_date"), F.collect_set("day").alias("days"))
    returned = [F.array_contains("days", F.date_add("cohort_date", n)).alias(f"returned_d{n}") for n in lags]
    return active.select(*KEYS, "cohort_date", *returned)


def retention(facts: DataFrame, cutoff: datetime, lags: tuple[int, ...] = LAGS, date_from: date | None = None, date_to: date | None = None) -> DataFrame:
    """source, app, cohort_date, users, eligible_dN, retained_dN. Before cohort_date + N is a closed
    day, eligible is 0 and retained null."""
    closed = F.lit(closed_day(cutoff))
    out = cohorts(facts, cutoff, lags).groupBy("source", "app", "cohort_date").agg(F.count(F.lit(1)).alias("users"), *[F.count_if(f"returned_d{n}").alias(f"_{n}") for n in lags])
    cols = ["source", "app", "cohort_date", "users"]
    for n in lags:
        mature = F.date_add("cohort_date", n) <= closed
        cols += [F.when(mature, F.col("users")).otherwise(0).alias(f"eligible_d{n}"), F.when(mature, F.col(f"_{n}")).alias(f"retained_d{n}")]
    out = out.select(*cols)
    return out.where(F.col("cohort_date").between(F.lit(date_from), F.lit(date_to))) if date_from and date_to else out


def observation_status(cohort: date, lag: int, cutoff: datetime, continuous_from: datetime, gaps: list[tuple[datetime, datetime]], retained_from: datetime) -> str:
    """pending, incomplete or complete_accepted_prefix."""
    cutoff = aware(cutoff)
    if day_start(cohort + timedelta(days=lag + 1)) > cutoff:
        return "pending"
    start = day_start(cohort)
    if start < max(aware(continuous_from), aware(retained_from)) or any(aware(a) < cutoff and aware(b) >= start for a, b in gaps):
        return "incomplete"
    return "complete_accepted_prefix"


def retained_from(continuous_from: datetime, now: datetime, previous: datetime | None = None) -> datetime:
    now = aware(now)
    return max(aware(continuous_from), now - timedelta(days=30), aware(previous) if previous else now - timedelta(days=7))


def covered_retention(facts: DataFrame, cutoff: datetime, continuous_from: datetime, gaps: list[tuple[datetime, datetime]], kept_from: datetime, days: list[date], lags: tuple[int, ...] = LAGS) -> DataFrame:
    """Retention of the cohorts of `days` (a report window's), with status_dN; only complete ones count."""
    spark = facts.sparkSession
    table = [(d, *[observation_status(d, n, cutoff, continuous_from, gaps, kept_from) for n in lags]) for d in days]
    status = spark.createDataFrame(table, "cohort_date date, " + ", ".join(f"status_d{n} string" for n in lags))
    found = cohorts(facts, cutoff, lags).groupBy("source", "app", "cohort_date").agg(F.count(F.lit(1)).alias("users"), *[F.count_if(f"returned_d{n}").alias(f"_{n}") for n in lags])
    joined = found.join(F.broadcast(status), "cohort_date")  # at most 366 rows
    cols = ["source", "app", "cohort_date", "users"]
    for n in lags:
        done = F.col(f"status_d{n}") == "complete_accepted_prefix"
        cols += [f"status_d{n}", F.when(done, F.col("users")).otherwise(0).alias(f"eligible_d{n}"), F.when(done, F.col(f"_{n}")).alias(f"retained_d{n}")]
    return joined.select(*cols)


def rate(retained: str, eligible: str):
    """Retained by eligible, else immature."""
    return F.when(F.col(eligible) > 0, F.round(F.col(retained) / F.col(eligible), 6).cast("string")).otherwise("immature")



