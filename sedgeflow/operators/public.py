"""Public projection: thresholds, freezing, retention of what is kept."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeflow.functions.contract import APPS
from sedgeflow.functions.time import HK, aware, business_date

THRESHOLD = 10
DAYS_KEPT = 90


def cutoff_of(day: Column) -> Column:
    """00:15 in Hong Kong three days after the day, as a UTC timestamp."""
    return F.to_utc_timestamp(F.date_add(day, 3).cast("timestamp") + F.expr("INTERVAL 15 MINUTES"), "Asia/Hong_Kong")


def slot(now: datetime) -> datetime:
    """The latest 00:15 in Hong Kong."""
    local = aware(now).astimezone(HK)
    at = local.replace(hour=0, minute=15, second=0, microsecond=0)
    return at if at <= local else at - timedelta(days=1)


def access_state(pv: Column, uv: Column, k: int = THRESHOLD) -> Column:
    return F.when((pv == 0) & (uv == 0), "empty").when(uv >= k, "published").otherwise("suppressed")


def quality_state(requests: Column, successes: Column, k: int = THRESHOLD) -> Column:
    failures = requests - successes
    safe = (requests >= k) & ((successes == 0) | (successes >= k)) & ((failures == 0) | (failures >= k))
    return F.when(requests == 0, "empty").when(safe, "published").otherwise("suppressed")


def projection(facts: DataFrame, now: datetime, start_day=None, k: int = THRESHOLD) -> DataFrame:
    """app, date, cutoff_at, and the states of access, quality and popularity with the values that
    may be shown. Only source real; rows accepted at a day's cutoff or later are left out; days whose
    cutoff hasn't come are pending. The least distinct visitors of any category decide popularity."""
    day = business_date(F.col("event_time"))
    rows = facts.where(F.col("source") == "real").withColumn("date", day)
    if start_day:
        rows = rows.where(F.col("date") >= F.lit(start_day))
    rows = rows.withColumn("cutoff_at", cutoff_of(F.col("date"))).where(F.col("accepted") < F.col("cutoff_at"))
    done = F.col("event_type") == "request_complete"
    visitor = F.when(~done, F.col("anonymous_id"))
    base = rows.groupBy("app", "date", "cutoff_at").agg(F.count_if(F.col("event_type") == "page_view").alias("pv"), F.countDistinct(visitor).alias("uv"), F.count_if(done).alias("requests"), F.count_if(done & F.col("success")).alias("successes"))
    kind = F.when(F.col("event_type") == "page_view", F.concat(F.lit("page:"), "path")).when(F.col("event_type") == "character_select", F.concat(F.lit("character:"), "character_id"))
    cats = rows.withColumn("category", kind).where("category IS NOT NULL").groupBy("app", "date", "category").agg(F.countDistinct("anonymous_id").alias("v"))
    least = cats.groupBy("app", "date").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("categories"))
    both = base.join(least, ["app", "date"], "left")
    pending = F.col("cutoff_at") > F.lit(slot(now))
    states = {
        "access": access_state(F.col("pv"), F.col("uv"), k),
        "quality": quality_state(F.col("requests"), F.col("successes"), k),
        "popularity": F.when(F.col("categories").isNull(), "empty").when(F.col("least") < k, "suppressed").otherwise("published"),
    }
    made = both.select("*", *[F.when(pending, "pending").otherwise(s).alias(n) for n, s in states.items()])
    shown = [F.when(F.col(s) == "published", F.col(c)).alias(c) for c, s in (("pv", "access"), ("uv", "access"), ("requests", "quality"), ("successes", "quality"), ("categories", "popularity"))]
    return made.select("app", "date", "cutoff_at", *states, *shown)


def calendar(facts: DataFrame, now: datetime, start_day: date, apps: tuple[str, ...] = APPS, k: int = THRESHOLD, frozen: DataFrame | None = None) -> DataFrame:
    """A row for each app and day from start_day, or 89 days ago if that is later, to today in Hong Kong:
    app, date, cutoff_at, access, quality, popularity, pv, uv, requests, successes, success_rate,
    popular (kind, name and n of every category, by kind and name).

    Days without rows are empty, days whose cutoff hasn't come are pending. frozen has what earlier
    calls gave: its days that weren't pending stay as they are."""
    spark = facts.sparkSession
    today = aware(now).astimezone(HK).date()
    first = max(start_day, today - timedelta(days=DAYS_KEPT - 1))
    days = spark.createDataFrame([(app, first + timedelta(days=n)) for n in range((today - first).days + 1) for app in apps], "app string, date date")  # at most 90 days
    made = projection(facts, now, first, k).drop("cutoff_at", "categories")
    rows = facts.where(F.col("source") == "real").withColumn("date", business_date(F.col("event_time"))).where(F.col("accepted") < cutoff_of(F.col("date")))
    kind = F.when(F.col("event_type") == "page_view", "page").when(F.col("event_type") == "character_select", "character")
    name = F.when(F.col("event_type") == "page_view", F.col("path")).otherwise(F.col("character_id"))
    each = rows.withColumns({"kind": kind, "name": name}).where("kind IS NOT NULL AND name IS NOT NULL").groupBy("app", "date", "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    popular = each.groupBy("app", "date").agg(F.sort_array(F.collect_list(F.struct("kind", "name", "n"))).alias("popular"))
    both = days.join(made, ["app", "date"], "left").join(popular, ["app", "date"], "left").withColumn("cutoff_at", cutoff_of(F.col("date")))
    absent = F.when(F.col("cutoff_at") > F.lit(slot(now)), "pending").otherwise("empty")
    states = [F.coalesce(s, absent).alias(s) for s in ("access", "quality", "popularity")]
    shown = [F.when(F.col("popularity") == "published", F.col("popular")).alias("popular")]
    out = both.select("app", "date", "cutoff_at", *states, "pv", "uv", "requests", "successes", F.try_divide("successes", "requests").alias("success_rate"), *shown)
    if frozen is None:
        return out
    kept = frozen.where("access <> 'pending'").join(days, ["app", "date"], "left_semi")
    return kept.unionByName(out.join(kept.select("app", "date"), ["app", "date"], "left_anti"))


def freeze(frozen: DataFrame, made: DataFrame, keys: tuple[str, ...] = ("app", "date")) -> DataFrame:
    """What was frozen stays as it is; days that are new and not pending join it."""
    new = made.where("access <> 'pending'").join(frozen.select(*keys), list(keys), "left_anti")
    return frozen.unionByName(new)


def legacy(daily_rows: DataFrame, k: int = THRESHOLD) -> DataFrame:
    """Whole rows only: a row with any hidden group is dropped."""
    ok = access_state(F.col("pv"), F.col("uv"), k).isin("empty", "published") & quality_state(F.col("requests"), F.col("successes"), k).isin("empty", "published")
    return daily_rows.where(ok)


def expire(rows: DataFrame, at: str, now: datetime, days: int) -> DataFrame:
    """Rows younger than `days`: 7 for raw ones, 30 for identities, 90 for aggregates."""
    return rows.where(F.col(at) > F.lit(aware(now) - timedelta(days=days)))


def stale(updated: Column, now: Column, public: bool = False) -> Column:
    """Over 3 minutes for exact values, 26 hours for public ones."""
    limit = F.expr("INTERVAL 26 HOURS" if public else "INTERVAL 3 MINUTES")
    return F.when(now - updated > limit, "stale").otherwise("fresh")
