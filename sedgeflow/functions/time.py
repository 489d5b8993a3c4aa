"""Business time: days of Asia/Hong_Kong, cutoffs, maturity. Sessions run in UTC."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Hong_Kong"
HK = timezone(timedelta(hours=8))


def business_date(at: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(at, ZONE))


def instant(text: Column) -> Column:
    """A timestamp from text that names its zone; null for anything else (no error under ANSI)."""
    return F.when(text.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def utc(at: datetime) -> Column:
    return F.lit(at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc))


def closed_day(cutoff: datetime) -> date:
    """The last business day that is over at the cutoff."""
    return aware(cutoff).astimezone(HK).date() - timedelta(days=1)


def aware(at: datetime) -> datetime:
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def day_start(day: date) -> datetime:
    return datetime(day.year, day.month, day.day, tzinfo=HK)


@dataclass(frozen=True)
class ReportWindow:
    start: date
    end: date
    cutoff: datetime
    run_id: str


def report_window(interval_end: datetime, run_id: str, date_from: date | None = None, date_to: date | None = None, cutoff: datetime | None = None, most: int = 366) -> ReportWindow:
    """By default the seven days that end yesterday in Hong Kong; run ids are made safe for paths."""
    cutoff = aware(cutoff or interval_end)
    end = date_to or closed_day(cutoff)
    start = date_from or end - timedelta(days=6)
    if not 0 <= (end - start).days < most:
        raise ValueError(f"a report window has 1 to {most} days")
    if end > closed_day(cutoff):
        raise ValueError("the window ends after the last closed day")
    safe = run_id if re.fullmatch(r"[A-Za-z0-9_-]{1,64}", run_id) else hashlib.sha256(run_id.encode()).hexdigest()[:32]
    return ReportWindow(start, end, cutoff, safe)
