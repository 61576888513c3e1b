"""Scalar functions of the domain as column expressions."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def session_key() -> Column:
    """Tool:session_id, null for an empty session_id."""
    return F.when(F.col("session_id") != "", F.concat_ws(":", "tool", "session_id"))


def project_identity(project: Column) -> Column:
    """J09 without a disk: forward slashes, no trailing ones, (unknown) if empty."""
    path = F.regexp_replace(F.replace(F.trim(project), F.lit("\\"), F.lit("/")), "/+$", "")
    return F.when(path == "", "(unknown)").otherwise(path)


def canonical_key(model: Column) -> Column:
    """Lower case, up to the first @, after the last /, without a date, version after the family."""
    key = F.substring_index(F.substring_index(F.lower(F.trim(model)), "/", -1), "@", 1)
    return F.regexp_replace(F.regexp_replace(key, "-[0-9]{8}$", ""), r"^claude-([0-9]+)[.-]([0-9]+)-([a-z]+)$", "claude-$3-$1-$2")


def activity_tokens() -> Column:
    """X25."""
    return F.col("input_tokens") + F.col("output_tokens") + F.col("cache_write_tokens") + F.col("cache_read_tokens")


def in_period(ts: Column, period: str, now: datetime) -> Column:
    """today is the last 24 hours; only it excludes the future; a null time is in all only."""
    today = datetime(now.year, now.month, now.day)
    if period == "all":
        return F.lit(True)
    if period == "today":
        return F.coalesce(ts.between(F.lit(now - timedelta(hours=24)).cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz")), F.lit(False))
    if period in ("week", "30d"):
        return F.coalesce(ts >= F.lit(today - timedelta(days=6 if period == "week" else 29)).cast("timestamp_ntz"), F.lit(False))
    first, after = today.replace(day=1), (today.replace(day=28) + timedelta(days=4)).replace(day=1)
    return F.coalesce((ts >= F.lit(first).cast("timestamp_ntz")) & (ts < F.lit(after).cast("timestamp_ntz")), F.lit(False))


def caps_letter_ratio(text: Column) -> Column:
    """Share of capitals among the ASCII letters of the first 2,000 characters."""
    head = F.substring(text, 1, 2000)
    return F.try_divide(F.regexp_count(head, F.lit("[A-Z]")), F.regexp_count(head, F.lit("[A-Za-z]")))


def bar_value(value: Column, largest: Column) -> Column:
    """Percent of the largest, 1 to 100; 0 if nothing is positive."""
    return F.when(largest <= 0, F.lit(0)).otherwise(F.least(F.greatest(F.round(100.0 * value / largest), F.lit(1.0)), F.lit(100.0))).cast("long")


def penalty(severity: Column) -> Column:
    return F.when(severity == "high", 12).when(severity == "medium", 7).otherwise(3)


def bar_or_zero(value: Column, largest: Column) -> Column:
    """Percent of the largest, 0 to 100."""
    return F.when(largest <= 0, F.lit(0)).otherwise(F.least(F.greatest(F.round(100.0 * value / largest), F.lit(0.0)), F.lit(100.0))).cast("long")


def whole_scale(value: Column, largest: Column) -> Column:
    """Percent of the largest by whole division, 1 to 100; 0 if the largest is 0."""
    return F.when(largest == 0, F.lit(0)).otherwise(F.least(F.greatest(F.floor(value * 100 / largest), F.lit(1)), F.lit(100))).cast("long")


def heat_class(value: Column) -> Column:
    """0 for 0, then up to 20, 40, 65, 85 and beyond."""
    out = F.when(value == 0, 0)
    for place, most in enumerate((20, 40, 65, 85), 1):
        out = out.when(value <= most, place)
    return out.otherwise(5).cast("long")


def day_bounds(period: str, today: date) -> tuple[Column, Column]:
    """first and last day of a period, inclusive; today spans two days, all has no first."""
    first = {"today": today - timedelta(days=1), "week": today - timedelta(days=6), "30d": today - timedelta(days=29), "month": today.replace(day=1), "all": None}[period]
    return F.lit(first).cast("date").alias(f"{period}_first"), F.lit(today).cast("date").alias(f"{period}_last")
