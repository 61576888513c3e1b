"""Rows of models, calls, categories and limits as pages and reports list them (A14, A20, A28, A35, A38, A39), and tool signals."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.categories import CATEGORIES
from ..functions.columns import in_period
from .lookups import latest_limits
from .practice import CACHE_READS, CANCELS, CONVERSATIONS, FILE_REFS
from .pricing import rate_label
from .shared import placed


def _read_rate() -> Column:
    return rate_label(F.col("price.p_read"), F.col("price.p_in"))


def _write_rate() -> Column:
    return rate_label(F.col("price.p_write"), F.col("price.p_in"))


def model_rows(priced: DataFrame) -> DataFrame:
    """By canonical id, sums, the share of context read from caches, and the cache rate if it is one."""
    read = F.sum("cache_read_tokens")
    share = F.coalesce(F.try_divide(100.0 * read, F.sum(F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens"))), F.lit(0.0))
    one = F.when(F.count_distinct(_read_rate()) > 1, "mixed").otherwise(F.min(_read_rate()))
    return priced.groupBy("canonical_id").agg(F.round(F.sum("cost"), 6).alias("cost"), F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(share, 6).alias("cache_pct"), one.alias("cache_read_rate"))


def report_calls(priced: DataFrame) -> DataFrame:
    """Every call, numbered by time."""
    rows = placed(priced, "calls", F.col("timestamp").asc_nulls_first(), F.col("seq").asc())
    prompt = F.trim(F.regexp_replace("user_message", r"\s+", " "))
    return rows.select(
        "place", "timestamp", "tool", "model", "identity", F.coalesce("session_key", F.lit("")).alias("session_key"), "dedup_key", F.round("cost", 6).alias("cost_usd"),
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", _read_rate().alias("cache_read_rate"), _write_rate().alias("cache_write_rate"), F.array_join("tools", ", ").alias("tools"), F.array_join("commands", " && ").alias("commands"), prompt.alias("prompt"),
    )


def _by_category(calls: DataFrame) -> tuple[DataFrame, Column]:
    sums = calls.groupBy("category").agg(F.round(F.sum("cost"), 6).alias("cost"), F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    return sums, F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))


def category_rows(calls: DataFrame, mode: str = "spend") -> DataFrame:
    """Cost, calls and tokens by category (13 at most), in order, with bars that may be 0."""
    sums, listed = _by_category(calls)
    first = "tokens" if mode == "tokens" else "cost"
    largest = F.max(first).over(Window.partitionBy())
    return sums.withColumns({"place": F.row_number().over(Window.orderBy(F.desc(first), listed)).cast("long"), "bar": F.when(largest > 0, F.round(100.0 * F.col(first) / largest)).otherwise(0).cast("long")})


def report_categories(calls: DataFrame) -> DataFrame:
    """By cost, then calls, then the categories' own order."""
    sums, listed = _by_category(calls)
    return sums.withColumn("place", F.row_number().over(Window.orderBy(F.desc("cost"), F.desc("calls"), listed)).cast("long"))


def raw_limits(snapshots: DataFrame, period: str, now: datetime) -> DataFrame:
    """Every observation of a period, by time."""
    rows = snapshots.where(in_period(F.col("observed_at"), period, now))
    return placed(rows, "limits", "observed_at", "seq").select("place", "tool", "limit_id", "observed_at", F.round("used_percent", 6).alias("used_percent"), "window_minutes", "plan_type")


def report_latest_limits(snapshots: DataFrame, period: str, now: datetime) -> DataFrame:
    """The newest observation of each limit in a period, by tool and limit."""
    late = latest_limits(snapshots.where(in_period(F.col("observed_at"), period, now)))
    return late.select("tool", "limit_id", "observed_at", F.round("used_percent", 6).alias("used_percent"), "plan_type", F.row_number().over(Window.orderBy("tool", "limit_id")).cast("long").alias("place"))


def limit_windows(snapshots: DataFrame, now: datetime) -> DataFrame:
    """Of each limit's newest observation its windows that aren't hidden, by tool, limit and length.

    snapshots has structs primary and secondary of (used_percent, minutes, resets_at), null where the tool reported none.
    A window with a reset is stale after it and hidden a week later; one without is stale a week after its observation and hidden after two.
    """
    t = F.lit(now).cast("timestamp_ntz")
    kinds = F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).alias("of"))) for k in ("primary", "secondary")])
    rows = latest_limits(snapshots).select("tool", "limit_id", "observed_at", F.explode(F.array_compact(kinds)).alias("w")).select("tool", "limit_id", "observed_at", "w.kind", "w.of.*")
    days = lambda c, n: c + F.expr(f"INTERVAL {n} DAYS")
    rows = rows.withColumns({"stale": F.coalesce(F.col("resets_at") < t, days(F.col("observed_at"), 7) < t), "hidden": F.coalesce(days(F.col("resets_at"), 7) < t, days(F.col("observed_at"), 14) < t)}).where(~F.col("hidden"))
    label = F.when(F.col("minutes") == 300, "5h").when(F.col("minutes") == 10080, "weekly").when(F.col("minutes") == 43200, "monthly").otherwise(F.concat("minutes", F.lit("m")))
    percent = lambda c: F.least(F.greatest(F.round(c), F.lit(0.0)), F.lit(100.0)).cast("long")
    rows = rows.withColumn("label", label)
    rank = F.when(F.col("label") == "5h", 0).when(F.col("label") == "weekly", 1).otherwise(2)
    return rows.select("tool", "limit_id", "kind", "label", percent(F.col("used_percent")).alias("used"), percent(100 - F.col("used_percent")).alias("remaining"), "stale", F.row_number().over(Window.orderBy("tool", "limit_id", rank, "kind")).cast("long").alias("place"))


def tool_signals(x: DataFrame) -> DataFrame:
    """what each tool's rows can tell."""
    has = lambda tools: F.col("tool").isin(*tools)
    return x.select("tool").distinct().select("tool", has(CANCELS).alias("cancel"), has(FILE_REFS).alias("file_refs"), has(CACHE_READS).alias("cache_reads"), has(CONVERSATIONS).alias("conversations"))


def bars(hours: DataFrame, bar: Callable, scale: Callable, heat: Callable) -> DataFrame:
    """K03, K05, K06 over rows already summed by hour."""
    every = Window.partitionBy()
    out = hours.withColumns({"bar": bar(F.col("tokens"), F.max("tokens").over(every)), "scaled": scale(F.col("calls"), F.max("calls").over(every))})
    return out.withColumn("heat", heat(F.col("bar")))
