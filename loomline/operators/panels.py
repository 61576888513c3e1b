"""Panels of the dashboard and the report (A) beyond the plain groupings in usage."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bar_value
from . import usage


def _basics() -> list:
    return [usage.money().alias("cost"), F.count("*").alias("calls"), F.sum("tokens").alias("tokens")]


def activity_timeline(x: DataFrame, period: str, now: datetime) -> DataFrame:
    """24 hours for today, 168 for a week, hours of the month before its 15th day, else days of the month."""
    if period in ("today", "week"):
        return usage.dense_hours(x, now, 24 if period == "today" else 168)
    if now.day < 15:
        return usage.dense_hours(x, now, (now.day - 1) * 24 + now.hour + 1)
    return usage.dense_days(x, now, now.day)


def tool_mix(x: DataFrame, top: int = 3) -> DataFrame:
    """Each project's tools with most cost, at most so many, as one text."""
    tools = x.groupBy("identity", "tool").agg(usage.money().alias("cost"))
    place = F.row_number().over(Window.partitionBy("identity").orderBy(F.desc("cost"), "tool"))
    best = tools.withColumn("place", place).where(F.col("place") <= top)
    return best.groupBy("identity").agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", "tool")))["tool"], " / ").alias("mix"))


def session_options(x: DataFrame) -> DataFrame:
    """Every session with its first tool and project."""
    return x.where("session_key is not null").groupBy("session_key").agg(*_basics(), F.min_by("tool", "seq").alias("tool"), F.min_by("identity", "seq").alias("project"), F.max("timestamp").alias("latest"))


def session_calls(x: DataFrame, sessions: DataFrame) -> DataFrame:
    """Calls of the named sessions, ranked by cost in each; input includes what was cached, mcp tools show as mcp:server."""
    rank = F.row_number().over(Window.partitionBy("session_key").orderBy(F.desc("cost"), F.desc("tokens"), F.desc_nulls_last("timestamp"), "model", "seq"))
    core, mcp = usage.core_tools(), F.transform(usage.mcp_servers(), lambda s: F.concat(F.lit("mcp:"), s))
    rows = x.join(sessions.select("session_key").distinct(), "session_key", "left_semi")
    return rows.select("session_key", "dedup_key", "model", F.round("cost", 6).alias("cost"), (F.col("input_tokens") + F.col("cache_read_tokens")).alias("input"), F.array_join(F.concat(core, mcp), ",").alias("used"), rank.cast("long").alias("rank"))


def model_catalog(x: DataFrame) -> DataFrame:
    """Models with their split by tool, most calls first, as text."""
    split = x.groupBy("canonical", "tool").agg(F.count("*").alias("calls"), usage.money().alias("cost"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("calls")).alias("less"), "tool")))
    return split.groupBy("canonical").agg(F.sum("calls").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"), F.array_join(F.transform(ordered, lambda s: F.concat_ws("=", s["tool"], -s["less"])), ",").alias("split"))


def fallback_models(priced: DataFrame) -> DataFrame:
    """Tools and models without a price of their own; no empty or bracketed names."""
    return priced.where("is_fallback and model <> '' and not startswith(model, '<')").select("tool", "model").distinct()


def project_tool_split(x: DataFrame, identity: str) -> DataFrame:
    """One project by tool, with cost for each session, at least one."""
    return usage.by(x.where(F.col("identity") == identity), "tool").withColumn("cost_per_session", F.round(F.col("cost") / F.greatest("sessions", F.lit(1)), 6))


def tool_stack(x: DataFrame) -> DataFrame:
    """By day and tool, cost in hundredths of a cent."""
    return x.where("timestamp is not null").groupBy(F.to_date("timestamp").alias("day"), "tool").agg(F.round(usage.money() * 10_000).cast("long").alias("amount"))


def recent_by_tool(x: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """Each tool's tokens in every one of the last hours, with a bar of 1 to 100 of its busiest hour."""
    last = now.replace(minute=0, second=0, microsecond=0)
    spine = x.sparkSession.range(hours).select((F.lit(last - timedelta(hours=hours - 1)).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("hour"))
    tools = x.select("tool").distinct()
    sums = x.groupBy("tool", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour")).agg(F.sum("tokens").alias("tokens"))
    dense = tools.crossJoin(F.broadcast(spine)).join(sums, ["tool", "hour"], "left").select("tool", "hour", F.coalesce("tokens", F.lit(0)).alias("tokens"))  # spine: hours rows
    most = F.max("tokens").over(Window.partitionBy("tool"))
    return dense.withColumn("bar", F.when(F.col("tokens") > 0, bar_value(F.col("tokens").cast("double"), most.cast("double"))).otherwise(F.lit(0).cast("long")))


def newest_roots(x: DataFrame, top: int = 25) -> DataFrame:
    """The absolute project paths used last."""
    return x.where(F.col("identity").startswith("/")).groupBy("identity").agg(F.max("timestamp").alias("latest")).orderBy(F.desc_nulls_last("latest"), "identity").limit(top)


def report_summary(x: DataFrame) -> DataFrame:
    """Totals whose tokens count reasoning too."""
    return x.agg(usage.money().alias("cost"), F.count("*").alias("calls"), F.count_distinct("session_key").alias("sessions"), F.count_distinct("identity").alias("projects"), F.sum(F.col("tokens") + F.col("reasoning_tokens")).alias("total_tokens"))


def report_projects(x: DataFrame) -> DataFrame:
    """Projects with the raw paths they were seen under."""
    return x.groupBy("identity").agg(*_basics(), F.array_join(F.sort_array(F.collect_set("project")), ",").alias("paths"))


def heatmap_days(x: DataFrame, most: int = 364) -> DataFrame:
    """Every day from the first to the last, the last ones only if there are more than so many."""
    days = usage.daily(x)
    ends = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("hi is not null")
    spine = ends.select(F.explode(F.sequence(F.greatest("lo", F.date_sub("hi", most - 1)), F.col("hi"))).alias("day"))
    return spine.join(days, "day", "left").select("day", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
