"""Aggregations over calls (A), their filters (F), sorts (K) and display derivations (V)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import activity_tokens, bar_value, canonical_key, in_period, project_identity, session_key


def enrich(calls: DataFrame) -> DataFrame:
    """Calls with session_key, identity, canonical model and activity tokens."""
    return calls.withColumns({"session_key": session_key(), "identity": project_identity(F.col("project")), "tokens": activity_tokens(), "canonical": canonical_key(F.col("model"))})


def of_period(calls: DataFrame, period: str, now: datetime) -> DataFrame:
    return calls.where(in_period(F.col("timestamp"), period, now))


def money(column: str | Column = "cost") -> Column:
    return F.round(F.sum(column), 6)


def _sessions() -> Column:
    return F.count_distinct("session_key").alias("sessions")


def _basics() -> list[Column]:
    return [money().alias("cost"), F.count("*").alias("calls"), F.sum("tokens").alias("tokens")]


def period_totals(x: DataFrame) -> DataFrame:
    """A01."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")]
    return x.agg(F.coalesce(money(), F.lit(0.0)).alias("cost"), F.count("*").alias("calls"), _sessions(), *sums)


def dashboard_summary(x: DataFrame) -> DataFrame:
    """Totals and the cache hit percentage."""
    read = F.sum("cache_read_tokens")
    return x.agg(*_basics(), _sessions(), F.round(F.coalesce(F.try_divide(100.0 * read, F.sum("input_tokens") + read + F.sum("cache_write_tokens")), F.lit(0.0)), 6).alias("cache_hit_pct"))


def by(x: DataFrame, *keys: str) -> DataFrame:
    """Cost, calls, tokens, sessions and the last call by any keys."""
    return x.groupBy(*keys).agg(*_basics(), _sessions(), F.max("timestamp").alias("latest"))


def ranked(totals: DataFrame, label: str, mode: str = "spend", top: int | None = None) -> DataFrame:
    """The rank and bar value of each row of by(), then the first ones."""
    orders = {"spend": ("cost", "tokens", "latest"), "date": ("latest", "cost", "tokens"), "tokens": ("tokens", "cost", "latest")}[mode]
    order = [*[F.col(c).desc_nulls_last() for c in orders], F.col(label).asc()]
    every = totals.agg(F.count("*").alias("_n"), F.max(orders[0]).alias("_largest"))
    first = totals.orderBy(*order).limit(top) if top else totals  # the first ones only, so that no task sorts all rows
    out = first.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).crossJoin(F.broadcast(every))  # one row
    if mode == "date":
        bar = bar_value((F.col("_n") - F.col("rank") + 1).cast("double"), F.col("_n").cast("double"))
    else:
        bar = bar_value(F.col(orders[0]).cast("double"), F.col("_largest").cast("double"))
    return out.withColumn("bar", bar).drop("_n", "_largest")


def daily(x: DataFrame) -> DataFrame:
    """A04."""
    return x.where("timestamp is not null").groupBy(F.to_date("timestamp").alias("day")).agg(*_basics())


def dense_hours(x: DataFrame, now: datetime, hours: int) -> DataFrame:
    """Every hour of the last so many, zero where nothing happened."""
    last = now.replace(minute=0, second=0, microsecond=0)
    spine = x.sparkSession.range(hours).select((F.lit(last - timedelta(hours=hours - 1)).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("hour"))
    sums = x.groupBy(F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour")).agg(*_basics())
    return _dense(spine, sums, "hour")


def dense_days(x: DataFrame, now: datetime, days: int) -> DataFrame:
    """Every day of the last so many, ending today."""
    spine = x.sparkSession.range(days).select(F.date_add(F.lit((now - timedelta(days=days - 1)).date()), F.col("id").cast("int")).alias("day"))
    return _dense(spine, daily(x), "day")


def _dense(spine: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    return spine.join(sums, key, "left").select(key, F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def fair_share(x: DataFrame, items: Column, label: str) -> DataFrame:
    """Cost and tokens split evenly over a call's items, calls counted for each item unsplit."""
    rows = x.select("cost", "tokens", items.alias("items")).withColumn("n", F.size("items")).where("n > 0")
    rows = rows.select(F.explode("items").alias(label), (F.col("cost") / F.col("n")).alias("cost"), (F.col("tokens") / F.col("n")).alias("tokens"))
    return rows.groupBy(label).agg(money().alias("cost"), F.count("*").alias("calls"), F.round(F.sum("tokens"), 6).alias("tokens"))


def core_tools() -> Column:
    return F.filter("tools", lambda t: ~t.startswith("mcp__"))


def command_heads() -> Column:
    return F.filter(F.transform("commands", lambda c: F.split(F.trim(c), r"\s+")[0]), lambda c: c != "")


def mcp_servers() -> Column:
    return F.transform(F.filter("tools", lambda t: t.startswith("mcp__")), lambda t: F.split(t, "__")[1])


def full_attribution(x: DataFrame, items: Column, label: str) -> DataFrame:
    """Every occurrence gets the whole call."""
    return x.select(F.explode(items).alias(label), "cost", "tokens").groupBy(label).agg(*_basics())


def models(x: DataFrame) -> DataFrame:
    """By canonical model, with the cache percentage."""
    read = F.sum("cache_read_tokens")
    return x.groupBy("canonical").agg(*_basics(), F.max("timestamp").alias("latest"), F.round(F.coalesce(F.try_divide(100.0 * read, F.sum("input_tokens") + read + F.sum("cache_write_tokens")), F.lit(0.0)), 6).alias("cache_pct"))


def project_options(x: DataFrame) -> DataFrame:
    """All projects together first, then each."""
    return x.agg(*_basics()).select(F.lit("(all)").alias("project"), "cost", "calls", "tokens").unionByName(x.groupBy(F.col("identity").alias("project")).agg(*_basics()))


def session_report(x: DataFrame) -> DataFrame:
    """Each session's project seen first, span in minutes and sums."""
    return x.where("session_key is not null").groupBy("session_key").agg(*_basics(), F.min_by("identity", "seq").alias("project"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.expr("timestampdiff(MINUTE, min(timestamp), max(timestamp))").alias("minutes"))


def report_activity(x: DataFrame) -> DataFrame:
    """Days with an intensity of 1 to 100."""
    days = daily(x)
    return days.withColumn("intensity", bar_value(F.col("tokens").cast("double"), F.max("tokens").over(Window.partitionBy()).cast("double")))


def heat_grid(x: DataFrame) -> DataFrame:
    """Tokens, 1 at least, by weekday (Monday 0) and hour."""
    return x.where("timestamp is not null").groupBy(F.weekday("timestamp").cast("long").alias("weekday"), F.hour("timestamp").cast("long").alias("hour")).agg(F.sum(F.greatest("tokens", F.lit(1))).alias("amount"))


def hourly_profile(x: DataFrame) -> DataFrame:
    """Weekdays against weekends by hour."""
    return heat_grid(x).groupBy("hour", (F.col("weekday") >= 5).alias("weekend")).agg(F.sum("amount").alias("amount"))


def heat_levels(x: DataFrame) -> DataFrame:
    """Quarters of the largest cell."""
    share = F.col("amount") / F.max("amount").over(Window.partitionBy())
    return heat_grid(x).withColumn("level", F.when(F.col("amount") <= 0, 0).otherwise(F.least(F.floor(share * 4) + 1, F.lit(4))).cast("long"))


def tool_shares(x: DataFrame) -> DataFrame:
    """Each tool's share of all cost in thousandths."""
    totals = x.groupBy("tool").agg(money().alias("cost"))
    return totals.withColumn("per_mille", F.round(F.coalesce(F.try_divide(1000 * F.col("cost"), F.sum("cost").over(Window.partitionBy())), F.lit(0.0))).cast("long"))


def insights(x: DataFrame) -> DataFrame:
    """The project, model and day with most cost, calls for each active day."""
    def top(key: str) -> DataFrame:
        return x.groupBy(key).agg(*_basics()).agg(F.max_by(key, F.struct("cost", "tokens", "calls", key)).alias(f"top_{key}"))

    dated = x.withColumn("day", F.to_date("timestamp"))
    days = dated.agg(F.count("*").alias("calls"), F.count_distinct("day").alias("active_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    day = dated.groupBy("day").agg(*_basics()).agg(F.max_by("day", F.struct("cost", "tokens", "calls", "day")).alias("top_day"))
    out = days.crossJoin(top("identity")).crossJoin(top("canonical")).crossJoin(day)  # one row each
    return out.withColumn("calls_per_day", F.round(F.try_divide("calls", "active_days"), 6))


def usage_totals_delta(x: DataFrame, since: datetime) -> DataFrame:
    """Totals, and what came after a time."""
    later = F.col("timestamp") > F.lit(since).cast("timestamp_ntz")
    return x.agg(*_basics(), F.round(F.sum(F.when(later, F.col("cost"))), 6).alias("new_cost"), F.count_if(later).alias("new_calls"), F.sum(F.when(later, F.col("tokens"))).alias("new_tokens"))
