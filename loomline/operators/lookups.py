"""Join-shaped lookups (J), latest rows, upserts (O) and limits."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

#: Fixed values: (tool or None for all, key, effective from or None, input, output, cache write, cache read), dollars for a million tokens.
PRICES = (
    (None, "claude-opus-4", None, 15.0, 75.0, 18.75, 1.5),
    (None, "claude-opus-4", "2024-01-15", 5.0, 25.0, 6.25, 0.5),
    (None, "claude-opus-4-6", "2024-01-20", 6.0, 30.0, 7.5, 0.6),
    (None, "claude-haiku-4-5", None, 1.0, 5.0, 1.25, 0.1),
    (None, "gpt-5", None, 1.25, 10.0, 1.25, 0.125),
    (None, "gpt-5-mini", None, 0.25, 2.0, 0.25, 0.025),
    ("cursor", "auto", None, 1.0, 6.0, 1.25, 0.25),
)
FALLBACK = (3.0, 15.0, 3.75, 0.3)
#: Up to so many entries a price book is broadcast.
BROADCAST_PRICES = 10_000


def price_book(spark: SparkSession) -> DataFrame:
    """A few dozen rows at most."""
    return spark.createDataFrame(list(PRICES), "scope string, key string, effective_from string, p_in double, p_out double, p_write double, p_read double").withColumn("effective_from", F.to_date("effective_from"))


def priced(calls: DataFrame, book: DataFrame) -> DataFrame:
    """Each call's cost from the book: the tool's prices first, then an exact key, then the longest prefix, then the newest date that has begun; else the fallback.

    Keys are looked up once for each distinct (tool, model, day), so the theta join sees few rows.
    """
    day = F.to_date("timestamp")
    keys = calls.select("tool", "canonical", day.alias("day")).distinct()
    fits = (F.col("scope").isNull() | (F.col("scope") == F.col("tool"))) & F.col("canonical").startswith(F.col("key")) & (F.col("effective_from").isNull() | (F.col("effective_from") <= F.col("day")))
    order = F.struct(F.col("scope").isNotNull(), F.col("key") == F.col("canonical"), F.length("key"), F.coalesce("effective_from", F.lit("0001-01-01").cast("date")))
    prices = F.struct("p_in", "p_out", "p_write", "p_read")
    few = book.limit(BROADCAST_PRICES + 1).count() <= BROADCAST_PRICES
    best = keys.join(F.broadcast(book) if few else book, fits).groupBy("tool", "canonical", "day").agg(F.max_by(prices, order).alias("price"))
    joined = calls.withColumn("day", day).join(best, ["tool", "canonical", "day"], "left")
    p = [F.coalesce(F.col(f"price.{n}"), F.lit(v)) for n, v in zip(("p_in", "p_out", "p_write", "p_read"), FALLBACK, strict=True)]
    cost = F.col("input_tokens") * p[0] + F.col("output_tokens") * p[1] + F.col("cache_write_tokens") * p[2] + F.col("cache_read_tokens") * p[3]
    return joined.withColumns({"priced_cost": cost / 1e6, "is_fallback": F.col("price").isNull()}).drop("price")


def output_rates(x: DataFrame, book: DataFrame, day: date) -> DataFrame:
    """x with output_rate, the price of a million output tokens of its tool's model on a day."""
    keys = x.select("tool", "canonical").distinct().withColumns({"timestamp": F.lit(day).cast("timestamp_ntz"), "output_tokens": F.lit(1_000_000)} | {c: F.lit(0) for c in ("input_tokens", "cache_write_tokens", "cache_read_tokens")})
    # written, so that its size is known: a plain join sorts all calls by the few models
    rates = written(priced(keys, book).select("tool", "canonical", F.round("priced_cost", 6).alias("output_rate")), "rates")
    return x.join(rates, ["tool", "canonical"])


def as_of_prices(lines: DataFrame, parts: DataFrame, change: datetime) -> DataFrame:
    """J03 on keys with dated entries: each key's entries are one sorted array, so the join adds no rows."""
    first = F.struct(F.lit(None).cast("timestamp_ntz").alias("from"), F.col("p_retailprice").alias("price"))
    second = F.struct(F.lit(change).cast("timestamp_ntz").alias("from"), (F.col("p_retailprice") * 1.1).alias("price"))
    book = parts.select(F.col("p_partkey").alias("l_partkey"), F.array(first, second).alias("entries"))
    begun = F.filter("entries", lambda e: e["from"].isNull() | (e["from"] <= F.col("l_shipdate")))
    return lines.join(book, "l_partkey").withColumn("price", F.element_at(begun, -1)["price"])


def project_labels(identities: DataFrame) -> DataFrame:
    """The shortest path suffix that no other identity in scope has, else the whole path."""
    parts = F.filter(F.split("identity", "/"), lambda p: p != "")
    suffixes = identities.select("identity").distinct().withColumn("parts", parts).select("identity", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("parts"), F.lit(1))), lambda n: F.array_join(F.slice("parts", -n, n), "/"))).alias("n", "suffix"))
    unique = suffixes.groupBy("suffix").agg(F.count_distinct("identity").alias("owners"), F.first("identity").alias("identity"), F.min("n").alias("n")).where("owners = 1")
    best = unique.groupBy("identity").agg(F.min_by("suffix", "n").alias("label"))
    return identities.select("identity").distinct().join(best, "identity", "left").select("identity", F.coalesce("label", "identity").alias("label"))


def latest_limits(snapshots: DataFrame) -> DataFrame:
    """The newest observation of each (tool, limit_id); equal times: the later row."""
    w = Window.partitionBy("tool", "limit_id").orderBy(F.col("observed_at").desc_nulls_last(), F.col("seq").desc())
    return snapshots.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def limit_status(snapshots: DataFrame, now: datetime) -> DataFrame:
    """Latest limits, stale after their reset and hidden a week later."""
    t = F.lit(now).cast("timestamp_ntz")
    late = latest_limits(snapshots)
    return late.select("tool", "limit_id", F.round("used_percent", 6).alias("used_percent"), "window_minutes", (F.col("resets_at") < t).alias("is_stale"), (F.col("resets_at") + F.expr("INTERVAL 7 DAYS") < t).alias("is_hidden"))


def detected_plans(snapshots: DataFrame) -> DataFrame:
    """Each tool's plan in its newest observation that names one."""
    return snapshots.where("plan_type is not null").groupBy("tool").agg(F.max_by("plan_type", F.struct("observed_at", "seq")).alias("plan_type"))


def first_wins(incoming: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row for each (tool, dedup_key), the first by seq, unless the archive has the key."""
    w = Window.partitionBy("tool", "dedup_key").orderBy("seq")
    fresh = incoming.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
    return fresh if existing is None else fresh.join(existing.select("tool", "dedup_key"), ["tool", "dedup_key"], "left_anti")


def superseded(archive: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows named in an incoming superseded array go; a successor with equal token buckets inherits their cost."""
    buckets = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]
    named = incoming.select("tool", F.col("dedup_key").alias("by_key"), *[F.col(b).alias(f"new_{b}") for b in buckets], F.posexplode("superseded").alias("place", "dedup_key"))
    same = F.lit(True)
    for b in buckets:
        same = same & (F.col(b) == F.col(f"new_{b}"))
    old = named.join(archive, ["tool", "dedup_key"]).where(same).groupBy("tool", F.col("by_key").alias("dedup_key")).agg(F.max_by("cost", "place").alias("old_cost"))
    kept = archive.join(named.select("tool", "dedup_key"), ["tool", "dedup_key"], "left_anti")
    added = incoming.drop("superseded").join(old, ["tool", "dedup_key"], "left").withColumn("cost", F.coalesce("old_cost", "cost")).drop("old_cost")
    return kept.unionByName(added.select(*kept.columns))
