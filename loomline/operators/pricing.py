"""Prices and costs: layered books, aliases, as-of lookups, the cost formula, labels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical_key

#: An hour's cache write costs so much more than the usual one.
HOUR_PREMIUM = 1.6
RATES = ("p_in", "p_out", "p_write", "p_read", "p_web")
BOOK = "layer int, scope string, key string, effective_from date, p_in double, p_out double, p_write double, p_read double, p_web double, fast double"
# Fixed values: (layer, tool or None, key, effective from or None, dollars a million tokens for input, output, cache write, cache read, a web search, multiplier of fast calls or None).
ENTRIES = (
    (0, None, "claude-opus-4", None, 15.0, 75.0, 18.75, 1.5, 0.01, None),
    (0, None, "claude-opus-4", "2024-01-15", 5.0, 25.0, 6.25, 0.5, 0.01, 6.0),
    (1, None, "claude-opus-4", "2024-01-15", 5.5, 27.5, 6.875, 0.55, 0.01, 6.0),
    (0, None, "claude-opus-4-6", "2024-01-20", 6.0, 30.0, 7.5, 0.6, 0.01, None),
    (0, None, "claude-haiku-4-5", None, 1.0, 5.0, 1.25, 0.1, 0.01, None),
    (0, None, "gpt-5", None, 1.25, 10.0, 1.25, 0.125, 0.01, None),
    (1, None, "gpt-5-mini", None, 0.25, 2.0, 0.25, 0.025, 0.01, 2.0),
    (1, None, "claude-sonnet-4", None, 3.0, 15.0, 3.75, 0.3, 0.01, None),
    (1, "cursor", "composer", None, 1.0, 6.0, 1.25, 0.25, 0.0, None),
)
#: (tool or None, model, what it is priced as).
ALIASES = (("cursor", "Auto", "composer"), ("copilot", "auto", "gpt-5"), (None, "My-Proxy-9000", "claude-haiku-4-5"))
FALLBACK = "claude-sonnet-4"


def layered(entries: DataFrame) -> DataFrame:
    """Of entries with one scope, key and date the one of the highest layer; keys canonical, scopes in lower case."""
    clean = entries.withColumns({"key": canonical_key(F.col("key")), "scope": F.lower(F.trim("scope"))})
    w = Window.partitionBy("scope", "key", "effective_from").orderBy(F.desc("layer"))
    return clean.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def invalid(entries: DataFrame) -> DataFrame:
    """(key, field, value) of prices below zero or not finite, and of multipliers that aren't above zero."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    checks = [F.when((F.col(r) < 0) | ~finite(F.col(r)), F.struct(F.lit(r).alias("field"), F.col(r).alias("value"))) for r in RATES]
    checks.append(F.when((F.col("fast") <= 0) | ~finite(F.col("fast")), F.struct(F.lit("fast").alias("field"), F.col("fast").alias("value"))))
    return entries.select("key", F.explode(F.array_compact(F.array(*checks))).alias("c")).select("key", "c.*")


def aliases(spark: SparkSession, rows: tuple = ALIASES) -> DataFrame:
    """Both sides canonical, tools in lower case."""
    a = spark.createDataFrame(list(rows), "scope string, model string, target string")
    return a.select(F.lower(F.trim("scope")).alias("scope"), canonical_key(F.col("model")).alias("model"), canonical_key(F.col("target")).alias("target")).distinct()


def legacy_entries(snapshot: DataFrame) -> DataFrame:
    """A one-file snapshot (model string, input, output, cache_write, cache_read by token) as entries a million tokens."""
    return snapshot.select(F.lit(0).alias("layer"), F.lit(None).cast("string").alias("scope"), canonical_key(F.col("model")).alias("key"), F.lit(None).cast("date").alias("effective_from"), *[F.round(F.col(c) * 1e6, 9).alias(r) for c, r in (("input", "p_in"), ("output", "p_out"), ("cache_write", "p_write"), ("cache_read", "p_read"))], F.lit(0.0).alias("p_web"), F.lit(None).cast("double").alias("fast"))


def book(spark: SparkSession) -> DataFrame:
    entries = spark.createDataFrame(list(ENTRIES), BOOK.replace("effective_from date", "effective_from string"))
    return layered(entries.withColumn("effective_from", F.to_date("effective_from")))


def lookup(calls: DataFrame, prices: DataFrame, also: DataFrame, today: date, fallback: str = FALLBACK) -> DataFrame:
    """Calls with price and is_fallback: the tool's alias, its book, the general alias, the general book, else the fallback's entry.

    In a book an exact key comes first, then the longest that the model starts with, and in a key the newest entry that has begun by the call's day.
    Books are looked up once for each distinct (tool, model, day); they are broadcast by Spark's own size check.
    """
    keys = calls.select("tool", "canonical", F.coalesce(F.to_date("timestamp"), F.lit(today)).alias("day")).distinct()
    own, general = also.where("scope is not null"), also.where("scope is null").select("model", F.col("target").alias("general"))
    keys = keys.join(own.select(F.col("scope").alias("tool"), F.col("model").alias("canonical"), "target"), ["tool", "canonical"], "left").withColumn("named", F.coalesce("target", "canonical")).drop("target")
    keys = keys.join(general, F.col("named") == F.col("model"), "left").withColumn("wanted", F.coalesce("general", "named")).drop("general", "model")
    begun = F.col("effective_from").isNull() | (F.col("effective_from") <= F.col("day"))
    price = F.struct(*RATES, "fast")
    order = F.struct(F.col("scope").isNotNull(), F.col("key") == F.when(F.col("scope").isNotNull(), F.col("named")).otherwise(F.col("wanted")), F.length("key"), F.coalesce("effective_from", F.lit("0001-01-01").cast("date")))
    fits = ((F.col("scope") == F.col("tool")) & F.col("named").startswith(F.col("key"))) | (F.col("scope").isNull() & F.col("wanted").startswith(F.col("key")))
    best = keys.join(prices, fits & begun).groupBy("tool", "canonical", "day").agg(F.max_by(price, order).alias("price"))
    last = keys.select("day").distinct().join(prices.where(F.col("scope").isNull() & (F.col("key") == canonical_key(F.lit(fallback)))), begun).groupBy("day").agg(F.max_by(price, F.coalesce("effective_from", F.lit("0001-01-01").cast("date"))).alias("last"))
    found = keys.join(best, ["tool", "canonical", "day"], "left").join(last, "day", "left").select("tool", "canonical", "day", F.col("price").isNull().alias("is_fallback"), F.coalesce("price", "last").alias("price"))
    return calls.withColumn("day", F.coalesce(F.to_date("timestamp"), F.lit(today))).join(found, ["tool", "canonical", "day"], "left")


def cost() -> Column:
    """Dollars of a call with its price, cache_1h_tokens, web_searches and speed."""
    p = lambda name: F.col(f"price.{name}")
    hour = F.least("cache_1h_tokens", "cache_write_tokens")
    tokens = F.col("input_tokens") * p("p_in") + F.col("output_tokens") * p("p_out") + F.col("cache_write_tokens") * p("p_write") + hour * p("p_write") * (HOUR_PREMIUM - 1.0) + F.col("cache_read_tokens") * p("p_read")
    return F.when((F.col("speed") == "fast") & p("fast").isNotNull(), p("fast")).otherwise(1.0) * (tokens / 1e6 + F.col("web_searches") * p("p_web"))


def rate_label(rate: Column, of: Column) -> Column:
    """A rate as percent of another, whole if within 0.05."""
    pct = rate / of * 100.0
    return F.when((rate <= 0) | (of <= 0), "-").when(F.abs(pct - F.round(pct)) < 0.05, F.format_string("%.0f%%", pct)).otherwise(F.format_string("%.1f%%", pct))


def model_detail(calls: DataFrame, prices: DataFrame, also: DataFrame, today: date) -> DataFrame:
    """By canonical id, its tokens, and the prices of its (tool, model) pairs at their last call: one value, or mixed."""
    pairs = calls.groupBy("canonical_id", "tool", "canonical").agg(F.max("timestamp").alias("timestamp"))
    priced = lookup(pairs, prices, also, today)
    shown = lambda c: F.when(c <= 0, "-").otherwise(F.format_string("$%.4f", c))
    one = lambda c: F.when(F.count_distinct(c) > 1, "mixed").otherwise(F.coalesce(F.min(c), F.lit("-")))
    of_price = {"input_price": shown(F.col("price.p_in")), "output_price": shown(F.col("price.p_out")), "cache_read_price": shown(F.col("price.p_read")), "cache_write_price": shown(F.col("price.p_write"))}
    of_price |= {"cache_read_rate": rate_label(F.col("price.p_read"), F.col("price.p_in")), "cache_write_rate": rate_label(F.col("price.p_write"), F.col("price.p_in"))}
    rates = priced.withColumns(of_price).groupBy("canonical_id").agg(*[one(F.col(c)).alias(c) for c in of_price], F.max("is_fallback").alias("has_fallback"))
    sums = calls.groupBy("canonical_id").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")], F.round(F.sum("cost") / F.count("*"), 6).alias("cost_per_call"))
    return sums.join(rates, "canonical_id")


def included(entries: DataFrame, parts: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """entries whose key holds one of parts, or is one of keys."""
    fits = F.col("key").isin(*keys)
    for part in parts:
        fits = fits | F.col("key").contains(part)
    return entries.where(fits)
