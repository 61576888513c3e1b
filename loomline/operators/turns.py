"""Turn and session windows (C), practice rules (R) and the relationship graph (G)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .usage import core_tools, mcp_servers


def turns(x: DataFrame) -> DataFrame:
    """Consecutive calls of a session with one prompt state."""
    key = F.coalesce("session_key", F.concat_ws(":", "tool", "identity"))
    order = Window.partitionBy("skey").orderBy(F.col("timestamp").asc_nulls_first(), "seq")
    exact = F.when(F.col("timestamp_quality") == "exact", F.col("timestamp"))
    rows = x.withColumn("skey", key).withColumn("new", (~F.lag("prompt_chars").over(order).eqNullSafe(F.col("prompt_chars")) | F.lag("seq").over(order).isNull()).cast("long"))
    rows = rows.withColumn("turn", F.sum("new").over(order))
    return rows.groupBy("skey", "turn").agg(
        F.min("tool").alias("tool"), F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.max("prompt_chars").alias("prompt_chars"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("input_tokens").alias("input_tokens"), F.sum("cache_read_tokens").alias("cache_read_tokens"), F.max("elapsed_ms").alias("elapsed_ms"),
        F.min(exact).alias("start"), F.max(exact).alias("end"), F.max(F.col("is_canceled")).alias("is_canceled"), F.sum(F.size("tools")).cast("long").alias("tool_calls"),
    )


def think_gaps(t: DataFrame) -> DataFrame:
    """Milliseconds from a turn's end to the next one's start, less the next one's latency."""
    w = Window.partitionBy("skey").orderBy("turn")
    gap = F.timestamp_diff("MILLISECOND", F.col("end"), F.lead("start").over(w)) - F.coalesce(F.lead("elapsed_ms").over(w), F.lit(0))
    return t.select("skey", "turn", gap.alias("gap_ms")).where("gap_ms is not null")


def activity_blocks(x: DataFrame, minutes: int = 15) -> DataFrame:
    """Islands of a session's calls at most so many whole minutes apart."""
    w = Window.partitionBy("session_key").orderBy("timestamp", "seq")
    gap = F.timestamp_diff("MINUTE", F.lag("timestamp").over(w), F.col("timestamp"))
    rows = x.where("session_key is not null and timestamp is not null").withColumn("new", F.coalesce(gap > minutes, F.lit(True)).cast("long")).withColumn("block", F.sum("new").over(w))
    return rows.groupBy("session_key", "block").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))


def max_concurrency(x: DataFrame) -> DataFrame:
    """C11: by day, most sessions active in a minute; a block counts through its last minute, on every day that it touches."""
    minute = lambda c: (F.hour(c) * 60 + F.minute(c)).cast("long")
    first, last = F.to_date("start"), F.to_date("end")
    days = activity_blocks(x).select("start", "end", F.explode(F.sequence(first, last)).alias("day"))
    b = days.select("day", F.when(F.col("day") == first, minute("start")).otherwise(0).cast("long").alias("lo"), F.when(F.col("day") == last, minute("end")).otherwise(1439).cast("long").alias("hi"))
    events = b.select("day", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("step")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("step")))).alias("e")).select("day", "e.*")
    steps = events.groupBy("day", "at").agg(F.sum("step").alias("step"))
    return steps.withColumn("active", F.sum("step").over(Window.partitionBy("day").orderBy("at"))).groupBy("day").agg(F.max("active").alias("most"))


def calendar(t: DataFrame) -> DataFrame:
    """Turns by day."""
    return t.where("start is not null").groupBy(F.to_date("start").alias("day")).agg(F.count("*").alias("turns"))


def streaks(t: DataFrame) -> DataFrame:
    """Runs of active days."""
    days = calendar(t).withColumn("island", F.date_sub("day", F.row_number().over(Window.orderBy("day"))))  # a row for each day
    return days.groupBy("island").agg(F.min("day").alias("first_day"), F.count("*").alias("days")).select("first_day", "days")


def output_by_language(x: DataFrame) -> DataFrame:
    """Lines of code by language."""
    return x.select(F.explode("code_blocks").alias("b"), "session_key").groupBy(F.col("b.language").alias("language")).agg(F.sum("b.loc").alias("loc"), F.count("*").alias("blocks"))


def half_hours(x: DataFrame) -> DataFrame:
    """Tumbling windows of 30 minutes."""
    return x.groupBy(F.window("timestamp", "30 minutes").start.cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


def rules(t: DataFrame, *by: str) -> DataFrame:
    """One aggregate over turns and one over sessions, a row for each rule (and value of by)."""
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0)).cast("long")
    hour, has_time = F.hour("start"), F.col("start").isNotNull()
    weekend = has_time & (F.weekday("start") >= 5)
    context = (F.col("input_tokens") + F.col("cache_read_tokens")) > 5000
    of_turns = t.groupBy(*by).agg(
        n((F.col("output_tokens") > 5000) & (F.col("prompt_chars") > 0) & (F.col("prompt_chars") < 200)).alias("verbose"), n(F.col("prompt_chars").isNotNull()).alias("prompts"), n(has_time).alias("timed"), n(has_time & (hour < 5)).alias("late"), n(weekend).alias("weekend"),
        n("is_canceled").alias("canceled"), n(F.lit(True)).alias("turns"), n(F.col("elapsed_ms") > 300_000).alias("slow"), n(F.col("elapsed_ms").isNotNull()).alias("measured"), n(F.col("tool_calls") >= 40).alias("runaway"), n(context).alias("large"),
        F.coalesce(F.try_divide(F.sum(F.when(context, F.col("cache_read_tokens"))), F.sum(F.when(context, F.col("input_tokens") + F.col("cache_read_tokens")))), F.lit(1.0)).alias("hit"),
    )
    of_sessions = t.groupBy(*by, "skey").agg(F.count("*").alias("turns")).groupBy(*by).agg(n(F.col("turns") >= 50).alias("mega"), n(F.col("turns") == 1).alias("abandoned"), n(F.lit(True)).alias("sessions"))
    both = of_turns.join(of_sessions, list(by)) if by else of_turns.crossJoin(of_sessions)  # one row each

    def rule(name: str, severity: str, count: str, total: str, fires: str) -> Column:
        return F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col(count).alias("occurrences"), F.col(total).alias("total"), F.expr(fires).alias("fires"))

    made = [
        rule("verbose-output", "medium", "verbose", "prompts", "verbose > 10 and verbose > 0.1 * prompts"),
        rule("late-night-coding", "low", "late", "timed", "late > 10"),
        rule("weekend-overwork", "low", "weekend", "timed", "weekend > 20 and weekend > 0.25 * timed"),
        rule("mega-sessions", "high", "mega", "sessions", "mega > 0"),
        rule("abandon-sessions", "low", "abandoned", "sessions", "abandoned > 10 and abandoned > 0.4 * sessions"),
        rule("high-cancellation", "medium", "canceled", "turns", "canceled > 0.15 * turns"),
        rule("slow-responses", "low", "slow", "measured", "slow > 5"),
        rule("runaway-agent-loops", "high", "runaway", "turns", "runaway >= 3"),
        rule("cache-hit-starvation", "medium", "large", "turns", "large > 20 and hit < 0.1"),
    ]
    return both.select(*by, F.explode(F.array(*made)).alias("r")).select(*by, "r.*")


def score(outcomes: DataFrame, *by: str) -> DataFrame:
    """100 less the share of the greatest penalty that fired, and its grade."""
    lost = F.sum(F.when(F.col("fires"), F.when(F.col("severity") == "high", 12).when(F.col("severity") == "medium", 7).otherwise(3)).otherwise(0))
    return outcomes.groupBy(*by).agg(F.count("*").alias("rules"), F.round(100 * (1 - lost / (F.count("*") * 12))).cast("long").alias("score"))


def graph_edges(x: DataFrame) -> DataFrame:
    """Edges of projects, tools, models and what they use; capabilities share a call's cost and tokens, calls stay whole."""
    end = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    core, mcp = F.transform(core_tools(), lambda t: end("core", t)), F.transform(mcp_servers(), lambda s: end("mcp", s))
    rows = x.withColumn("uses", F.concat(core, mcp))
    edge = lambda relation, a, b, share: F.struct(F.lit(relation).alias("relation"), a.alias("source"), b.alias("target"), share.alias("share"))
    p, t, m, one = end("project", F.col("identity")), end("tool", F.col("tool")), end("model", F.col("canonical")), F.lit(1.0)
    whole = F.array(edge("project_tool", p, t, one), edge("project_model", p, m, one), edge("tool_model", t, m, one))
    split = F.transform("uses", lambda u: edge("project_capability", p, u, 1.0 / F.size("uses")))
    made = rows.select("session_key", "cost", "tokens", F.explode(F.concat(whole, split)).alias("e")).select("session_key", "cost", "tokens", "e.*")
    return made.groupBy("relation", "source", "target").agg(F.round(F.sum(F.col("cost") * F.col("share")), 6).alias("cost"), F.round(F.sum(F.col("tokens") * F.col("share")), 4).alias("tokens"), F.count("*").alias("calls"), F.count_distinct("session_key").alias("sessions"))


def bounded_edges(edges: DataFrame, per_source: int = 5) -> DataFrame:
    """The costliest targets of each (relation, source)."""
    w = Window.partitionBy("relation", "source").orderBy(F.desc("cost"), "target")
    return edges.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= per_source)


def day_blocks(spans: DataFrame, *sums: str) -> DataFrame:
    """(day, start, end, sums) of spans merged where the gap is at most 15 whole minutes.

    Spans that start in one quarter of an hour always merge, so they are aggregated first; what a day puts in order is 96 rows at most.
    """
    quarter = F.hour("start") * 4 + F.floor(F.minute("start") / 15)
    ends = [F.min("start").alias("start"), F.max("end").alias("end"), *[F.sum(c).alias(c) for c in sums]]
    rows = spans.groupBy("day", quarter.alias("quarter")).agg(*ends)
    w = Window.partitionBy("day").orderBy("start")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce(F.timestamp_diff("MINUTE", before, F.col("start")) > 15, F.lit(True)).cast("long")).withColumn("block", F.sum("new").over(w))
    return rows.groupBy("day", "block").agg(*ends)


def flow_days(x: DataFrame, now: datetime) -> DataFrame:
    """By day, session spans merged where the gap is at most 15 whole minutes; number and longest minutes of blocks."""
    spans = x.where("session_key is not null and timestamp_quality = 'exact'").groupBy("session_key", F.to_date("timestamp").alias("day")).agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end")).where(F.col("day") <= F.lit(now.date()))
    blocks = day_blocks(spans).select("day", F.timestamp_diff("MINUTE", F.col("start"), F.col("end")).alias("minutes"))
    return blocks.groupBy("day").agg(F.count("*").alias("blocks"), F.max("minutes").alias("longest"), F.sum("minutes").alias("active"))


# Upper ends of bands, inclusive, with their scores, and the score beyond the last.
GAP_BANDS, GAP_BEYOND = ((10, 100.0), (30, 80.0), (60, 60.0), (120, 40.0), (300, 20.0)), 0.0
DURATION_BANDS, DURATION_BEYOND = ((5, 20.0), (15, 50.0), (40, 90.0), (90, 80.0)), 60.0


def _band(value: Column, bands: tuple, beyond: float) -> Column:
    out = F.when(value <= bands[0][0], bands[0][1])
    for most, points in bands[1:]:
        out = out.when(value <= most, points)
    return out.otherwise(beyond)


def session_flow(t: DataFrame) -> DataFrame:
    """A score of 0 to 100 for sessions of three timed turns or more with a think gap: quick follow-ups, upper median gap, duration and density."""
    w = Window.partitionBy("skey").orderBy("turn")
    timed = t.where("start is not null")
    gap = F.timestamp_diff("MILLISECOND", F.col("end"), F.lead("start").over(w)) - F.coalesce(F.lead("elapsed_ms").over(w), F.lit(0))
    s = timed.withColumn("gap", gap).groupBy("skey").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.when(F.col("gap") >= 0, F.col("gap")))).alias("gaps"), F.min_by("start", "turn").alias("start"), F.max_by("end", "turn").alias("end"))
    s = s.where("turns >= 3 and size(gaps) > 0").withColumn("minutes", F.timestamp_diff("MINUTE", F.col("start"), F.col("end")))
    rapid = F.size(F.filter("gaps", lambda g: g <= 30_000)) / F.size("gaps")
    median = F.expr("gaps[size(gaps) div 2] div 1000")
    density = F.least(F.when(F.col("minutes") > 0, F.col("turns") / F.col("minutes")).otherwise(F.col("turns").cast("double")) * 50.0, F.lit(100.0))
    points = 0.40 * rapid * 100.0 + 0.30 * _band(median, GAP_BANDS, GAP_BEYOND) + 0.15 * _band(F.col("minutes"), DURATION_BANDS, DURATION_BEYOND) + 0.15 * density
    return s.select("skey", F.to_date("start").alias("day"), "turns", "minutes", F.least(F.greatest(F.round(F.round(points, 6)), F.lit(0.0)), F.lit(100.0)).cast("long").alias("score"))


def flow_label(score: Column) -> Column:
    """C06."""
    return F.when(score >= 70, "deep").when(score >= 45, "moderate").when(score >= 25, "shallow").otherwise("fragmented")


# Nodes kept of each kind; all tools are.
NODE_LIMITS = {"project": 30, "model": 24, "core": 12, "mcp": 12}


def graph_nodes(x: DataFrame) -> DataFrame:
    """The costliest nodes of each kind; capabilities share a call's cost and tokens."""
    node = lambda kind, label, share: F.struct(F.lit(kind).alias("kind"), label.alias("label"), share.alias("share"))
    one, n = F.lit(1.0), F.size("tools")
    whole = F.array(node("project", F.col("identity"), one), node("tool", F.col("tool"), one), node("model", F.col("canonical"), one))
    split = F.concat(F.transform(core_tools(), lambda t: node("core", t, 1.0 / n)), F.transform(mcp_servers(), lambda s: node("mcp", s, 1.0 / n)))
    rows = x.select("session_key", "cost", "tokens", F.explode(F.concat(whole, split)).alias("n")).select("session_key", "cost", "tokens", "n.*")
    sums = rows.groupBy("kind", "label").agg(F.round(F.sum(F.col("cost") * F.col("share")), 6).alias("cost"), F.round(F.sum(F.col("tokens") * F.col("share")), 4).alias("tokens"), F.count("*").alias("calls"), F.count_distinct("session_key").alias("sessions"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("cost"), "label")).cast("long")
    limit = F.coalesce(F.create_map(*[F.lit(v) for pair in NODE_LIMITS.items() for v in pair])[F.col("kind")].cast("long"), F.lit((1 << 62)))
    return sums.withColumn("place", place).where(F.col("place") <= limit)


# Edges kept of each project; other relations have no limit.
EDGE_LIMITS = {"project_model": 6, "project_core": 5, "project_mcp": 5}


def all_graph_edges(x: DataFrame) -> DataFrame:
    """Edges of graph_edges with capabilities as core tools and MCP servers apart, of projects and of tools."""
    end = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    uses = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), end(kind, n).alias("id")))
    rows = x.withColumn("uses", F.concat(uses("core", core_tools()), uses("mcp", mcp_servers())))
    edge = lambda relation, a, b, share: F.struct(relation.alias("relation"), a.alias("source"), b.alias("target"), share.alias("share"))
    p, t, m, one = end("project", F.col("identity")), end("tool", F.col("tool")), end("model", F.col("canonical")), F.lit(1.0)
    whole = F.array(edge(F.lit("project_tool"), p, t, one), edge(F.lit("project_model"), p, m, one), edge(F.lit("tool_model"), t, m, one))
    shared = lambda kind, a: F.transform("uses", lambda u: edge(F.concat(F.lit(f"{kind}_"), u["kind"]), a, u["id"], 1.0 / F.size("uses")))
    split = [shared("project", p), shared("tool", t)]
    made = rows.select("session_key", "cost", "tokens", F.explode(F.concat(whole, *split)).alias("e")).select("session_key", "cost", "tokens", "e.*")
    return made.groupBy("relation", "source", "target").agg(F.round(F.sum(F.col("cost") * F.col("share")), 6).alias("cost"), F.round(F.sum(F.col("tokens") * F.col("share")), 4).alias("tokens"), F.count("*").alias("calls"), F.count_distinct("session_key").alias("sessions"))


def kept_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between nodes that are kept, the costliest of each project up to EDGE_LIMITS."""
    ids = nodes.select(F.concat_ws(":", "kind", "label").alias("id"))
    for c in ("source", "target"):
        edges = edges.join(ids, F.col(c) == F.col("id"), "left_semi")
    w = Window.partitionBy("relation", "source").orderBy(F.desc("cost"), "target")
    limit = F.create_map(*[F.lit(v) for pair in EDGE_LIMITS.items() for v in pair])[F.col("relation")]
    return edges.withColumn("place", F.row_number().over(w).cast("long")).where(limit.isNull() | (F.col("place") <= limit))


def kept_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that an edge of kept_edges has."""
    kept = kept_edges(edges, nodes)
    ends = kept.select(F.col("source").alias("id")).union(kept.select("target")).distinct()
    return nodes.join(ends, F.concat_ws(":", "kind", "label") == F.col("id"), "left_semi")
