"""The catalogue: every query by name, and the SQL that gives the same rows.

The time is fixed, and so is the zone (UTC), so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.columns import caps_letter_ratio
from ..operators import lookups, panels, prompt_rules, search, turns, usage
from ..sources import driver_tables as tables
from ..sources.driver_tables import CALLS_SQL
from . import activity_catalog, archive_catalog, practice_catalog, pricing_catalog, search_catalog, source_catalog

NOW = datetime(2024, 1, 31)
PRICE_CHANGE = datetime(1995, 1, 1)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _x(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return usage.enrich(tables.calls(spark, sf_dir))


def _over_calls(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(_x(spark, sf_dir))
    ORACLE_SQL[name] = f"WITH {CALLS_SQL}{sql}"


def _over(name: str, build: Query, sql: str) -> None:
    QUERIES[name] = build
    ORACLE_SQL[name] = sql


_SUMS = "round(sum(cost), 6) AS cost, count(*)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens"
_SESSIONS = "count(DISTINCT session_key)::BIGINT AS sessions"
_MONTH = "timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-02-01'"
_TODAY = "timestamp BETWEEN TIMESTAMP '2024-01-30' AND TIMESTAMP '2024-01-31'"
_CACHE = "round(coalesce(100.0::DOUBLE * sum(cache_read_tokens)::DOUBLE / nullif(sum(input_tokens) + sum(cache_read_tokens) + sum(cache_write_tokens), 0)::DOUBLE, 0), 6)"


def _bar(value: str, largest: str) -> str:
    return f"(CASE WHEN {largest} <= 0 THEN 0 ELSE least(greatest(round(100.0::DOUBLE * {value} / {largest}), 1), 100) END)::BIGINT"


_over_calls("A01_period_totals", lambda x: usage.period_totals(usage.of_period(x, "month", NOW)), f"""
SELECT round(sum(cost), 6) AS cost, count(*)::BIGINT AS calls, {_SESSIONS}, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
       sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(cache_write_tokens)::BIGINT AS cache_write_tokens FROM x WHERE {_MONTH}""")
_over_calls("A02_tool_totals", lambda x: usage.by(usage.of_period(x, "month", NOW), "tool"), f"""
SELECT tool, {_SUMS}, {_SESSIONS}, max(timestamp) AS latest FROM x WHERE {_MONTH} GROUP BY tool""")
_over_calls("A03_dashboard_summary", lambda x: usage.dashboard_summary(usage.of_period(x, "month", NOW)), f"""
SELECT {_SUMS}, {_SESSIONS}, {_CACHE} AS cache_hit_pct FROM x WHERE {_MONTH}""")
_over_calls("A04_daily", usage.daily, f"""
SELECT timestamp::DATE AS day, {_SUMS} FROM x GROUP BY ALL""")
_over_calls("A06_dense_hours", lambda x: usage.dense_hours(x, NOW, 168), f"""
, s AS (SELECT date_trunc('hour', timestamp) AS hour, {_SUMS} FROM x GROUP BY ALL)
SELECT g.hour::TIMESTAMP AS hour, coalesce(cost, 0)::DOUBLE AS cost, coalesce(calls, 0)::BIGINT AS calls, coalesce(tokens, 0)::BIGINT AS tokens
FROM generate_series(TIMESTAMP '2024-01-24 01:00:00', TIMESTAMP '2024-01-31 00:00:00', INTERVAL 1 HOUR) AS g(hour) LEFT JOIN s ON s.hour = g.hour""")
_over_calls("A07_dense_days", lambda x: usage.dense_days(x, NOW, 40), f"""
, s AS (SELECT timestamp::DATE AS day, {_SUMS} FROM x GROUP BY ALL)
SELECT g.day::DATE AS day, coalesce(cost, 0)::DOUBLE AS cost, coalesce(calls, 0)::BIGINT AS calls, coalesce(tokens, 0)::BIGINT AS tokens
FROM generate_series(TIMESTAMP '2023-12-23', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) AS g(day) LEFT JOIN s ON s.day = g.day::DATE""")
_PROJECTS = f"(SELECT identity, {_SUMS}, {_SESSIONS}, max(timestamp) AS latest FROM x GROUP BY identity)"
for _mode, _order, _first in (("spend", "cost DESC, tokens DESC, latest DESC", "cost"), ("tokens", "tokens DESC, cost DESC, latest DESC", "tokens")):
    _over_calls(f"A08_projects_by_{_mode}", lambda x, m=_mode: usage.ranked(usage.by(x, "identity"), "identity", m, 10), f"""
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {_order}, identity)::BIGINT AS rank, {_bar(_first, f'max({_first}) OVER ()')} AS bar FROM {_PROJECTS}) WHERE rank <= 10""")
_over_calls("K01_projects_by_date", lambda x: usage.ranked(usage.by(x, "identity"), "identity", "date", 10), f"""
SELECT * FROM (SELECT *, {_bar('(n - rank + 1)', 'n')} AS bar FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY latest DESC, cost DESC, tokens DESC, identity)::BIGINT AS rank FROM {_PROJECTS})) WHERE rank <= 10""".replace("SELECT * FROM (SELECT *, (CASE", "SELECT * EXCLUDE (n) FROM (SELECT *, (CASE"))
_over_calls("A10_project_tools", lambda x: usage.by(x, "identity", "tool"), f"""
SELECT identity, tool, {_SUMS}, {_SESSIONS}, max(timestamp) AS latest FROM x GROUP BY identity, tool""")
_over_calls("A11_session_report", usage.session_report, f"""
SELECT session_key, {_SUMS}, arg_min(identity, seq) AS project, min(timestamp) AS first_ts, max(timestamp) AS last_ts,
       (epoch_us(max(timestamp)) - epoch_us(min(timestamp)))::BIGINT // 60000000 AS minutes FROM x WHERE session_key IS NOT NULL GROUP BY session_key""")
_over_calls("A14_models", usage.models, f"""
SELECT canonical, {_SUMS}, max(timestamp) AS latest, {_CACHE} AS cache_pct FROM x GROUP BY canonical""")
_SHARE = "round(sum(cost / n), 6) AS cost, count(*)::BIGINT AS calls, round(sum(tokens / n), 6) AS tokens"
for _name, _label, _items, _sql in (
    ("A17_core_tools", "core_tool", usage.core_tools, "list_filter(tools, lambda t: NOT starts_with(t, 'mcp__'))"),
    ("A18_commands", "command", usage.command_heads, "list_transform(commands, lambda c: split_part(trim(c), ' ', 1))"),
    ("A19_mcp_servers", "server", usage.mcp_servers, "list_transform(list_filter(tools, lambda t: starts_with(t, 'mcp__')), lambda t: split_part(t, '__', 2))"),
):
    _over_calls(_name, lambda x, i=_items, c=_label: usage.fair_share(x, i(), c), f"""
SELECT {_label}, {_SHARE} FROM (SELECT cost, tokens, len(items) AS n, unnest(items) AS {_label} FROM (SELECT cost, tokens, {_sql} AS items FROM x)) GROUP BY ALL""")
_over_calls("A22_project_options", usage.project_options, f"""
SELECT '(all)' AS project, {_SUMS} FROM x UNION ALL SELECT identity, {_SUMS} FROM x GROUP BY identity""")
_over_calls("A23_project_index", lambda x: usage.by(x, "identity"), f"SELECT * FROM {_PROJECTS}")
_over_calls("A25_project_inventory", lambda x: usage.by(x, "identity", "tool", "project"), f"""
SELECT identity, tool, project, {_SUMS}, {_SESSIONS}, max(timestamp) AS latest FROM x GROUP BY identity, tool, project""")
_GRID = "(SELECT isodow(timestamp)::BIGINT - 1 AS weekday, hour(timestamp)::BIGINT AS hour, sum(greatest(tokens, 1))::BIGINT AS amount FROM x GROUP BY ALL)"
_over_calls("A26_heat_grid", usage.heat_grid, f"SELECT * FROM {_GRID}")
_over_calls("A26_tool_shares", usage.tool_shares, """
SELECT tool, cost, round(1000 * cost / sum(cost) OVER ())::BIGINT AS per_mille FROM (SELECT tool, round(sum(cost), 6) AS cost FROM x GROUP BY tool)""")
_over_calls("V01_hourly_profile", usage.hourly_profile, f"SELECT hour, weekday >= 5 AS weekend, sum(amount)::BIGINT AS amount FROM {_GRID} GROUP BY ALL")
_over_calls("V02_heat_levels", usage.heat_levels, f"SELECT *, least(floor(amount / max(amount) OVER () * 4) + 1, 4)::BIGINT AS level FROM {_GRID}")
_over_calls("A31_report_activity", usage.report_activity, f"""
SELECT *, {_bar('tokens', 'max(tokens) OVER ()')} AS intensity FROM (SELECT timestamp::DATE AS day, {_SUMS} FROM x GROUP BY ALL)""")
_over_calls("A36_report_models", lambda x: usage.by(x, "canonical", "tool"), f"""
SELECT canonical, tool, {_SUMS}, {_SESSIONS}, max(timestamp) AS latest FROM x GROUP BY canonical, tool""")
_over_calls("A37_full_attribution", lambda x: usage.full_attribution(x, usage.mcp_servers(), "server"), f"""
SELECT server, {_SUMS} FROM (SELECT cost, tokens, split_part(unnest(list_filter(tools, lambda t: starts_with(t, 'mcp__'))), '__', 2) AS server FROM x) GROUP BY ALL""")
_over_calls("A40_insights", usage.insights, """
, p AS (SELECT identity AS v, round(sum(cost), 6) AS c, sum(tokens) AS t, count(*) AS n FROM x GROUP BY 1), m AS (SELECT canonical AS v, round(sum(cost), 6) AS c, sum(tokens) AS t, count(*) AS n FROM x GROUP BY 1),
d AS (SELECT timestamp::DATE AS v, round(sum(cost), 6) AS c, sum(tokens) AS t, count(*) AS n FROM x GROUP BY 1)
SELECT count(*)::BIGINT AS calls, count(DISTINCT timestamp::DATE)::BIGINT AS active_days, min(timestamp::DATE) AS first_day, max(timestamp::DATE) AS last_day,
       (SELECT v FROM p ORDER BY c DESC, t DESC, n DESC, v DESC LIMIT 1) AS top_identity, (SELECT v FROM m ORDER BY c DESC, t DESC, n DESC, v DESC LIMIT 1) AS top_canonical,
       (SELECT v FROM d ORDER BY c DESC, t DESC, n DESC, v DESC LIMIT 1) AS top_day, round(count(*) / count(DISTINCT timestamp::DATE), 6) AS calls_per_day FROM x""")
_over_calls("A42_usage_delta", lambda x: usage.usage_totals_delta(x, datetime(2024, 1, 20)), f"""
SELECT {_SUMS}, round(sum(cost) FILTER (timestamp > TIMESTAMP '2024-01-20'), 6) AS new_cost, (count(*) FILTER (timestamp > TIMESTAMP '2024-01-20'))::BIGINT AS new_calls,
       (sum(tokens) FILTER (timestamp > TIMESTAMP '2024-01-20'))::BIGINT AS new_tokens FROM x""")
for _period, _where in (("today", _TODAY), ("week", "timestamp >= TIMESTAMP '2024-01-25'"), ("30d", "timestamp >= TIMESTAMP '2024-01-02'"), ("all", "true")):
    _over_calls(f"F01_period_{_period}", lambda x, p=_period: usage.by(usage.of_period(x, p, NOW), "tool", "identity"), f"""
SELECT tool, identity, {_SUMS}, {_SESSIONS}, max(timestamp) AS latest FROM x WHERE {_where} GROUP BY tool, identity""")
_over_calls("J02_canonical_models", lambda x: x.groupBy("model", "canonical").agg(F.count("*").alias("calls")), """
SELECT model, canonical, count(*)::BIGINT AS calls FROM x GROUP BY ALL""")


def _priced(x: DataFrame) -> DataFrame:
    return lookups.priced(x, lookups.price_book(x.sparkSession)).groupBy("tool", "canonical", "is_fallback").agg(F.round(F.sum("priced_cost"), 4).alias("priced_cost"), F.count("*").alias("calls"))


def _value(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"


_over_calls("J03_priced_calls", _priced, f"""
, book AS (SELECT scope::VARCHAR AS scope, key, effective_from::DATE AS effective_from, p_in, p_out, p_write, p_read FROM (VALUES {', '.join('(' + ', '.join(map(_value, p)) + ')' for p in lookups.PRICES)}) AS t(scope, key, effective_from, p_in, p_out, p_write, p_read)),
keys AS (SELECT DISTINCT tool, canonical, timestamp::DATE AS day FROM x),
best AS (SELECT * FROM (SELECT keys.*, p_in, p_out, p_write, p_read, row_number() OVER (PARTITION BY tool, canonical, day ORDER BY scope IS NOT NULL DESC, key = canonical DESC, length(key) DESC, effective_from DESC NULLS LAST) AS place
  FROM keys JOIN book ON (scope IS NULL OR scope = tool) AND starts_with(canonical, key) AND (effective_from IS NULL OR effective_from <= day)) WHERE place = 1)
SELECT x.tool, x.canonical, p_in IS NULL AS is_fallback, count(*)::BIGINT AS calls,
       round(sum((input_tokens * coalesce(p_in, {lookups.FALLBACK[0]}::DOUBLE) + output_tokens * coalesce(p_out, {lookups.FALLBACK[1]}::DOUBLE) + cache_write_tokens * coalesce(p_write, {lookups.FALLBACK[2]}::DOUBLE) + cache_read_tokens * coalesce(p_read, {lookups.FALLBACK[3]}::DOUBLE)) / 1000000), 4) AS priced_cost
FROM x LEFT JOIN best ON x.tool = best.tool AND x.canonical = best.canonical AND x.timestamp::DATE = best.day GROUP BY ALL""")
_over("J03_as_of_prices", lambda spark, d: lookups.as_of_prices(spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/part.parquet"), PRICE_CHANGE).groupBy("l_partkey").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("price") * F.col("l_quantity")), 4).alias("amount")), """
SELECT l_partkey, count(*)::BIGINT AS lines, round(sum(CASE WHEN l_shipdate >= TIMESTAMP '1995-01-01' THEN p_retailprice * 1.1::DOUBLE ELSE p_retailprice END * l_quantity), 4) AS amount
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey""")
_over_calls("J10_project_labels", lookups.project_labels, """
, i AS (SELECT DISTINCT identity, list_filter(string_split(identity, '/'), lambda p: p <> '') AS parts FROM x),
s AS (SELECT identity, n, array_to_string(parts[len(parts) - n + 1:], '/') AS suffix FROM (SELECT *, unnest(generate_series(1, len(parts))) AS n FROM i)),
u AS (SELECT suffix, any_value(identity) AS identity, min(n) AS n FROM s GROUP BY suffix HAVING count(DISTINCT identity) = 1)
SELECT i.identity, coalesce((SELECT arg_min(suffix, n) FROM u WHERE u.identity = i.identity), i.identity) AS label FROM i""")
_LATEST = """WITH l AS (SELECT o_orderkey AS seq, ['claude-code', 'cursor', 'codex', 'copilot', 'gemini'][(o_custkey % 5 + 1)::INT] AS tool, 'l' || (o_custkey % 3) AS limit_id, o_orderdate AS observed_at,
  o_totalprice % 100 AS used_percent, CASE WHEN o_orderstatus = 'F' THEN 300 ELSE 10080 END::BIGINT AS window_minutes, o_orderstatus AS plan_type FROM orders)"""
_over("J11_limit_status", lambda spark, d: lookups.limit_status(tables.limit_snapshots(spark, d), NOW), _LATEST + """
SELECT tool, limit_id, round(used_percent, 6) AS used_percent, window_minutes, observed_at + to_minutes(window_minutes) < TIMESTAMP '2024-01-31' AS is_stale,
       observed_at + to_minutes(window_minutes) + INTERVAL 7 DAY < TIMESTAMP '2024-01-31' AS is_hidden
FROM (SELECT *, row_number() OVER (PARTITION BY tool, limit_id ORDER BY observed_at DESC, seq DESC) AS place FROM l) WHERE place = 1""")
_over("J12_detected_plans", lambda spark, d: lookups.detected_plans(tables.limit_snapshots(spark, d)), _LATEST + """
SELECT tool, plan_type FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY observed_at DESC, seq DESC) AS place FROM l) WHERE place = 1""")
_over_calls("O01_first_wins", lambda x: lookups.first_wins(x.withColumn("dedup_key", F.concat("session_id", F.lit("/"), "model"))).select("tool", "dedup_key", "seq"), """
SELECT tool, session_id || '/' || model AS dedup_key, min(seq) AS seq FROM x GROUP BY 1, 2""")
_TURNS = """
, f AS (SELECT *, coalesce(session_key, tool || ':' || identity) AS skey, CASE WHEN timestamp_quality = 'exact' THEN timestamp END AS exact FROM x),
g AS (SELECT *, CASE WHEN lag(seq) OVER w IS NULL OR lag(prompt_chars) OVER w IS DISTINCT FROM prompt_chars THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY skey ORDER BY timestamp NULLS FIRST, seq)),
h AS (SELECT *, sum(new) OVER (PARTITION BY skey ORDER BY timestamp NULLS FIRST, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS turn FROM g),
t AS (SELECT skey, turn, min(tool) AS tool, count(*)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens, round(sum(cost), 6) AS cost, max(prompt_chars) AS prompt_chars, sum(output_tokens)::BIGINT AS output_tokens,
  sum(input_tokens)::BIGINT AS input_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens, max(elapsed_ms) AS elapsed_ms, min(exact) AS start, max(exact) AS "end", bool_or(is_canceled) AS is_canceled, sum(len(tools))::BIGINT AS tool_calls
  FROM h GROUP BY skey, turn)
"""
_over_calls("C02_turns", turns.turns, _TURNS + "SELECT * FROM t")
_over_calls("C03_think_gaps", lambda x: turns.think_gaps(turns.turns(x)), _TURNS + """
SELECT * FROM (SELECT skey, turn, ((epoch_us(lead(start) OVER w) - epoch_us("end")) // 1000 - coalesce(lead(elapsed_ms) OVER w, 0))::BIGINT AS gap_ms FROM t WINDOW w AS (PARTITION BY skey ORDER BY turn)) WHERE gap_ms IS NOT NULL""")
_BLOCKS = """
, b0 AS (SELECT *, CASE WHEN (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) // 60000000 <= 15 THEN 0 ELSE 1 END AS new FROM x WHERE session_key IS NOT NULL WINDOW w AS (PARTITION BY session_key ORDER BY timestamp, seq)),
b1 AS (SELECT *, sum(new) OVER (PARTITION BY session_key ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM b0),
b AS (SELECT session_key, block, min(timestamp) AS start, max(timestamp) AS "end", count(*)::BIGINT AS calls, round(sum(cost), 6) AS cost FROM b1 GROUP BY session_key, block)
"""
_over_calls("C10_activity_blocks", turns.activity_blocks, _BLOCKS + "SELECT * FROM b")
_over_calls("C11_max_concurrency", turns.max_concurrency, _BLOCKS + """
, n AS (SELECT *, unnest(generate_series(start::DATE::TIMESTAMP, "end"::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM b),
m AS (SELECT day, CASE WHEN day = start::DATE THEN hour(start) * 60 + minute(start) ELSE 0 END AS lo, CASE WHEN day = "end"::DATE THEN hour("end") * 60 + minute("end") ELSE 1439 END AS hi FROM n),
e AS (SELECT day, lo AS mark, 1 AS step FROM m UNION ALL SELECT day, hi + 1, -1 FROM m),
s AS (SELECT day, mark, sum(step) AS step FROM e GROUP BY day, mark)
SELECT day, max(active)::BIGINT AS most FROM (SELECT day, sum(step) OVER (PARTITION BY day ORDER BY mark) AS active FROM s) GROUP BY day""")
_over_calls("C05_flow_days", lambda x: turns.flow_days(x, NOW), """
, s AS (SELECT session_key, timestamp::DATE AS day, min(timestamp) AS start, max(timestamp) AS fin FROM x WHERE session_key IS NOT NULL AND timestamp_quality = 'exact' GROUP BY 1, 2),
g AS (SELECT *, max(fin) OVER (PARTITION BY day ORDER BY start, fin, session_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
h AS (SELECT *, sum(CASE WHEN (epoch_us(start) - epoch_us(before)) / 60000000 < 16 THEN 0 ELSE 1 END) OVER (PARTITION BY day ORDER BY start, fin, session_key ROWS UNBOUNDED PRECEDING) AS block FROM g),
k AS (SELECT day, block, (epoch_us(max(fin)) - epoch_us(min(start))) // 60000000 AS minutes FROM h GROUP BY day, block)
SELECT day, count(*)::BIGINT AS blocks, max(minutes)::BIGINT AS longest, sum(minutes)::BIGINT AS active FROM k GROUP BY day""")
_over_calls("C07_streaks", lambda x: turns.streaks(turns.turns(x)), _TURNS + """
, d AS (SELECT DISTINCT start::DATE AS day FROM t WHERE start IS NOT NULL), i AS (SELECT day, day - row_number() OVER (ORDER BY day)::INT AS island FROM d)
SELECT min(day) AS first_day, count(*)::BIGINT AS days FROM i GROUP BY island""")
_over_calls("C12_calendar", lambda x: turns.calendar(turns.turns(x)), _TURNS + "SELECT start::DATE AS day, count(*)::BIGINT AS turns FROM t WHERE start IS NOT NULL GROUP BY 1")
_over_calls("C08_output_by_language", turns.output_by_language, """
SELECT language, sum(loc)::BIGINT AS loc, count(*)::BIGINT AS blocks FROM x WHERE language IS NOT NULL GROUP BY language""")
_over_calls("C09_half_hours", turns.half_hours, """
SELECT time_bucket(INTERVAL 30 MINUTE, timestamp) AS start, count(*)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens FROM x GROUP BY 1""")
_RULES = _TURNS + """
, a AS (SELECT count(*) FILTER (output_tokens > 5000 AND prompt_chars > 0 AND prompt_chars < 200) AS wordy, count(prompt_chars) AS prompts, count(start) AS timed, count(*) FILTER (hour(start) < 5) AS late,
  count(*) FILTER (isodow(start) >= 6) AS weekend, count(*) FILTER (is_canceled) AS canceled, count(*) AS turns, count(*) FILTER (elapsed_ms > 300000) AS slow, count(elapsed_ms) AS measured, count(*) FILTER (tool_calls >= 40) AS runaway,
  count(*) FILTER (input_tokens + cache_read_tokens > 5000) AS large,
  coalesce(sum(cache_read_tokens) FILTER (input_tokens + cache_read_tokens > 5000)::DOUBLE / sum(input_tokens + cache_read_tokens) FILTER (input_tokens + cache_read_tokens > 5000)::DOUBLE, 1) AS hit FROM t),
s AS (SELECT count(*) FILTER (n >= 50) AS mega, count(*) FILTER (n = 1) AS abandoned, count(*) AS sessions FROM (SELECT count(*) AS n FROM t GROUP BY skey)),
r AS (SELECT unnest([
  {'rule': 'verbose-output', 'severity': 'medium', 'occurrences': wordy, 'total': prompts, 'fires': wordy > 10 AND wordy > 0.1 * prompts},
  {'rule': 'late-night-coding', 'severity': 'low', 'occurrences': late, 'total': timed, 'fires': late > 10},
  {'rule': 'weekend-overwork', 'severity': 'low', 'occurrences': weekend, 'total': timed, 'fires': weekend > 20 AND weekend > 0.25 * timed},
  {'rule': 'mega-sessions', 'severity': 'high', 'occurrences': mega, 'total': sessions, 'fires': mega > 0},
  {'rule': 'abandon-sessions', 'severity': 'low', 'occurrences': abandoned, 'total': sessions, 'fires': abandoned > 10 AND abandoned > 0.4 * sessions},
  {'rule': 'high-cancellation', 'severity': 'medium', 'occurrences': canceled, 'total': turns, 'fires': canceled > 0.15 * turns},
  {'rule': 'slow-responses', 'severity': 'low', 'occurrences': slow, 'total': measured, 'fires': slow > 5},
  {'rule': 'runaway-agent-loops', 'severity': 'high', 'occurrences': runaway, 'total': turns, 'fires': runaway >= 3},
  {'rule': 'cache-hit-starvation', 'severity': 'medium', 'occurrences': large, 'total': turns, 'fires': large > 20 AND hit < 0.1}], recursive := true) FROM a, s)
"""
_over_calls("R01_practice_rules", lambda x: turns.rules(turns.turns(x)), _RULES + "SELECT * FROM r")
_over_calls("C15_practice_score", lambda x: turns.score(turns.rules(turns.turns(x))), _RULES + """
SELECT count(*)::BIGINT AS rules, round(100 * (1 - sum(CASE WHEN NOT fires THEN 0 WHEN severity = 'high' THEN 12 WHEN severity = 'medium' THEN 7 ELSE 3 END) / (count(*) * 12)))::BIGINT AS score FROM r""")
_EDGES = """
, u AS (SELECT *, list_concat(list_transform(list_filter(tools, lambda t: NOT starts_with(t, 'mcp__')), lambda t: 'core:' || t), list_transform(list_filter(tools, lambda t: starts_with(t, 'mcp__')), lambda t: 'mcp:' || split_part(t, '__', 2))) AS uses FROM x),
e AS (SELECT session_key, cost, tokens, 'project_tool' AS relation, 'project:' || identity AS source, 'tool:' || tool AS target, 1.0::DOUBLE AS share FROM u
  UNION ALL SELECT session_key, cost, tokens, 'project_model', 'project:' || identity, 'model:' || canonical, 1.0 FROM u UNION ALL SELECT session_key, cost, tokens, 'tool_model', 'tool:' || tool, 'model:' || canonical, 1.0 FROM u
  UNION ALL SELECT session_key, cost, tokens, 'project_capability', 'project:' || identity, unnest(uses), 1.0::DOUBLE / len(uses) FROM u),
g AS (SELECT relation, source, target, round(sum(cost * share), 6) AS cost, round(sum(tokens * share), 4) AS tokens, count(*)::BIGINT AS calls, count(DISTINCT session_key)::BIGINT AS sessions FROM e GROUP BY ALL)
"""
_over_calls("G01_graph_edges", turns.graph_edges, _EDGES + "SELECT * FROM g")
_over_calls("G04_bounded_edges", lambda x: turns.bounded_edges(turns.graph_edges(x)), _EDGES + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY relation, source ORDER BY cost DESC, target)::BIGINT AS place FROM g) WHERE place <= 5""")
_SEARCH = r"""
WITH p AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
d AS (SELECT 'c' || conv_id || '-' || turn AS dedup_key, ['claude-code', 'cursor', 'codex', 'copilot', 'gemini'][(conv_id % 5 + 1)::INT] AS tool, conv_id::VARCHAR AS session_id, CASE WHEN next_role = 'assistant' THEN 'full' ELSE 'prompt' END AS origin,
  list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS u,
  list_filter(regexp_split_to_array(lower(CASE WHEN next_role = 'assistant' THEN coalesce(next_text, '') ELSE '' END), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS a FROM p WHERE role = 'user'),
h AS (SELECT *, len(u) + len(a) AS length, len(list_filter(u, lambda t: t = 'the')) AS u0, len(list_filter(a, lambda t: t = 'the')) AS a0, len(list_filter(u, lambda t: starts_with(t, 'tion'))) AS u1, len(list_filter(a, lambda t: starts_with(t, 'tion'))) AS a1 FROM d),
s AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (u0 + a0 > 0) AS df0, count(*) FILTER (u1 + a1 > 0) AS df1 FROM h),
k AS (SELECT h.*, -greatest(ln((n - df0 + 0.5) / (df0 + 0.5)), 1e-6) * (u0 * 2.0 + a0) * 2.2 / (u0 * 2.0 + a0 + 1.2 * (0.25 + 0.75 * length / mean)) - greatest(ln((n - df1 + 0.5) / (df1 + 0.5)), 1e-6) * (u1 * 2.0 + a1) * 2.2 / (u1 * 2.0 + a1 + 1.2 * (0.25 + 0.75 * length / mean)) AS rank
  FROM h, s WHERE u0 + a0 > 0 AND u1 + a1 > 0)
SELECT tool, session_id, count(*)::BIGINT AS hits, round(min(rank), 6) AS best, count(*) FILTER (origin = 'full') = 0 AS prompt_only FROM k GROUP BY tool, session_id
"""
_over("Q04_search_sessions", lambda spark, d: search.session_hits(search.search(tables.transcripts(spark, d), 'the "tion"')), _SEARCH)
_over("X10_caps_ratio", lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.round(caps_letter_ratio(F.col("text")), 6).alias("caps")), """
SELECT doc_id, round(length(regexp_replace(left(text, 2000), '[^A-Z]', '', 'g')) / nullif(length(regexp_replace(left(text, 2000), '[^A-Za-z]', '', 'g')), 0), 6) AS caps FROM documents""")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _has(text: str, phrases) -> str:
    return f"regexp_matches(lower({text}), {_quoted(texts.phrase_pattern(phrases))})"


def _signals_sql(text: str) -> str:
    """The columns of prompt_rules.signals over a text that isn't null."""
    types = " ".join(f"WHEN {_has(f'left({text}, 300)', p)} THEN {_quoted(n)}" for n, p in texts.WORK_TYPES)
    words = f"list_filter(regexp_split_to_array(left({text}, 2000), '\\s+'), lambda w: length(w) >= 3)"
    loud = f"list_filter({words}, lambda w: regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]'))"
    return f"""{_has(f'left({text}, 500)', texts.CONSTRAINTS)} AS "constraint", contains({text}, '!!!') OR contains({text}, '???') OR {_has(text, texts.FRUSTRATION)} AS frustrated,
  regexp_matches(lower({text}), {_quoted('^[[:space:]]*(' + '|'.join(texts.LOOKUPS) + ')')}) AS lookup, {_has(text, texts.REFINEMENTS)} AS refinement,
  regexp_matches({text}, {_quoted(texts.SPEC_LINE)}) OR len(string_split(regexp_replace({text}, '\\n$', ''), chr(10))) >= 4 OR {_has(text, texts.SPEC_WORDS)} AS spec,
  ({' + '.join(f'{_has(text, [p])}::BIGINT' for p in texts.FILLERS)})::BIGINT AS fillers, round(coalesce(len({loud}) / nullif(len({words}), 0), 0), 6)::DOUBLE AS caps_words, CASE {types} ELSE 'feature' END AS work_type"""


_over("X12_prompt_signals", lambda spark, d: prompt_rules.signals(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).drop("text"), f"""
SELECT doc_id, {_signals_sql('text')} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
_over("R01_prompt_rules", lambda spark, d: prompt_rules.prompt_rules(tables.transcripts(spark, d)), f"""
WITH u AS (SELECT conv_id::VARCHAR AS session_id, text AS user_text FROM conversations WHERE role = 'user' AND text <> ''),
p AS (SELECT *, length(user_text) AS chars, coalesce(length(regexp_replace(left(user_text, 2000), '[^A-Z]', '', 'g')) / nullif(length(regexp_replace(left(user_text, 2000), '[^A-Za-z]', '', 'g')), 0), 0) AS caps, {_signals_sql('user_text')} FROM u),
a AS (SELECT count(*) AS prompts, count(*) FILTER (chars < 30) AS lazy, count(*) FILTER (chars >= 10 AND caps >= 0.9) AS caps, count(*) FILTER (chars >= 10 AND (frustrated OR caps_words >= 0.4)) AS frustrated,
  count(*) FILTER (chars >= 40) AS lengthy, count(*) FILTER (chars >= 40 AND NOT "constraint") AS loose, count(*) FILTER (chars >= 800 AND fillers >= 2) AS wordy FROM p),
k AS (SELECT coalesce(sum(n), 0)::BIGINT AS repeated FROM (SELECT count(*) AS n FROM p GROUP BY lower(trim(left(user_text, 100))) HAVING count(*) >= 3 AND length(lower(trim(left(any_value(user_text), 100)))) >= 10)),
s AS (SELECT count(*) FILTER (n >= 5 AND types >= 4) AS drifted, count(*) AS sessions FROM (SELECT count(*) AS n, count(DISTINCT work_type) AS types FROM p GROUP BY session_id))
SELECT unnest([
  {{'rule': 'lazy-prompting', 'severity': 'medium', 'occurrences': lazy, 'total': prompts, 'fires': lazy > 10 AND lazy > 0.3 * prompts}},
  {{'rule': 'caps-lock', 'severity': 'medium', 'occurrences': caps, 'total': prompts, 'fires': caps >= 1}},
  {{'rule': 'frustration-signals', 'severity': 'medium', 'occurrences': frustrated, 'total': prompts, 'fires': frustrated >= 2}},
  {{'rule': 'repeated-prompts', 'severity': 'medium', 'occurrences': repeated, 'total': prompts, 'fires': repeated >= 3}},
  {{'rule': 'low-constraint-usage', 'severity': 'medium', 'occurrences': loose, 'total': lengthy, 'fires': lengthy >= 30 AND loose > 0.92 * lengthy}},
  {{'rule': 'verbose-prompt', 'severity': 'low', 'occurrences': wordy, 'total': prompts, 'fires': wordy > 15 AND wordy > 0.2 * prompts}},
  {{'rule': 'session-drift', 'severity': 'medium', 'occurrences': drifted, 'total': sessions, 'fires': drifted > 3}}], recursive := true) FROM a, k, s""")
_over_calls("R20_output_rules", prompt_rules.output_rules, _TURNS + """
, q AS (SELECT skey, turn, ((epoch_us(lead(start) OVER w) - epoch_us("end")) // 1000 - coalesce(lead(elapsed_ms) OVER w, 0))::BIGINT AS gap_ms FROM t WINDOW w AS (PARTITION BY skey ORDER BY turn)),
o AS (SELECT skey, turn, coalesce(sum(loc), 0) AS loc, arg_min(project, seq) AS project, arg_min(canonical, seq) AS canonical FROM h GROUP BY skey, turn),
a AS (SELECT count(*) FILTER (loc >= 20 AND gap_ms BETWEEN 0 AND 15000) AS quick, count(*) FILTER (loc >= 20) AS written, count(*) AS turns FROM o LEFT JOIN q USING (skey, turn)),
b AS (SELECT max(n) AS top_project, count(*) AS projects FROM (SELECT count(*) AS n FROM o GROUP BY project)), c AS (SELECT max(n) AS top_model, count(*) AS models FROM (SELECT count(*) AS n FROM o GROUP BY canonical)),
d AS (SELECT count(*) FILTER (n > 40) AS bloated, count(*) AS sessions FROM (SELECT len(list_distinct(flatten(list(tools)))) AS n FROM h GROUP BY skey))
SELECT unnest([
  {'rule': 'speed-accept', 'severity': 'high', 'occurrences': quick, 'total': written, 'fires': quick >= 5},
  {'rule': 'tunnel-vision', 'severity': 'low', 'occurrences': top_project, 'total': turns, 'fires': top_project > 0.95 * turns AND turns >= 50 AND projects >= 3},
  {'rule': 'mcp-tool-bloat', 'severity': 'medium', 'occurrences': bloated, 'total': sessions, 'fires': bloated >= 3},
  {'rule': 'model-overreliance', 'severity': 'medium', 'occurrences': top_model, 'total': turns, 'fires': turns > 10 AND models < 3 AND top_model > 0.8 * turns}], recursive := true) FROM a, b, c, d""")
_WEEKS = """
, y AS (SELECT * REPLACE ((isoyear(timestamp) * 53 + week(timestamp)) || '|' || coalesce(session_key, tool || ':' || identity) AS session_key) FROM x)
""" + _TURNS.replace("FROM x)", "FROM y)").replace("FROM h GROUP BY skey, turn)", "FROM h GROUP BY skey, turn),\nt2 AS (SELECT *, split_part(skey, '|', 1)::BIGINT AS week FROM t)")
_over_calls("C14_weekly_scores", prompt_rules.weekly_scores, _WEEKS + """
, a AS (SELECT week, count(*) FILTER (output_tokens > 5000 AND prompt_chars > 0 AND prompt_chars < 200) AS wordy, count(prompt_chars) AS prompts, count(start) AS timed, count(*) FILTER (hour(start) < 5) AS late,
  count(*) FILTER (isodow(start) >= 6) AS weekend, count(*) FILTER (is_canceled) AS canceled, count(*) AS turns, count(*) FILTER (elapsed_ms > 300000) AS slow, count(*) FILTER (tool_calls >= 40) AS runaway, count(*) FILTER (input_tokens + cache_read_tokens > 5000) AS large,
  coalesce(sum(cache_read_tokens) FILTER (input_tokens + cache_read_tokens > 5000)::DOUBLE / sum(input_tokens + cache_read_tokens) FILTER (input_tokens + cache_read_tokens > 5000)::DOUBLE, 1) AS hit FROM t2 GROUP BY week),
s AS (SELECT week, count(*) FILTER (n >= 50) AS mega, count(*) FILTER (n = 1) AS abandoned, count(*) AS sessions FROM (SELECT week, count(*) AS n FROM t2 GROUP BY week, skey) GROUP BY week)
SELECT week, 9::BIGINT AS rules, round(100 * (1 - ((CASE WHEN wordy > 10 AND wordy > 0.1 * prompts THEN 7 ELSE 0 END) + (CASE WHEN late > 10 THEN 3 ELSE 0 END) + (CASE WHEN weekend > 20 AND weekend > 0.25 * timed THEN 3 ELSE 0 END)
  + (CASE WHEN mega > 0 THEN 12 ELSE 0 END) + (CASE WHEN abandoned > 10 AND abandoned > 0.4 * sessions THEN 3 ELSE 0 END) + (CASE WHEN canceled > 0.15 * turns THEN 7 ELSE 0 END) + (CASE WHEN slow > 5 THEN 3 ELSE 0 END)
  + (CASE WHEN runaway >= 3 THEN 12 ELSE 0 END) + (CASE WHEN large > 20 AND hit < 0.1 THEN 7 ELSE 0 END)) / 108))::BIGINT AS score FROM a JOIN s USING (week)""")
_over_calls("A05_timeline_month", lambda x: panels.activity_timeline(x, "month", NOW), f"""
, s AS (SELECT timestamp::DATE AS day, {_SUMS} FROM x GROUP BY ALL)
SELECT g.day::DATE AS day, coalesce(cost, 0)::DOUBLE AS cost, coalesce(calls, 0)::BIGINT AS calls, coalesce(tokens, 0)::BIGINT AS tokens
FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) AS g(day) LEFT JOIN s ON s.day = g.day::DATE""")
_over_calls("A09_tool_mix", panels.tool_mix, """
, g AS (SELECT identity, tool, row_number() OVER (PARTITION BY identity ORDER BY round(sum(cost), 6) DESC, tool) AS place FROM x GROUP BY identity, tool)
SELECT identity, string_agg(tool, ' / ' ORDER BY place) AS mix FROM g WHERE place <= 3 GROUP BY identity""")
_over_calls("A12_session_options", panels.session_options, f"""
SELECT session_key, {_SUMS}, arg_min(tool, seq) AS tool, arg_min(identity, seq) AS project, max(timestamp) AS latest FROM x WHERE session_key IS NOT NULL GROUP BY session_key""")
_over_calls("A13_session_calls", lambda x: panels.session_calls(x, x.agg(F.min("session_key").alias("session_key"))), """
SELECT session_key, dedup_key, model, round(cost, 6) AS cost, input_tokens + cache_read_tokens AS input,
  array_to_string(list_concat(list_filter(tools, lambda t: NOT starts_with(t, 'mcp__')), list_transform(list_filter(tools, lambda t: starts_with(t, 'mcp__')), lambda t: 'mcp:' || split_part(t, '__', 2))), ',') AS used,
  row_number() OVER (ORDER BY x.cost DESC, tokens DESC, timestamp DESC, model, seq)::BIGINT AS rank FROM x WHERE session_key = (SELECT min(session_key) FROM x)""")
_over_calls("A15_model_catalog", panels.model_catalog, """
, g AS (SELECT canonical, tool, count(*) AS n, round(sum(cost), 6) AS c FROM x GROUP BY canonical, tool)
SELECT canonical, sum(n)::BIGINT AS calls, round(sum(c), 6) AS cost, string_agg(tool || '=' || n, ',' ORDER BY n DESC, tool) AS split FROM g GROUP BY canonical""")
_over_calls("A21_fallback_models", lambda x: panels.fallback_models(lookups.priced(x, lookups.price_book(x.sparkSession))), f"""
, k AS (SELECT DISTINCT tool, model, canonical, timestamp::DATE AS day FROM x)
SELECT DISTINCT tool, model FROM k WHERE NOT EXISTS (FROM (VALUES {', '.join('(' + ', '.join(map(_value, p[:3])) + ')' for p in lookups.PRICES)}) AS b(scope, key, since)
  WHERE (b.scope IS NULL OR b.scope = k.tool) AND starts_with(k.canonical, b.key) AND (b.since IS NULL OR b.since::DATE <= k.day))""")
_over_calls("A24_project_tool_split", lambda x: panels.project_tool_split(x, "/work/t1/app1"), f"""
SELECT *, round(cost / greatest(sessions, 1), 6) AS cost_per_session FROM (SELECT tool, {_SUMS}, {_SESSIONS}, max(timestamp) AS latest FROM x WHERE identity = '/work/t1/app1' GROUP BY tool)""")
_over_calls("A26_tool_stack", panels.tool_stack, """
SELECT timestamp::DATE AS day, tool, round(round(sum(cost), 6) * 10000)::BIGINT AS amount FROM x GROUP BY 1, 2""")
_over_calls("A27_recent_by_tool", lambda x: panels.recent_by_tool(x, NOW), f"""
, s AS (SELECT tool, date_trunc('hour', timestamp) AS hour, sum(tokens)::BIGINT AS tokens FROM x GROUP BY 1, 2),
d AS (SELECT t.tool, g.hour::TIMESTAMP AS hour, coalesce(s.tokens, 0)::BIGINT AS tokens FROM (SELECT DISTINCT tool FROM x) AS t CROSS JOIN generate_series(TIMESTAMP '2024-01-30 01:00:00', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR) AS g(hour)
  LEFT JOIN s ON s.tool = t.tool AND s.hour = g.hour)
SELECT *, CASE WHEN tokens > 0 THEN {_bar('tokens', 'max(tokens) OVER (PARTITION BY tool)')} ELSE 0 END::BIGINT AS bar FROM d""")
_over_calls("A29_newest_roots", panels.newest_roots, """
SELECT identity, max(timestamp) AS latest FROM x WHERE starts_with(identity, '/') GROUP BY identity ORDER BY latest DESC, identity LIMIT 25""")
_over_calls("A30_report_summary", panels.report_summary, f"""
SELECT round(sum(cost), 6) AS cost, count(*)::BIGINT AS calls, {_SESSIONS}, count(DISTINCT identity)::BIGINT AS projects, sum(tokens + reasoning_tokens)::BIGINT AS total_tokens FROM x""")
_over_calls("A32_report_projects", panels.report_projects, f"""
SELECT identity, {_SUMS}, string_agg(DISTINCT project, ',' ORDER BY project) AS paths FROM x GROUP BY identity""")
_over_calls("A41_heatmap_days", panels.heatmap_days, f"""
, s AS (SELECT timestamp::DATE AS day, {_SUMS} FROM x GROUP BY ALL)
SELECT g.day::DATE AS day, coalesce(cost, 0)::DOUBLE AS cost, coalesce(calls, 0)::BIGINT AS calls, coalesce(tokens, 0)::BIGINT AS tokens
FROM (SELECT unnest(generate_series((SELECT min(day) FROM s)::TIMESTAMP, (SELECT max(day) FROM s)::TIMESTAMP, INTERVAL 1 DAY)) AS day) AS g LEFT JOIN s ON s.day = g.day::DATE""")
_over_calls("C04_session_flow", lambda x: turns.session_flow(turns.turns(x)).withColumn("label", turns.flow_label(F.col("score"))), _TURNS + """
, fg AS (SELECT *, (epoch_us(lead(start) OVER w) - epoch_us("end")) // 1000 - coalesce(lead(elapsed_ms) OVER w, 0) AS gap FROM t WHERE start IS NOT NULL WINDOW w AS (PARTITION BY skey ORDER BY turn)),
fs AS (SELECT skey, count(*)::BIGINT AS turns, list(gap ORDER BY gap) FILTER (gap >= 0) AS gaps, arg_min(start, turn) AS start, arg_max("end", turn) AS fin FROM fg GROUP BY skey),
fm AS (SELECT *, ((epoch_us(fin) - epoch_us(start)) // 60000000)::BIGINT AS minutes, gaps[len(gaps) // 2 + 1] // 1000 AS median, len(list_filter(gaps, lambda v: v <= 30000)) / len(gaps) AS rapid FROM fs WHERE turns >= 3 AND len(gaps) > 0),
fp AS (SELECT *, least(greatest(round(round(0.40::DOUBLE * rapid * 100 + 0.30::DOUBLE * CASE WHEN median <= 10 THEN 100 WHEN median <= 30 THEN 80 WHEN median <= 60 THEN 60 WHEN median <= 120 THEN 40 WHEN median <= 300 THEN 20 ELSE 0 END
  + 0.15::DOUBLE * CASE WHEN minutes <= 5 THEN 20 WHEN minutes <= 15 THEN 50 WHEN minutes <= 40 THEN 90 WHEN minutes <= 90 THEN 80 ELSE 60 END + 0.15::DOUBLE * least(CASE WHEN minutes > 0 THEN turns / minutes ELSE turns END * 50.0::DOUBLE, 100), 6)), 0), 100)::BIGINT AS score FROM fm)
SELECT skey, start::DATE AS day, turns, minutes, score, CASE WHEN score >= 70 THEN 'deep' WHEN score >= 45 THEN 'moderate' WHEN score >= 25 THEN 'shallow' ELSE 'fragmented' END AS label FROM fp""")
_over_calls("G03_graph_nodes", turns.graph_nodes, """
, e AS (SELECT session_key, cost, tokens, 'project' AS kind, identity AS label, 1.0::DOUBLE AS share FROM x UNION ALL SELECT session_key, cost, tokens, 'tool', tool, 1.0 FROM x UNION ALL SELECT session_key, cost, tokens, 'model', canonical, 1.0 FROM x
  UNION ALL SELECT session_key, cost, tokens, CASE WHEN starts_with(c, 'mcp__') THEN 'mcp' ELSE 'core' END, CASE WHEN starts_with(c, 'mcp__') THEN split_part(c, '__', 2) ELSE c END, 1.0::DOUBLE / n FROM (SELECT session_key, cost, tokens, unnest(tools) AS c, len(tools) AS n FROM x)),
g AS (SELECT kind, label, round(sum(cost * share), 6) AS cost, round(sum(tokens * share), 4) AS tokens, count(*)::BIGINT AS calls, count(DISTINCT session_key)::BIGINT AS sessions FROM e GROUP BY kind, label)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY cost DESC, label)::BIGINT AS place FROM g) WHERE place <= CASE kind WHEN 'project' THEN 30 WHEN 'model' THEN 24 WHEN 'tool' THEN 1000000 ELSE 12 END""")

_KEPT = """
, u AS (SELECT session_key, cost, tokens, identity, tool, unnest(tools) AS c, len(tools) AS n FROM x),
cap AS (SELECT *, CASE WHEN starts_with(c, 'mcp__') THEN 'mcp' ELSE 'core' END AS kind, CASE WHEN starts_with(c, 'mcp__') THEN split_part(c, '__', 2) ELSE c END AS label FROM u),
n0 AS (SELECT session_key, cost, tokens, 'project' AS kind, identity AS label, 1.0::DOUBLE AS share FROM x UNION ALL SELECT session_key, cost, tokens, 'tool', tool, 1.0 FROM x UNION ALL SELECT session_key, cost, tokens, 'model', canonical, 1.0 FROM x
  UNION ALL SELECT session_key, cost, tokens, kind, label, 1.0::DOUBLE / n FROM cap),
n1 AS (SELECT kind, label, round(sum(cost * share), 6) AS cost, round(sum(tokens * share), 4) AS tokens, count(*)::BIGINT AS calls, count(DISTINCT session_key)::BIGINT AS sessions FROM n0 GROUP BY kind, label),
n2 AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY cost DESC, label)::BIGINT AS place FROM n1),
nodes AS (SELECT *, kind || ':' || label AS id FROM n2 WHERE kind = 'tool' OR place <= CASE kind WHEN 'project' THEN 30 WHEN 'model' THEN 24 ELSE 12 END),
e0 AS (SELECT session_key, cost, tokens, 'project_tool' AS relation, 'project:' || identity AS source, 'tool:' || tool AS target, 1.0::DOUBLE AS share FROM x
  UNION ALL SELECT session_key, cost, tokens, 'project_model', 'project:' || identity, 'model:' || canonical, 1.0 FROM x UNION ALL SELECT session_key, cost, tokens, 'tool_model', 'tool:' || tool, 'model:' || canonical, 1.0 FROM x
  UNION ALL SELECT session_key, cost, tokens, 'project_' || kind, 'project:' || identity, kind || ':' || label, 1.0::DOUBLE / n FROM cap UNION ALL SELECT session_key, cost, tokens, 'tool_' || kind, 'tool:' || tool, kind || ':' || label, 1.0::DOUBLE / n FROM cap),
e1 AS (SELECT relation, source, target, round(sum(cost * share), 6) AS cost, round(sum(tokens * share), 4) AS tokens, count(*)::BIGINT AS calls, count(DISTINCT session_key)::BIGINT AS sessions FROM e0 GROUP BY ALL),
e2 AS (SELECT *, row_number() OVER (PARTITION BY relation, source ORDER BY cost DESC, target)::BIGINT AS place FROM e1 WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)),
kept AS (SELECT * FROM e2 WHERE place <= CASE relation WHEN 'project_model' THEN 6 WHEN 'project_core' THEN 5 WHEN 'project_mcp' THEN 5 ELSE place END)
"""
# G04_bounded_edges has one limit for all relations; these two follow the reference's limits and drop what isn't connected
_over_calls("G04_kept_edges", lambda x: turns.kept_edges(turns.all_graph_edges(x), turns.graph_nodes(x)), _KEPT + "SELECT * FROM kept")
_over_calls("G04_kept_nodes", lambda x: turns.kept_nodes(turns.all_graph_edges(x), turns.graph_nodes(x)), _KEPT + """
SELECT * EXCLUDE (id) FROM nodes WHERE id IN (SELECT source FROM kept UNION ALL SELECT target FROM kept)""")


practice_catalog.register(_over_calls, _signals_sql, NOW)
pricing_catalog.register(_over_calls, _over, NOW, _LATEST)
search_catalog.register(_over, CALLS_SQL)
activity_catalog.register(_over_calls, _signals_sql, _KEPT, NOW)
archive_catalog.register(_over_calls, _over, _signals_sql, NOW)
source_catalog.register(_over_calls, _over)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The by-model table with ranks, over one month."""
    return usage.ranked(usage.models(usage.of_period(_x(spark, sf_dir), "month", NOW)), "canonical").orderBy("rank")
