"""Queries of project activity, outputs, setup findings, pulse and lenses, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import activity, practice, turns, usage
from ..operators.activity import JUNK
from ..sources import driver_tables as tables
from ..sources.driver_tables import PRACTICE_SQL
from .practice_catalog import practice_view, turns_sql

SERVERS = ("srv1", "SRV-3", "srv4")
FILES = (("a/CLAUDE.md", 260), ("b/CLAUDE.md", 200), ("c/CLAUDE.md", 1200))


def _setup(x: DataFrame) -> DataFrame:
    spark = x.sparkSession
    servers, files = spark.createDataFrame([(s,) for s in SERVERS], "name string"), spark.createDataFrame(list(FILES), "path string, lines long")
    calls = tables.practice_calls(x)
    folder = F.when(F.col("seq") % 5 == 0, "web/node_modules/").when(F.col("seq") % 7 == 0, "dist/").otherwise("")
    return activity.setup_findings(calls.withColumn("referenced_files", F.transform("referenced_files", lambda f: F.concat(folder, f))), servers, files)


def register(over_calls: Callable, signals_sql: Callable, kept_sql: str, now) -> None:
    """Add the queries; over_calls(name, build, sql) files one over the enriched calls, kept_sql has the CTEs up to kept edges."""
    view = lambda x: practice_view(x, now)
    both = lambda made: lambda x: made(view(x), practice.practice_turns(view(x)))
    of_turns = turns_sql(signals_sql("message"), "'all'", now)
    identity = lambda c: f"CASE WHEN rtrim(replace(trim({c}), chr(92), '/'), '/') = '' THEN '(unknown)' ELSE rtrim(replace(trim({c}), chr(92), '/'), '/') END"
    of_projects = of_turns + f", sp AS (SELECT skey, {identity('arg_min(project, turn)')} AS identity FROM pt GROUP BY skey)"
    over_calls("C13_project_activity", both(activity.project_activity), of_projects + """,
mi AS (SELECT DISTINCT skey, epoch_us(timestamp) // 60000000 AS m FROM q0 WHERE exact AND timestamp IS NOT NULL),
mb AS (SELECT skey, m, sum(fresh) OVER (PARTITION BY skey ORDER BY m) AS block FROM (SELECT *, CASE WHEN m - lag(m) OVER (PARTITION BY skey ORDER BY m) <= 15 THEN 0 ELSE 1 END AS fresh FROM mi)),
mm AS (SELECT identity, sum(minutes)::BIGINT AS minutes FROM (SELECT skey, greatest(max(m) - min(m), 1) AS minutes FROM mb GROUP BY skey, block) JOIN sp USING (skey) GROUP BY identity),
pa AS (SELECT identity, count(*)::BIGINT AS turns, count(start_at) AS timed, count(*) FILTER (isodow(start_at) >= 6) AS weekend, [count(*) FILTER (hour(start_at) BETWEEN 5 AND 11), count(*) FILTER (hour(start_at) BETWEEN 12 AND 16), count(*) FILTER (hour(start_at) BETWEEN 17 AND 21), count(*) FILTER (hour(start_at) >= 22 OR hour(start_at) < 5)] AS parts FROM pt JOIN sp USING (skey) GROUP BY identity)
SELECT identity, turns, coalesce(minutes, 0) AS active_minutes, CASE WHEN timed = 0 THEN '' WHEN weekend / timed >= 0.6 THEN 'mostly_weekends' WHEN weekend / timed <= 0.2 THEN 'mostly_weekdays' ELSE 'mixed_days' END AS days,
  CASE WHEN timed = 0 OR list_max(parts) / timed < 0.4 THEN '' WHEN parts[4] = list_max(parts) THEN 'late_nights' WHEN parts[3] = list_max(parts) THEN 'evenings' WHEN parts[2] = list_max(parts) THEN 'afternoons' ELSE 'mornings' END AS time
FROM pa LEFT JOIN mm USING (identity)""")
    over_calls("C13_project_outputs", both(activity.project_outputs), of_projects + """,
oo AS (SELECT skey, 'language' AS kind, language AS name, loc AS amount FROM q0 WHERE language IS NOT NULL UNION ALL SELECT skey, 'file', unnest(edited_files), 1 FROM q0),
os AS (SELECT identity, kind, name, sum(amount)::BIGINT AS amount FROM oo JOIN sp USING (skey) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY identity, kind ORDER BY amount DESC, name)::BIGINT AS place FROM os""")
    over_calls("X35_session_outputs", lambda x: activity.session_outputs(practice.practice_turns(view(x))), of_turns + "SELECT skey, loc, distinct_tools FROM ps")
    junk = ", ".join(f"'{j}'" for j in JUNK)
    over_calls("R29_setup_findings", _setup, f""", {PRACTICE_SQL},
rf AS (SELECT session_key, CASE WHEN seq % 5 = 0 THEN 'web/node_modules/' WHEN seq % 7 = 0 THEN 'dist/' ELSE '' END || unnest(referenced_files) AS file FROM pc),
rj AS (SELECT *, list_filter(string_split(file, '/'), lambda p: p IN ({junk}))[1] AS junk FROM rf),
us AS (SELECT name FROM (VALUES {', '.join(f"('{s}')" for s in SERVERS)}) AS v(name) WHERE lower(replace(name, '-', '_')) NOT IN (SELECT lower(replace(split_part(t, '__', 2), '-', '_')) FROM (SELECT unnest(tools) AS t FROM x) WHERE starts_with(t, 'mcp__'))),
lf AS (SELECT * FROM (VALUES {', '.join(f"('{p}', {n})" for p, n in FILES)}) AS v(path, lines) WHERE lines > 200),
rr AS (SELECT coalesce(sum(n - 1), 0)::BIGINT AS n FROM (SELECT count(*) AS n FROM rj WHERE junk IS NULL AND session_key IS NOT NULL GROUP BY session_key, file))
SELECT 'unused-mcp-servers' AS finding, count(*)::BIGINT AS count, string_agg(name, ', ' ORDER BY name) AS detail, (count(*) * 2000 * greatest((SELECT count(DISTINCT session_key) FROM x), 1))::BIGINT AS savings FROM us HAVING count(*) > 0
UNION ALL SELECT 'claude-md-bloat', count(*), string_agg(path || ' (' || lines || ')', ', ' ORDER BY path), (sum(lines - 200) * 13)::BIGINT FROM lf HAVING count(*) > 0
UNION ALL SELECT 'redundant-rereads', n, '', n * 600 FROM rr WHERE n >= 5
UNION ALL SELECT 'junk-directory-reads', count(*), string_agg(DISTINCT junk, ', ' ORDER BY junk), count(*) * 600 FROM rj WHERE junk IS NOT NULL HAVING count(*) >= 3""")
    over_calls("V03_pulse", lambda x: activity.pulse(usage.daily(x)), """
, d AS (SELECT timestamp::DATE AS day, round(sum(cost), 6) AS cost, count(*)::BIGINT AS calls FROM x WHERE timestamp IS NOT NULL GROUP BY 1)
SELECT sum(calls)::BIGINT AS calls, max(calls) AS most, arg_max(day, (cost, -epoch(day))) AS peak_at, max(cost) AS peak_value, max(day) AS last_at, arg_max(cost, day) AS last_value FROM d HAVING count(*) > 0""")
    edges = lambda x: turns.kept_edges(turns.all_graph_edges(x), turns.graph_nodes(x))
    for name, view_, metric, most in (("V04_project_lens", "projects", "cost", "'project_tool', 'project_model', 'project_core', 'project_mcp'"), ("V04_tool_lens", "tools", "tokens", "'project_tool', 'tool_model', 'tool_core', 'tool_mcp'")):
        over_calls(name, lambda x, view_=view_, metric=metric: activity.lens(edges(x), view_, metric), kept_sql + f"""
SELECT relation, source, target, {metric}, round(greatest(2, coalesce({metric} * 100.0 / nullif(max({metric}) OVER (), 0), 0))::DOUBLE, 6) AS strength, row_number() OVER (PARTITION BY relation, source ORDER BY {metric} DESC, target)::BIGINT AS nth FROM kept WHERE relation IN ({most})""")
