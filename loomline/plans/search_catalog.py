"""Queries of the search over postings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import postings
from ..sources import driver_tables as tables

QUERY, PROJECT = "LE e", "/work/p3"


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return tables.dated_transcripts(tables.transcripts(spark, sf_dir))


def _found(spark: SparkSession, sf_dir: str, **filters: str) -> DataFrame:
    archive = _archive(spark, sf_dir)
    return postings.matches(postings.build_index(archive), archive, QUERY, **filters)


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.with_costs(postings.best_sessions(_found(spark, sf_dir)), tables.user_calls(tables.calls(spark, sf_dir)))


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    return postings.quotes(found, postings.best_sessions(found), _archive(spark, sf_dir))


def _by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, project=PROJECT).select("dedup_key", "tool", "session_id", "project", "timestamp", "origin", F.round("rank", 6).alias("rank"))


_WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"
_TOKENS = f"list_transform(regexp_extract_all(%s, '{_WORD}'), lambda t: strip_accents(lower(t)))"
_AT = "list_filter(range(len(%s)), lambda i: %s[i + 1] = 'le' OR starts_with(%s[i + 1], 'e'))"
_RANK = " - ".join(["0"] + [f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * (u{i} * 2.0 + a{i}) * 2.2 / (u{i} * 2.0 + a{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in (0, 1)])
#: CTEs up to k, the ranked turns.
_FOUND = rf"""
p AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
d AS (SELECT 'c' || conv_id || '-' || turn AS dedup_key, ['claude-code', 'cursor', 'codex', 'copilot', 'gemini'][(conv_id % 5 + 1)::INT] AS tool, conv_id::VARCHAR AS session_id, CASE WHEN next_role = 'assistant' THEN 'full' ELSE 'prompt' END AS origin,
  '/work/p' || (conv_id % 7) || CASE WHEN turn % 4 = 0 THEN '/' ELSE '' END AS project, TIMESTAMP '2024-01-01' + to_hours((conv_id % 500)::BIGINT) + to_minutes(turn::BIGINT) AS timestamp,
  coalesce(text, '') AS user_text, CASE WHEN next_role = 'assistant' THEN coalesce(next_text, '') ELSE '' END AS assistant_text FROM p WHERE role = 'user'),
t AS (SELECT *, {_TOKENS % 'user_text'} AS u, {_TOKENS % 'assistant_text'} AS a FROM d),
h AS (SELECT *, len(u) + len(a) AS length, len(list_filter(u, lambda t: t = 'le')) AS u0, len(list_filter(a, lambda t: t = 'le')) AS a0, len(list_filter(u, lambda t: starts_with(t, 'e'))) AS u1, len(list_filter(a, lambda t: starts_with(t, 'e'))) AS a1 FROM t),
s AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (u0 + a0 > 0) AS df0, count(*) FILTER (u1 + a1 > 0) AS df1 FROM h),
k AS (SELECT h.*, {_RANK} AS rank FROM h, s WHERE u0 + a0 > 0 AND u1 + a1 > 0),
g AS (SELECT tool, session_id, min(project) AS project, max(timestamp) AS last, count(*)::BIGINT AS hits, round(min(rank), 6) AS best, count(*) FILTER (origin = 'full') = 0 AS prompt_only FROM k GROUP BY tool, session_id),
b AS (SELECT *, row_number() OVER (ORDER BY best, last DESC NULLS LAST, tool, session_id)::BIGINT AS place, (SELECT count(*) FROM g)::BIGINT AS total FROM g QUALIFY place <= 20)"""
_QUOTE = f"list_transform(list_zip(regexp_extract_all(text, '{_WORD}[^\\p{{L}}\\p{{N}}]*'), range(n)), lambda e: CASE WHEN list_contains(spots, e[2]) THEN regexp_replace(e[1], '^({_WORD})', chr(57344) || '\\1' || chr(57345)) ELSE e[1] END)"


def register(over, calls_sql: str) -> None:
    """Add the queries; over(name, query, sql)."""
    over("Q04_ranked_sessions", _sessions, f"""
WITH {calls_sql}, {_FOUND},
c AS (SELECT tool, split_part(session_id, '-', 1) AS session_id, round(sum(cost), 6) AS cost FROM calls GROUP BY ALL)
SELECT b.*, coalesce(cost, 0)::DOUBLE AS cost FROM b LEFT JOIN c USING (tool, session_id)""")
    over("J13_project_turns", _by_project, f"""
WITH {_FOUND} SELECT dedup_key, tool, session_id, project, timestamp, origin, round(rank, 6) AS rank FROM k WHERE rtrim(project, '/') = '{PROJECT}'""")
    over("Q05_snippets", _quotes, f"""
WITH {_FOUND},
r AS (SELECT k.*, {_AT % ('u', 'u', 'u')} AS at_u, {_AT % ('a', 'a', 'a')} AS at_a, row_number() OVER (PARTITION BY k.tool, k.session_id ORDER BY round(rank, 6), dedup_key)::BIGINT AS nth FROM k JOIN b USING (tool, session_id) QUALIFY nth <= 3),
f AS (SELECT tool, session_id, nth, dedup_key, CASE WHEN len(at_u) > 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN len(at_u) > 0 THEN at_u ELSE at_a END AS spots, CASE WHEN len(at_u) > 0 THEN user_text ELSE assistant_text END AS text, CASE WHEN len(at_u) > 0 THEN len(u) ELSE len(a) END AS n FROM r),
z AS (SELECT *, greatest(0, least(spots[1] - 5, n - 12)) AS start, {_QUOTE} AS marked FROM f)
SELECT tool, session_id, nth, dedup_key, role, CASE WHEN start > 0 THEN '…' ELSE '' END || list_aggregate(marked[start + 1:start + 12], 'string_agg', '') || CASE WHEN start + 12 < n THEN '…' ELSE '' END AS snippet FROM z""")
