"""Queries that read rendered tables back through the sources' readers and the growing archive, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scripts
from ..operators import archive, growing
from ..operators.shared import shared_folder
from ..sources import copilot_stores, cursor_state, limit_states, rendered
from ..sources import driver_tables as tables
from ..streaming import tail

_STORES_SQL = """
WITH b AS (SELECT conv_id, turn // 2 AS t, max(text) FILTER (role = 'user') AS u, max(text) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1, 2),
n AS (SELECT *, 's' || conv_id AS s, trim(coalesce(u, '')) <> '' OR trim(coalesce(a, '')) <> '' AS told, coalesce(u, '') AS ut, coalesce(a, '') AS reply, CASE WHEN conv_id % 2 = 0 THEN '/w/p' || (conv_id % 5) WHEN conv_id % 3 = 0 THEN 'o/r' ELSE 'copilot-cli' END AS project FROM b),
e AS (SELECT *, conv_id * 1000 + t AS id, CASE WHEN conv_id % 7 <> 0 THEN t END AS ti, length(ut) * 2 AS all_input, least(conv_id % 90, length(ut) * 2) AS read FROM n WHERE (conv_id + t) % 3 = 0),
ev AS (SELECT 'copilot:' || s || CASE WHEN ti IS NULL THEN '' ELSE ':turn-' || ti END || ':usage-' || id AS dedup_key, CASE WHEN conv_id % 2 = 0 THEN 'm' ELSE 'copilot-auto' END AS model, all_input - read AS input_tokens, greatest(t - 1, 0) AS output_tokens, read AS cache_read_tokens, s AS session_id, project, CASE WHEN ti IS NOT NULL AND told THEN left(ut, 500) ELSE '' END AS user_message FROM e),
es AS (SELECT 'copilot:' || s || ':turn-' || t AS dedup_key, 'copilot-auto' AS model, ceil(strlen(ut) / 4.0)::BIGINT AS input_tokens, ceil(strlen(reply) / 4.0)::BIGINT AS output_tokens, 0 AS cache_read_tokens, s AS session_id, project, left(ut, 500) AS user_message FROM n WHERE told),
bare AS (SELECT * FROM es WHERE dedup_key NOT IN (SELECT 'copilot:' || s || ':turn-' || ti FROM e WHERE ti IS NOT NULL)),
tot AS (SELECT DISTINCT 'copilot:cli:s' || conv_id AS dedup_key, 'm' AS model, conv_id % 4 * 100 - least(conv_id * 7, conv_id % 4 * 100) AS input_tokens, conv_id % 2 * 9 AS output_tokens, least(conv_id * 7, conv_id % 4 * 100) AS cache_read_tokens, 's' || conv_id AS session_id, 'copilot-cli' AS project, conv_id FROM conversations WHERE conv_id % 4 > 0)
"""
_SHOWN = "dedup_key, model, input_tokens::BIGINT AS input_tokens, output_tokens::BIGINT AS output_tokens, cache_read_tokens::BIGINT AS cache_read_tokens, session_id, project"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = copilot_stores.span_calls(*rendered.spans(spark.read.parquet(f"{sf_dir}/events.parquet")))
    return calls.select("dedup_key", "model", "input_tokens", "output_tokens", "session_id", "project", F.array_join("tools", ",").alias("tools"), F.array_join("commands", ";").alias("commands"), F.array_join("superseded", ",").alias("superseded"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


def _store_columns(calls: DataFrame) -> DataFrame:
    return calls.select("dedup_key", "model", "input_tokens", "output_tokens", "cache_read_tokens", "session_id", "project")


def _superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive with every turn's estimate and every session's total, after the usage events came in."""
    turns, sessions, events, totals = rendered.stores(_conversations(spark, sf_dir))
    before = copilot_stores.store_calls(turns, sessions, events.limit(0)).unionByName(copilot_stores.total_calls(totals, events.limit(0)))
    gone = copilot_stores.superseded_keys(copilot_stores.store_calls(turns, sessions, events))
    return archive.zero_superseded(before, gone).select("dedup_key", "input_tokens", "output_tokens", "cache_read_tokens")


def _grown(x: DataFrame) -> DataFrame:
    """Two thirds of the calls, and then all of them with other costs and tokens."""
    spark, folder = x.sparkSession, f"{shared_folder(x.sparkSession)}/archive-{uuid.uuid4().hex}"
    calls = x.select("tool", "dedup_key", "seq", "timestamp", "timestamp_quality", "cost", "input_tokens", "output_tokens", "tools")
    growing.upsert(spark, folder, calls.where("seq % 3 <> 0"), 0, buckets=8)
    growing.upsert(spark, folder, calls.withColumns({"cost": F.col("cost") + 1, "input_tokens": F.col("input_tokens") + 5}), 1)
    return growing.read(spark, folder).select("tool", "dedup_key", F.round("cost", 6).alias("cost"), "input_tokens", F.size("tools").cast("long").alias("n_tools"))


def _added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as diffs: lines that begin with a to m are added."""
    diff = F.regexp_replace("text", "(?dm)^([a-m])", "+$1")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", scripts.added_lines(diff).alias("added"), scripts.lines_of(F.coalesce("text", F.lit(""))).alias("lines"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each event: two calls, and others in a comment and a string."""
    i = F.col("event_id")
    script = F.concat(F.lit("const r = await Promise.all([tools.exec_command({cmd: 'git add "), i, F.lit("'}), // tools.no()\n tools.t"), i % 3, F.lit('({q: "tools.no() (", n: (1)})]); /* tools.no( */ tools.open('))
    calls = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.posexplode(scripts.nested_calls_of(F.when(i % 5 > 0, script))).alias("place", "c"))
    return calls.select("event_id", F.col("place").cast("long").alias("place"), "c.name", F.coalesce("c.command", F.lit("")).alias("command"))


def _tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tailed-{uuid.uuid4().hex}"
    rendered.session_files(_conversations(spark, sf_dir), f"{folder}/files")
    query = tail.follow_claude(tail.tail_lines(spark, f"{folder}/files", "part-*"), f"{folder}/archive", f"{folder}/checkpoint", buckets=8)
    query.awaitTermination()
    calls = growing.read(spark, f"{folder}/archive/calls")
    return calls.select("dedup_key", "session_id", "input_tokens", "output_tokens", "response_chars", "prompt_chars", "user_message").fillna({"prompt_chars": 0, "user_message": ""})


def _limits(form: str, read: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read(rendered.limit_documents(spark.read.parquet(f"{sf_dir}/orders.parquet"))[form])
        number = lambda c: F.coalesce(F.round(c, 6), F.lit(-1.0))
        epoch = lambda c: F.coalesce(F.unix_seconds(c), F.lit(-1).cast("long"))
        return rows.select(
            "path", "limit_id", F.coalesce("plan_type", F.lit("")).alias("plan_type"), epoch(F.col("observed_at")).alias("observed"), number(F.col("primary.used_percent")).alias("used"), F.coalesce("primary.minutes", F.lit(-1).cast("long")).alias("minutes"), epoch(F.col("primary.resets_at")).alias("resets"),
            number(F.col("secondary.used_percent")).alias("used_2"), F.coalesce("credits.has_credits", F.lit(False)).alias("has_credits"), number(F.col("credits.balance")).alias("balance"), F.coalesce("reached", F.lit("")).alias("reached"),
        )

    return query


def register(over_calls: Callable, over: Callable) -> None:
    """Add the queries; over_calls(name, build, sql) files one over the enriched calls, over(name, query, sql) one over the tables."""
    over("S30_span_calls", _spans, """
WITH s AS (SELECT event_id AS i, event_id // 7 AS trace, event_id % 4 AS op, CASE WHEN event_id % 3 <> 0 THEN 'c' || (event_id // 70) END AS conv, regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS k FROM events),
p AS (SELECT conv, arg_min('r' || (i % 10), i) AS project FROM s WHERE conv IS NOT NULL AND i % 11 = 0 GROUP BY conv),
u AS (SELECT trace, string_agg(CASE WHEN op = 2 THEN 'Agent' ELSE ['Bash', 'Read', 'odd'][(i % 3 + 1)::INT] END, ',' ORDER BY i) AS tools, coalesce(string_agg('git add .;cargo test', ';' ORDER BY i) FILTER (op = 1 AND i % 3 = 0), '') AS commands
  FROM s WHERE op = 1 OR (op = 2 AND i % 8 = 2) GROUP BY trace),
c AS (SELECT *, CASE WHEN k SIMILAR TO '[0-9]+' THEN k::BIGINT ELSE 0 END AS input_tokens, i % 50 AS output_tokens, coalesce(conv, 't' || trace) AS session_id FROM s WHERE op IN (0, 3))
SELECT 'copilot-otel:s' || i AS dedup_key, coalesce(CASE WHEN i % 3 = 0 THEN 'm-1' WHEN i % 3 = 2 AND i % 2 = 0 THEN 'm-0' END, CASE WHEN i % 5 = 0 THEN 'm-2' END, 'copilot-auto') AS model, input_tokens, output_tokens, session_id, coalesce(project, 'copilot-chat') AS project,
  coalesce(tools, '') AS tools, coalesce(commands, '') AS commands, CASE WHEN i % 5 = 0 THEN 'copilot:' || session_id || ':' || i ELSE '' END AS superseded, make_timestamp_ms(i * 1000 + 1700000000000) AS timestamp
FROM c LEFT JOIN p USING (conv) LEFT JOIN u USING (trace) WHERE input_tokens > 0 OR output_tokens > 0""")
    over("S31_journal_calls", lambda spark, d: copilot_stores.journal_calls(rendered.journals(_conversations(spark, d))).select("dedup_key", "model", "session_id", "input_tokens", "output_tokens", "user_message"), """
WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations)
SELECT 'copilot-chatsession:s' || conv_id || ':r' || i AS dedup_key, 'gpt-5' AS model, 's' || conv_id AS session_id, length(text)::BIGINT AS input_tokens, greatest(turn * 3, 0)::BIGINT AS output_tokens, left(text, 500) AS user_message FROM c WHERE length(text) > 0 OR turn * 3 > 0""")
    over("S32_store_calls", lambda spark, d: (lambda s: _store_columns(copilot_stores.store_calls(*s[:3])))(rendered.stores(_conversations(spark, d))), _STORES_SQL + f"SELECT {_SHOWN} FROM (SELECT * FROM ev UNION ALL SELECT * FROM bare)")
    over("S33_total_calls", lambda spark, d: (lambda s: _store_columns(copilot_stores.total_calls(s[3], s[2])))(rendered.stores(_conversations(spark, d))), _STORES_SQL + f"SELECT {_SHOWN} FROM tot WHERE conv_id NOT IN (SELECT conv_id FROM e)")
    over("O11_superseded", _superseded, _STORES_SQL + """
, every AS (SELECT dedup_key, input_tokens, output_tokens, cache_read_tokens FROM es UNION ALL SELECT dedup_key, input_tokens, output_tokens, cache_read_tokens FROM tot),
gone AS (SELECT 'copilot:cli:' || s AS dedup_key FROM e UNION SELECT 'copilot:' || s || ':turn-' || ti FROM e WHERE ti IS NOT NULL)
SELECT dedup_key, CASE WHEN g.dedup_key IS NULL THEN input_tokens ELSE 0 END::BIGINT AS input_tokens, CASE WHEN g.dedup_key IS NULL THEN output_tokens ELSE 0 END::BIGINT AS output_tokens, CASE WHEN g.dedup_key IS NULL THEN cache_read_tokens ELSE 0 END::BIGINT AS cache_read_tokens
FROM every LEFT JOIN gone AS g USING (dedup_key)""")
    shown = ("dedup_key", "session_id", "model", "input_tokens", "output_tokens", "prompt_chars", "response_chars", "user_message", "token_quality", "interaction_mode")
    filled = {"prompt_chars": 0, "response_chars": 0, "user_message": ""}
    over("S35_cursor_calls", lambda spark, d: cursor_state.cursor_calls(rendered.cursor_stores(_conversations(spark, d))).select(*shown, F.array_join("tools", ",").alias("tools")).fillna(filled), """
WITH c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS n FROM conversations),
o AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY n) - 1 AS place, CASE WHEN conv_id % 4 = 0 AND role <> 'user' THEN n % 3 * 5 ELSE 0 END AS made FROM c),
t AS (SELECT conv_id, place, min(n) FILTER (role = 'user') AS n, regexp_replace(max(text) FILTER (role = 'user'), '^\\s+|\\s+$', '', 'g') AS said, coalesce(string_agg(text, chr(10) ORDER BY n) FILTER (role <> 'user' AND text <> ''), '') AS told, sum(made)::BIGINT AS made FROM o WHERE place >= 0 GROUP BY conv_id, place),
a AS (SELECT *, CASE WHEN conv_id % 5 = 0 AND place = 0 THEN 'stored answer' ELSE told END AS answer, conv_id % 3 = 0 AND conv_id > 0 AND max(made) OVER (PARTITION BY conv_id) = 0 AS metered FROM t),
k AS (SELECT *, length(answer) AS chars, CASE WHEN metered THEN 0 ELSE length(said) END AS counted FROM a)
SELECT 'cursor:composer:c' || conv_id || ':' || CASE WHEN n % 4 < 2 THEN 'r' || conv_id || '-' || n ELSE 'b' || n END AS dedup_key, 'c' || conv_id AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'gpt-5' ELSE 'cursor-auto' END AS model, ((counted + 3) // 4)::BIGINT AS input_tokens,
  CASE WHEN made = 0 THEN (chars + 3) // 4 ELSE made END::BIGINT AS output_tokens, length(said)::BIGINT AS prompt_chars, chars::BIGINT AS response_chars, left(said, 500) AS user_message,
  CASE WHEN made > 0 AND counted > 0 THEN 'mixed' WHEN made > 0 THEN 'exact' WHEN counted > 0 OR chars > 0 THEN 'estimated' ELSE 'unknown' END AS token_quality, 'chat' AS interaction_mode, CASE WHEN conv_id % 5 = 0 AND place = 0 THEN 'Read' ELSE '' END AS tools FROM k
UNION ALL SELECT DISTINCT 'cursor:composer-input:c' || conv_id, 'c' || conv_id, CASE WHEN conv_id % 2 = 0 THEN 'gpt-5' ELSE 'cursor-auto' END, (conv_id * 10)::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, '', 'estimated', 'chat', '' FROM k WHERE metered""")
    over("S20_added_lines", _added, r"""
SELECT doc_id, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '(?m)^([a-m])', '+\1', 'g'), chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')))::BIGINT AS added,
  (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS lines FROM documents""")
    over("S21_nested_calls", _nested, """
SELECT event_id, 0::BIGINT AS place, 'exec_command' AS name, 'git add ' || event_id AS command FROM events WHERE event_id % 5 > 0
UNION ALL SELECT event_id, 1, 't' || (event_id % 3), '' FROM events WHERE event_id % 5 > 0""")
    shape = lambda limit, plan, observed, used, minutes, resets, second="-1.0", has="false", balance="-1.0", reached="''": f"SELECT '/limits/' || i AS path, {limit} AS limit_id, {plan} AS plan_type, {observed} AS observed, round(({used})::DOUBLE, 6) AS used, ({minutes})::BIGINT AS minutes, ({resets})::BIGINT AS resets, ({second})::DOUBLE AS used_2, {has} AS has_credits, round(({balance})::DOUBLE, 6) AS balance, {reached} AS reached FROM o"
    head = "WITH o AS (SELECT o_orderkey AS i, epoch(o_orderdate)::BIGINT AS seen, epoch(TIMESTAMP '2024-01-01' + to_days((o_orderkey % 9)::INT))::BIGINT AS told FROM orders)\n"
    over("S43_status_limits", _limits("status", limit_states.claude_status_limits), head + shape("'claude-code'", "''", "seen", "i % 101", "300", "i * 1000", "CASE WHEN i % 3 <> 0 THEN i % 7 ELSE -1 END"))
    over("S44_claude_limits", _limits("claude", limit_states.claude_subscription_limits), head + shape("'claude-code'", "''", "told", "least(i % 150, 100)", "300", "CASE WHEN i % 4 <> 0 THEN told ELSE -1 END") + " WHERE i % 150 > 0 OR i % 4 <> 0 UNION ALL " + shape("'seven_day_opus'", "''", "told", "i % 5", "10080", "-1") + " WHERE i % 5 > 0 UNION ALL "
         + shape("'extra_usage'", "''", "told", "CASE WHEN i % 3 > 0 THEN least((i % 900)::DOUBLE / (i % 3 * 1000) * 100, 100) ELSE 0 END", "43200", "-1", has="i % 3 > 0", balance="CASE WHEN i % 3 > 0 THEN greatest(i % 3 * 1000 - i % 900, 0) / 100.0::DOUBLE ELSE -1 END") + " WHERE i % 2 = 0")
    over("S45_codex_limits", _limits("codex", lambda files: limit_states.codex_subscription_limits(files, datetime(2024, 1, 31))), head + shape("'codex'", "'plus'", "seen", "least(i % 120, 100)", "CASE WHEN i % 3 > 0 THEN i % 3 * 60 ELSE 300 END", "CASE WHEN i % 2 = 0 THEN i * 1000 ELSE -1 END", reached="CASE WHEN i % 11 = 0 THEN 'limit_reached' ELSE '' END")
         + " WHERE i % 120 > 0 OR i % 2 = 0 UNION ALL " + shape("'extra_usage'", "'plus'", "seen", "-1", "-1", "-1", has="i % 6 = 0", balance="CASE WHEN i % 4 = 0 THEN i % 10 ELSE -1 END", reached="CASE WHEN i % 9 = 0 THEN 'out_of_credits' ELSE '' END") + " WHERE i % 6 = 0 OR i % 4 = 0 OR i % 9 = 0")
    over("S46_quota_limits", _limits("copilot", limit_states.copilot_quota_limits), head + shape("'premium_interactions' || CASE WHEN i % 5 = 0 THEN '@me' ELSE '' END", "CASE i % 3 WHEN 0 THEN 'copilot_pro' WHEN 1 THEN 'copilot_business' ELSE 'copilot_pro_plus' END", "seen", "100 - least((i % 400)::DOUBLE / 300 * 100, 100)", "43200", "epoch(TIMESTAMP '2024-02-01')", has="true", balance="i % 400", reached="CASE WHEN i % 400 = 0 THEN 'primary' ELSE '' END"))
    over("S13_tailed_calls", _tailed, f"""
WITH c AS (SELECT *, coalesce(text, '') AS t, coalesce(role, '') = 'assistant' AS reply FROM conversations),
p AS (SELECT *, last_value(CASE WHEN NOT reply AND trim(t) <> '' AND NOT starts_with(trim(t), '<command-') AND NOT starts_with(trim(t), '<local-command-') AND NOT starts_with(trim(t), '[Request interrupted by user') THEN t END IGNORE NULLS)
  OVER (PARTITION BY conv_id % {rendered.FILES} ORDER BY conv_id, turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prompt FROM c)
SELECT 'm' || conv_id || '-' || turn AS dedup_key, 's' || conv_id AS session_id, length(t)::BIGINT AS input_tokens, turn::BIGINT AS output_tokens, length(t)::BIGINT AS response_chars, length(coalesce(prompt, ''))::BIGINT AS prompt_chars, left(coalesce(prompt, ''), 500) AS user_message FROM p WHERE reply""")
    over_calls("O15_grown_archive", _grown, """
SELECT tool, dedup_key, round(cost + CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END, 6) AS cost, input_tokens + CASE WHEN seq % 3 = 0 OR tool = 'cursor' THEN 5 ELSE 0 END AS input_tokens, len(tools)::BIGINT AS n_tools FROM x""")
    opus = lambda x: tables.detailed_calls(x).withColumn("model", F.when(F.col("seq") % 5 == 0, "vendor/claude-opus-5-20260401").otherwise(F.col("model")))
    over_calls("O16_repaired_costs", lambda x: opus(x).select("seq", F.round(growing.repaired_cost(), 6).alias("cost")), f""",
{tables.DETAILED_SQL},
r AS (SELECT seq, cost, seq % 5 = 0 AS named, CASE speed WHEN 'fast' THEN 2.0::DOUBLE ELSE 1.0 END AS f, web_searches * 0.01::DOUBLE AS w, input_tokens * 0.000003::DOUBLE + output_tokens * 0.000015::DOUBLE + cache_write_tokens * 0.00000375::DOUBLE + cache_read_tokens * 0.0000003::DOUBLE AS t FROM dc)
SELECT seq, round(CASE WHEN named AND cost < f * (t * (5.0::DOUBLE / 3.0::DOUBLE) + w) THEN f * ((cost - w) * (5.0::DOUBLE / 3.0::DOUBLE) + w) ELSE cost END, 6) AS cost FROM r""")
