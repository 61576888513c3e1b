"""The fact tables of the domain as views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import canonical_key

#: Tool by event type, model by event_id mod 6, tools used by event_id mod 4.
TOOLS = {"click": "claude-code", "view": "cursor", "purchase": "codex", "signup": "copilot", "error": "gemini"}
MODELS = ("claude-opus-4-6-20260205", "vendor/claude-haiku-4-5", "gpt-5-mini", "claude-4.5-opus", "auto", "my-proxy-9000")
TOOL_CALLS = ((), ("Read",), ("Edit", "Bash", "mcp__srv1__a"), ("mcp__srv2__b", "mcp__srv2__c", "Grep"))
LANGUAGES = ("rust", "python", "sql")


# The prompts of practice_calls.
PROMPTS = (
    "fix",
    "FIX THIS BUG NOW PLEASE",
    "why doesn't this work??? it worked yesterday",
    "add a new endpoint without changing the public api of the server",
    "what is this",
    "refactor the parser and keep every test green while you do so",
    "make me a dashboard app",
    "- must list the orders\n- must show totals",
    "",
    "rename the css theme and the layout of the page to something simpler",
    "please " * 120 + "thanks, basically just describe it",
    "deploy the docker image to the staging cluster and upgrade the version",
)


def _pick(index, values):
    return F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)).cast("array<string>") for v in values]), (index + 1).cast("int"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each model call, from events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, i, u = F.get_json_object("props", "$.k").cast("long"), F.col("event_id"), F.col("user_id")
    tool = F.create_map(*[F.lit(x) for pair in TOOLS.items() for x in pair])[F.col("event_type")]
    return e.select(
        i.alias("seq"),
        F.concat(F.lit("e"), i).alias("dedup_key"),
        F.col("ts").alias("timestamp"),
        tool.alias("tool"),
        _pick(i % 6, MODELS).alias("model"),
        F.when(i % 97 == 0, "").otherwise(F.concat(u, F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))).alias("session_id"),
        F.concat(F.lit("/work/t"), u % 3, F.lit("/app"), u % 5, F.when(i % 2 == 1, "/").otherwise("")).alias("project"),
        (k * 100).alias("input_tokens"),
        (k * 10 + 1).alias("output_tokens"),
        (k * 50 * (i % 2)).alias("cache_read_tokens"),
        (k * 5).alias("cache_write_tokens"),
        (k % 7).alias("reasoning_tokens"),
        (F.col("value") / 100.0).alias("cost"),
        _pick(i % 4, TOOL_CALLS).alias("tools"),
        F.when(i % 4 == 2, F.array(F.lit("git push"), F.lit("cargo test"))).otherwise(F.array().cast("array<string>")).alias("commands"),
        F.when(i % 11 != 0, k + 10).alias("prompt_chars"),
        F.when(i % 13 != 0, k * 4000).alias("elapsed_ms"),
        F.when(i % 4 == 2, F.array(F.struct(_pick(u % 3, LANGUAGES).alias("language"), k.alias("loc")))).otherwise(F.array().cast("array<struct<language:string,loc:bigint>>")).alias("code_blocks"),
        (i % 9 == 0).alias("is_canceled"),
        F.when(i % 17 == 0, "session").otherwise("exact").alias("timestamp_quality"),
    )


def practice_calls(x: DataFrame) -> DataFrame:
    """Enriched calls with prompts, files and efforts, drawn from their numbers."""
    i, k = F.col("seq"), F.floor(F.col("input_tokens") / 100)
    message = _pick((k + F.floor(i / 7)) % len(PROMPTS), PROMPTS)
    named = lambda n: F.transform(F.sequence(F.lit(1), n), lambda f: F.concat(F.lit("doc"), f))
    files = F.when(i % 41 == 0, 32).otherwise(i % 3).cast("int")
    return x.withColumns({
        "user_message": message,
        "prompt_chars": F.when(i % 11 != 0, F.length(message).cast("long")),
        "edited_files": F.when(i % 4 == 2, F.array(F.concat(F.lit("src/f"), k % 5, F.lit(".rs")))).otherwise(F.array().cast("array<string>")),
        "referenced_files": F.when(files > 0, named(F.greatest(files, F.lit(1)))).otherwise(F.array().cast("array<string>")),
        "model": F.concat("model", F.when(i % 10 == 3, "-high").when(i % 10 == 4, "-low").when(i % 10 == 5, "-xhigh").otherwise("")),
    })


#: The same as a DuckDB query over x.
PRACTICE_SQL = f"""
pc0 AS (SELECT *, (input_tokens // 100 + seq // 7) % {len(PROMPTS)} AS pick FROM x),
pc1 AS (SELECT *, [{', '.join("'" + p.replace("'", "''") + "'" for p in PROMPTS)}][(pick + 1)::INT] AS user_message FROM pc0),
pc AS (SELECT * REPLACE (CASE WHEN seq % 11 <> 0 THEN length(user_message)::BIGINT END AS prompt_chars, model || CASE seq % 10 WHEN 3 THEN '-high' WHEN 4 THEN '-low' WHEN 5 THEN '-xhigh' ELSE '' END AS model),
         CASE WHEN seq % 4 = 2 THEN ['src/f' || ((input_tokens // 100) % 5) || '.rs'] ELSE []::VARCHAR[] END AS edited_files,
         list_transform(generate_series(1, CASE WHEN seq % 41 = 0 THEN 32 ELSE seq % 3 END), lambda f: 'doc' || f) AS referenced_files FROM pc1)"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows, from conversations."""
    from pyspark.sql import Window

    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn")
    paired = c.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w)).where("role = 'user'")
    full = F.col("next_role") == "assistant"
    return paired.select(
        "conv_id",
        "turn",
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("dedup_key"),
        _pick(F.col("conv_id") % 5, tuple(TOOLS.values())).alias("tool"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.coalesce("text", F.lit("")).alias("user_text"),
        F.when(full, F.coalesce("next_text", F.lit(""))).otherwise("").alias("assistant_text"),
        F.when(full, "full").otherwise("prompt").alias("origin"),
    )


def dated_transcripts(turns: DataFrame) -> DataFrame:
    """transcripts with a project and a time."""
    slash = F.when(F.col("turn") % 4 == 0, "/").otherwise("")
    hours = F.make_dt_interval(hours=(F.col("conv_id") % 500).cast("int"), mins=F.col("turn").cast("int"))
    return turns.withColumns({"project": F.concat(F.lit("/work/p"), F.col("conv_id") % 7, slash), "timestamp": F.lit("2024-01-01").cast("timestamp_ntz") + hours})


def user_calls(x: DataFrame) -> DataFrame:
    """calls with a session for each user."""
    return x.withColumn("session_id", F.substring_index("session_id", "-", 1))


def limit_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate-limit observations, from orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    minutes = F.when(F.col("o_orderstatus") == "F", 300).otherwise(10080).cast("long")
    return o.select(
        F.col("o_orderkey").alias("seq"),
        _pick(F.col("o_custkey") % 5, tuple(TOOLS.values())).alias("tool"),
        F.concat(F.lit("l"), F.col("o_custkey") % 3).alias("limit_id"),
        F.col("o_orderdate").alias("observed_at"),
        (F.col("o_totalprice") % 100).alias("used_percent"),
        minutes.alias("window_minutes"),
        F.col("o_orderstatus").alias("plan_type"),
        (F.col("o_orderdate") + F.make_dt_interval(mins=minutes.cast("int"))).alias("resets_at"),
    )


def limit_states(snapshots: DataFrame) -> DataFrame:
    """limit_snapshots with its window as primary, without a reset in a third of the rows, and a monthly secondary one in half of them."""
    window = lambda used, minutes, resets: F.struct(used.alias("used_percent"), minutes.alias("minutes"), resets.cast("timestamp_ntz").alias("resets_at"))
    primary = window(F.col("used_percent"), F.col("window_minutes"), F.when(F.col("seq") % 3 > 0, F.col("resets_at")))
    secondary = F.when(F.col("seq") % 2 == 0, window(100 - F.col("used_percent") / 2, F.lit(43200).cast("long"), F.lit(None)))
    return snapshots.withColumns({"primary": primary, "secondary": secondary})


#: The same calls as a DuckDB query.
CALLS_SQL = """
calls AS (
  SELECT event_id AS seq, 'e' || event_id AS dedup_key, ts AS timestamp,
         CASE event_type WHEN 'click' THEN 'claude-code' WHEN 'view' THEN 'cursor' WHEN 'purchase' THEN 'codex' WHEN 'signup' THEN 'copilot' WHEN 'error' THEN 'gemini' END AS tool,
         ['claude-opus-4-6-20260205', 'vendor/claude-haiku-4-5', 'gpt-5-mini', 'claude-4.5-opus', 'auto', 'my-proxy-9000'][(event_id % 6 + 1)::INT] AS model,
         CASE WHEN event_id % 97 = 0 THEN '' ELSE user_id || '-' || strftime(ts, '%Y-%m-%d') END AS session_id,
         '/work/t' || (user_id % 3) || '/app' || (user_id % 5) || CASE WHEN event_id % 2 = 1 THEN '/' ELSE '' END AS project,
         k * 100 AS input_tokens, k * 10 + 1 AS output_tokens, k * 50 * (event_id % 2) AS cache_read_tokens, k * 5 AS cache_write_tokens,
         k % 7 AS reasoning_tokens, value / 100.0 AS cost,
         CASE event_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['Read'] WHEN 2 THEN ['Edit', 'Bash', 'mcp__srv1__a'] ELSE ['mcp__srv2__b', 'mcp__srv2__c', 'Grep'] END AS tools,
         CASE WHEN event_id % 4 = 2 THEN ['git push', 'cargo test'] ELSE []::VARCHAR[] END AS commands,
         CASE WHEN event_id % 11 <> 0 THEN k + 10 END AS prompt_chars, CASE WHEN event_id % 13 <> 0 THEN k * 4000 END AS elapsed_ms,
         CASE WHEN event_id % 4 = 2 THEN ['rust', 'python', 'sql'][(user_id % 3 + 1)::INT] END AS language, CASE WHEN event_id % 4 = 2 THEN k END AS loc,
         event_id % 9 = 0 AS is_canceled, CASE WHEN event_id % 17 = 0 THEN 'session' ELSE 'exact' END AS timestamp_quality
  FROM (SELECT *, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::BIGINT AS k FROM events)),
x AS (
  SELECT *, CASE WHEN session_id <> '' THEN tool || ':' || session_id END AS session_key,
         CASE WHEN rtrim(replace(trim(project), chr(92), '/'), '/') = '' THEN '(unknown)' ELSE rtrim(replace(trim(project), chr(92), '/'), '/') END AS identity,
         input_tokens + output_tokens + cache_write_tokens + cache_read_tokens AS tokens,
         regexp_replace(regexp_replace(split_part(regexp_extract(lower(trim(model)), '[^/]*$'), '@', 1), '-[0-9]{8}$', ''), '^claude-([0-9]+)[.-]([0-9]+)-([a-z]+)$', 'claude-\\3-\\1-\\2') AS canonical
  FROM calls)"""


# The models, tools and commands of detailed_calls.
MORE_MODELS = ("claude-opus-4-6-20260205", "vendor/claude-haiku-4-5", "gpt-5-mini", "claude-4.5-opus", "auto", "My-Proxy-9000", "gpt-6.1-codex-max", "claude-nova-1", "gemini-9-ultra", "", "Vendor/composer-1.5", "grok-4-5-fast@beta", "claude-sonnet-4-6")
MORE_TOOLS = ((), ("Read",), ("Edit", "Bash"), ("mcp__srv2__b", "TodoWrite"), ("EnterPlanMode", "Read"), ("Task", "Edit"), ("WebSearch",), ("TodoWrite",), ("Skill",), ("Bash", "Grep"), ("Bash",))
MORE_COMMANDS = ((), ("git push", "cargo test"), ("Docker build .",), ("git status",), ("ls -la", "gh pr create"), ("python -m pytest -q",), ("remake",))


def detailed_calls(x: DataFrame) -> DataFrame:
    """practice_calls with more models, tools and commands, hour-long cache writes, web searches and speeds."""
    i = F.col("seq")
    wide = practice_calls(x).withColumns({"model": _pick(i % len(MORE_MODELS), MORE_MODELS), "tools": _pick(i % len(MORE_TOOLS), MORE_TOOLS), "commands": _pick(F.floor(i / 3) % len(MORE_COMMANDS), [(c,) if isinstance(c, str) else c for c in MORE_COMMANDS])})
    wide = wide.withColumn("commands", F.when(F.array_contains("tools", "Bash") | (i % 5 == 0), F.col("commands")).otherwise(F.array().cast("array<string>")))
    more = {"canonical": canonical_key(F.col("model")), "cache_1h_tokens": F.when(i % 3 == 0, F.col("cache_write_tokens") * 2).otherwise(F.floor(F.col("cache_write_tokens") / 2)), "web_searches": i % 5, "speed": F.when(i % 7 == 0, "fast").otherwise("standard")}
    return wide.withColumns(more)


def _sql_lists(values) -> str:
    return "[" + ", ".join("[" + ", ".join(f"'{v}'" for v in ((row,) if isinstance(row, str) else row)) + "]::VARCHAR[]" for row in values) + "]"


#: The same as a DuckDB query over x.
DETAILED_SQL = f"""{PRACTICE_SQL},
dc0 AS (SELECT * REPLACE ([{', '.join(f"'{m}'" for m in MORE_MODELS)}][(seq % {len(MORE_MODELS)} + 1)::INT] AS model, {_sql_lists(MORE_TOOLS)}[(seq % {len(MORE_TOOLS)} + 1)::INT] AS tools, {_sql_lists(MORE_COMMANDS)}[(seq // 3 % {len(MORE_COMMANDS)} + 1)::INT] AS commands) FROM pc),
dc AS (SELECT * REPLACE (CASE WHEN list_contains(tools, 'Bash') OR seq % 5 = 0 THEN commands ELSE [] END AS commands,
    regexp_replace(regexp_replace(split_part(regexp_extract(lower(trim(model)), '[^/]*$'), '@', 1), '-[0-9]{{8}}$', ''), '^claude-([0-9]+)[.-]([0-9]+)-([a-z]+)$', 'claude-\\3-\\1-\\2') AS canonical),
  CASE WHEN seq % 3 = 0 THEN cache_write_tokens * 2 ELSE cache_write_tokens // 2 END AS cache_1h_tokens, seq % 5 AS web_searches, CASE WHEN seq % 7 = 0 THEN 'fast' ELSE 'standard' END AS speed FROM dc0)"""
