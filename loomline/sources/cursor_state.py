"""Cursor's conversations put together from its stores.

Messages ("bubbles") of a conversation are ordered by the list of ids in its header, then by
time and key. A user's message opens a turn, those of the assistant up to the next one belong
to it. What a turn lacks is filled, in this order, from the agent store's turns, requests, the context of
its message, and transcripts; turns match by request id, else by their place. Tokens are
the messages' own, else a quarter of the characters. Where Cursor counted only the
conversation's context, one row for the conversation holds that as input.

All tables come as DataFrames; missing ones are empty. A conversation's messages meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session_logs import PROMPT_CHARS, _some, as_calls

AUTO, OTHER_PROJECT = "cursor-auto", "cursor"
# The names of the same tool, and parts of names of tools that edit or read files.
TOOLS = {
    "bash": "Bash", "shell": "Bash", "terminal": "Bash", "run-terminal-command": "Bash", "read": "Read", "read-file": "Read", "grep": "Grep", "search": "Grep", "codebase-search": "Grep", "glob": "Glob", "find-files": "Glob",
    "write": "Write", "write-file": "Write", "strreplace": "StrReplace", "str-replace": "StrReplace", "edit-file": "StrReplace", "createplan": "CreatePlan", "create-plan": "CreatePlan", "readlints": "ReadLints", "read-lints": "ReadLints",
}
EDITING = ("write", "edit", "delete", "apply", "strreplace", "create")
READING = ("read", "grep", "glob", "search", "find", "list")
TURN = "user_message string, response_text string, reasoning_text string, model string, tools array<string>, commands array<string>, edited_files array<string>, referenced_files array<string>, elapsed_ms bigint"
#: Columns of the tables.
COMPOSERS = "id string, headers array<string>, model string, force_mode string, unified_mode string, is_agentic boolean, status string, created_at timestamp, meter_used string, meter_context string"
BUBBLES = (
    "composer_id string, key string, id string, request_id string, type int, text string, created_raw string, created_at timestamp, input_tokens bigint, output_tokens bigint, model string, duration_ms bigint, unified_mode string, is_agentic boolean, is_plan boolean, "
    "legacy_conversation_id string, tool_name string, tool_status string, tool_files array<string>, tool_commands array<string>, attached_files array<string>, edited_files array<string>"
)
TURNS = f"composer_id string, place int, request_id string, {TURN}"
AGENT_TURNS = f"request_id string, {TURN}"
CONTEXTS = "composer_id string, bubble_id string, referenced_files array<string>, edited_files array<string>"
SESSIONS = "composer_id string, model string, mode string, project string, edited_files array<string>, paths array<string>"
NAMES = [field.split(" ")[0] for field in TURN.split(", ")]
TEXTS, LISTS = NAMES[:3], NAMES[4:8]


@dataclass
class Stores:
    """The tables of one installation: store_turns and transcript_turns as TURNS; tracking, store_sessions, transcripts and workspaces as SESSIONS."""

    composers: DataFrame
    bubbles: DataFrame
    agent_turns: DataFrame
    contexts: DataFrame
    store_turns: DataFrame
    transcript_turns: DataFrame
    tracking: DataFrame
    store_sessions: DataFrame
    transcripts: DataFrame
    workspaces: DataFrame


def interaction_mode(*names: Column, agentic: Column, plan: Column | None = None) -> Column:
    """Plan, chat, agent or unknown, by the first name that tells, else by the flag."""
    out = F.when(F.coalesce(plan, F.lit(False)), "plan") if plan is not None else F.when(F.lit(False), "")
    for name in map(F.lower, names):
        out = out.when(name.contains("plan"), "plan").when(name.contains("chat") | (name == "ask"), "chat").when(name.contains("agent") | name.contains("auto") | (name == "edit"), "agent")
    return out.when(agentic, "agent").when(~agentic, "chat").otherwise("unknown")


def tool_name(raw: Column) -> Column:
    """A tool's common name."""
    clean = F.trim(raw)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in TOOLS.items() for x in pair])[F.translate(F.lower(clean), "_ ", "--")], clean)


def user_query(text: Column) -> Column:
    """What stands between the marks of a query, else the text, trimmed."""
    inner = F.regexp_extract(text, r"(?s)<user_query>(.*?)</user_query>", 1)
    return F.regexp_replace(F.when(text.rlike(r"(?s)<user_query>.*?</user_query>"), inner).otherwise(text), r"^\s+|\s+$", "")


def workspace_path(text: Column) -> Column:
    """The path that a prompt names as its workspace."""
    return F.nullif(F.regexp_extract(text, r"(?im)^[ \t]*workspace path:[ \t]*([/~][^\r\n]*?)[ \t]*\r?$", 1), F.lit(""))


def meter(used: Column, context: Column) -> Column:
    """The first of two counts that is 1 or more, else 0."""
    value = lambda c: F.when(F.trim(c).try_cast("double").between(1.0, 9e18), F.floor(F.trim(c).try_cast("double")).cast("long"))
    return F.coalesce(value(used), value(context), F.lit(0).cast("long"))


def _distinct(*lists: Column) -> Column:
    nothing = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(x, nothing) for x in lists]), lambda x: x.isNotNull() & (x != "")))


def _filled(mine: dict[str, Column], other: dict[str, Column], other_first: bool = False) -> dict[str, Column]:
    """Mine with what it lacks from other; lists are joined. other_first: texts that other has replace mine."""
    out = {}
    for name in NAMES:
        if name in TEXTS:
            a, b = (other[name], mine[name]) if other_first else (mine[name], other[name])
            out[name] = F.coalesce(F.when(a != "", a), b, a, F.lit(""))
        elif name in LISTS:
            out[name] = _distinct(mine[name], other[name])
        else:
            out[name] = F.coalesce(mine[name], other[name])
    return out


def _struct(columns: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def _fields(column: str) -> dict[str, Column]:
    return {n: F.col(f"{column}.{n}") for n in NAMES}


def state_turns(composers: DataFrame, bubbles: DataFrame) -> DataFrame:
    """(composer_id, place, user, assistants), place from 0; assistants in order."""
    headers = composers.select(F.col("id").alias("composer_id"), "headers").dropDuplicates(["composer_id"])
    rows = bubbles.where("composer_id <> ''").join(headers, "composer_id", "left")
    # of an id that is listed twice the last place counts
    listed = F.size("headers") - F.array_position(F.reverse("headers"), F.col("id"))
    place = F.when(F.array_contains("headers", F.col("id")), listed).otherwise(F.lit(2**31 - 1))
    order = Window.partitionBy("composer_id").orderBy("at", F.col("created_at").asc_nulls_first(), "key")
    rows = rows.withColumn("at", F.coalesce(place, F.lit(2**31 - 1))).withColumn("nth", F.row_number().over(order))
    rows = rows.withColumn("place", F.sum((F.col("type") == 1).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).where("place >= 0 and type in (0, 1, 2)")
    own = [f.split(" ")[0] for f in BUBBLES.split(", ") if not f.startswith("composer_id")]
    bubble = F.struct("nth", *own)
    return rows.groupBy("composer_id", "place").agg(F.min_by(bubble, F.when(F.col("type") == 1, F.col("nth"))).alias("user"), F.sort_array(F.collect_list(F.when(F.col("type") != 1, bubble))).alias("assistants"))


def _own_turn() -> dict[str, Column]:
    """What a turn's messages say themselves; tools that were cancelled don't count."""
    texts = F.filter(F.transform("assistants", lambda b: b["text"]), lambda t: t.isNotNull() & (t != ""))
    used = F.filter("assistants", lambda b: b["tool_name"].isNotNull() & (F.coalesce(b["tool_status"], F.lit("")) != "cancelled"))
    named = lambda b: F.lower(tool_name(b["tool_name"]))
    any_of = lambda c, parts: c.rlike("|".join(parts))
    nothing = F.array().cast("array<string>")
    files = lambda b, kind: F.when(b["tool_name"].isNotNull() & (F.coalesce(b["tool_status"], F.lit("")) != "cancelled") & kind(named(b)), F.coalesce(b["tool_files"], nothing)).otherwise(nothing)
    edits = lambda c: any_of(c, EDITING)
    reads = lambda c: ~any_of(c, EDITING) & any_of(c, READING)
    by_message = lambda field, kind: F.flatten(F.transform("assistants", lambda b: F.concat(F.coalesce(b[field], nothing), files(b, kind))))
    return {
        "user_message": user_query(F.coalesce("user.text", F.lit(""))),
        "response_text": F.array_join(texts, "\n"),
        "reasoning_text": F.lit(""),
        "model": F.lit(None).cast("string"),
        "tools": _distinct(F.transform(used, lambda b: tool_name(b["tool_name"]))),
        "commands": _distinct(F.flatten(F.transform(F.filter(used, lambda b: tool_name(b["tool_name"]) == "Bash"), lambda b: F.coalesce(b["tool_commands"], nothing)))),
        "edited_files": _distinct(F.col("user.edited_files"), by_message("edited_files", edits)),
        "referenced_files": _distinct(F.col("user.attached_files"), by_message("attached_files", reads)),
        "elapsed_ms": F.lit(None).cast("long"),
    }


def _matched(turns: DataFrame, others: DataFrame, name: str) -> DataFrame:
    """Turns with the other store's turn as a struct: that of the same request, the first of several, else that at the same place."""
    kept = others.select("composer_id", "place", "request_id", F.struct(*NAMES).alias("t"))
    by_request = kept.where("request_id is not null").groupBy("composer_id", "request_id").agg(F.min_by("t", "place").alias("same"))
    by_place = kept.groupBy("composer_id", "place").agg(F.min_by("t", F.coalesce("request_id", F.lit(""))).alias("beside"))
    return turns.join(by_request, ["composer_id", "request_id"], "left").join(by_place, ["composer_id", "place"], "left").withColumn(name, F.coalesce("same", "beside")).drop("same", "beside")


def _last(condition, value) -> Column:
    """The value of the last assistant message that meets a condition."""
    return F.try_element_at(F.transform(F.filter("assistants", condition), value), F.lit(-1))


def cursor_calls(s: Stores, project: str = OTHER_PROJECT) -> DataFrame:
    """CALLS with superseded, token_quality, timestamp_quality and interaction_mode: a call for each turn, and one for the input of each conversation that only its meter counts."""
    turns = state_turns(s.composers, s.bubbles)
    requested = F.coalesce(F.col("user.request_id"), F.try_element_at(F.filter(F.transform("assistants", lambda b: b["request_id"]), lambda r: r.isNotNull()), F.lit(1)))
    total = lambda c: F.aggregate("assistants", F.greatest(F.coalesce(F.col(f"user.{c}"), F.lit(0)), F.lit(0)).cast("long"), lambda n, b: n + F.greatest(F.coalesce(b[c], F.lit(0)), F.lit(0)))
    turns = turns.withColumns({"request_id": requested, "own_input": total("input_tokens"), "own_output": total("output_tokens")})
    whole = Window.partitionBy("composer_id")
    turns = turns.withColumns({"n": F.max("place").over(whole) + 1, "explicit": F.max(F.greatest("own_input", "own_output")).over(whole) > 0})
    known = s.composers.select(
        F.col("id").alias("composer_id"), F.col("model").alias("composer_model"), interaction_mode(F.col("force_mode"), F.col("unified_mode"), agentic=F.col("is_agentic")).alias("composer_mode"), F.coalesce(F.col("status") == "aborted", F.lit(False)).alias("aborted"),
        F.col("created_at").alias("composer_at"), meter(F.col("meter_used"), F.col("meter_context")).alias("meter"),
    ).dropDuplicates(["composer_id"])
    side = lambda df, name: df.select("composer_id", F.struct("model", "mode", "project", "edited_files", "paths").alias(name)).dropDuplicates(["composer_id"])
    turns = turns.join(known, "composer_id", "left")
    for df, name in ((s.tracking, "tracking"), (s.store_sessions, "store"), (s.transcripts, "transcript"), (s.workspaces, "workspace")):
        turns = turns.join(side(df, name), "composer_id", "left")
    turns = _matched(_matched(turns, s.store_turns, "store_turn"), s.transcript_turns, "transcript_turn")
    turns = turns.join(s.agent_turns.select("request_id", F.struct(*NAMES).alias("agent")).dropDuplicates(["request_id"]), "request_id", "left")
    turns = turns.join(s.contexts.select("composer_id", F.col("bubble_id").alias("user_id"), F.struct("referenced_files", "edited_files").alias("context")).dropDuplicates(["composer_id", "user_id"]).withColumnRenamed("composer_id", "c"), (F.col("c") == F.col("composer_id")) & (F.col("user_id") == F.col("user.id")), "left").drop("c", "user_id")
    # each step is a column of its own, so that what comes later doesn't work it out again
    turns = turns.withColumn("rich", _struct(_own_turn()))
    turns = turns.withColumn("rich", F.when(F.col("store_turn").isNotNull(), _struct(_filled(_fields("rich"), _fields("store_turn"), other_first=True))).otherwise(F.col("rich")))
    turns = turns.withColumn("rich", F.when(F.col("agent").isNotNull(), _struct(_filled(_fields("rich"), _fields("agent")))).otherwise(F.col("rich")))
    more = _fields("rich") | {c: _distinct(F.col(f"rich.{c}"), F.col(f"context.{c}")) for c in ("referenced_files", "edited_files")}
    turns = turns.withColumn("rich", _struct(more))
    turns = turns.withColumn("rich", F.when(F.col("transcript_turn").isNotNull(), _struct(_filled(_fields("rich"), _fields("transcript_turn")))).otherwise(F.col("rich")))
    last_turn = F.col("place") + 1 == F.col("n")
    edited = F.when((F.size("rich.edited_files") == 0) & last_turn, F.coalesce("tracking.edited_files", F.array().cast("array<string>"))).otherwise(F.col("rich.edited_files"))
    said = lambda b: b["tool_name"].isNull() & ((F.coalesce(b["text"], F.lit("")) != "") | (F.coalesce(b["output_tokens"], F.lit(0)) > 0))
    final = F.when(F.exists("assistants", said), _last(said, lambda b: b["created_at"])).otherwise(F.try_element_at(F.transform("assistants", lambda b: b["created_at"]), F.lit(-1)))
    gap = F.unix_millis("timestamp") - F.unix_millis("user.created_at")
    prompt, response = F.length("rich.user_message").cast("long"), (F.length("rich.response_text") + F.length("rich.reasoning_text")).cast("long")
    metered = F.coalesce(F.col("meter") > 0, F.lit(False)) & ~F.col("explicit")
    turns = turns.withColumns({"timestamp": F.coalesce(final, F.col("user.created_at")), "metered": metered, "prompt_chars": prompt, "response_chars": response, "edited_files": edited})
    # Tokens of the messages, else estimates; a metered conversation's input stands in a row of its own
    counted_prompt, counted_input = F.when(F.col("metered"), F.lit(0)).otherwise(F.col("prompt_chars")), F.when(F.col("metered"), F.lit(0)).otherwise(F.col("own_input"))
    guessed_input, guessed_output = (counted_input == 0) & (counted_prompt > 0), (F.col("own_output") == 0) & (F.col("response_chars") > 0)
    quarter = lambda c: F.floor((c + 3) / 4).cast("long")
    exact, guessed = (counted_input > 0) | (F.col("own_output") > 0), guessed_input | guessed_output
    quality = F.when(exact & guessed, "mixed").when(exact, "exact").when(guessed, "estimated").otherwise("unknown")
    mode_of = lambda b: interaction_mode(b["unified_mode"], agentic=b["is_agentic"], plan=b["is_plan"])
    known_mode = lambda c: F.when(c != "unknown", c)
    mode = F.coalesce(_last(lambda b: mode_of(b) != "unknown", mode_of), known_mode(mode_of(F.col("user"))), known_mode(F.col("composer_mode")), known_mode(F.col("tracking.mode")), known_mode(F.col("store.mode")), F.lit("unknown"))
    model = F.coalesce(F.col("agent.model"), _last(lambda b: b["model"].isNotNull(), lambda b: b["model"]), F.col("user.model"), F.col("composer_model"), F.col("tracking.model"), F.col("store.model"), F.lit(AUTO))
    where = F.coalesce(workspace_path(F.col("rich.user_message")), *[F.col(f"{x}.project") for x in ("transcript", "tracking", "store", "workspace")], F.lit(project))
    legacy = lambda b: F.concat(F.lit("cursor:"), F.coalesce(b["legacy_conversation_id"], F.lit("unknown")), F.lit(":"), F.coalesce(b["created_raw"], F.lit("")), F.lit(":"), *[x for c, end in (("input_tokens", ":"), ("output_tokens", "")) for x in (F.greatest(F.coalesce(b[c], F.lit(0)), F.lit(0)).cast("string"), F.lit(end))])
    paths = F.transform(F.coalesce("transcript.paths", F.array().cast("array<string>")), lambda p: F.concat(F.lit("cursor:transcript:"), p, F.lit(":"), "composer_id", F.lit(":"), F.col("place").cast("string")))
    superseded = F.array_compact(F.concat(F.array(legacy(F.col("user"))), F.transform("assistants", legacy), F.array(F.concat(F.lit("cursor:agentKv:"), "request_id")), paths))
    calls = turns.select(
        F.lit("cursor").alias("tool"), model.alias("model"), F.when(guessed_input, quarter(counted_prompt)).otherwise(counted_input).alias("input_tokens"), F.when(guessed_output, quarter(F.col("response_chars"))).otherwise(F.col("own_output")).alias("output_tokens"),
        F.col("rich.tools").alias("tools"), F.col("rich.commands").alias("commands"), "timestamp", F.concat(F.lit("cursor:composer:"), "composer_id", F.lit(":"), F.coalesce("request_id", "user.id")).alias("dedup_key"), F.left("rich.user_message", F.lit(PROMPT_CHARS)).alias("user_message"),
        F.col("composer_id").alias("session_id"), where.alias("project"), (F.coalesce("aborted", F.lit(False)) & last_turn).alias("is_canceled"), "prompt_chars", "response_chars", F.coalesce(_last(lambda b: b["duration_ms"] >= 0, lambda b: b["duration_ms"]), F.when(gap >= 0, gap), F.col("rich.elapsed_ms")).alias("elapsed_ms"),
        _some(F.col("edited_files")).alias("edited_files"), _some(F.col("rich.referenced_files")).alias("referenced_files"), F.col("rich.user_message").alias("transcript_user"), F.col("rich.response_text").alias("transcript_assistant"), F.col("place").cast("long").alias("line"),
        superseded.alias("superseded"), quality.alias("token_quality"), F.when(F.col("timestamp").isNotNull(), "exact").otherwise("unknown").alias("timestamp_quality"), mode.alias("interaction_mode"), "metered", "meter", "composer_at", "composer_mode",
    )
    calls = calls.withColumn("speed", F.when(F.lower("model").contains("fast"), "fast").otherwise("standard"))
    credits = calls.where("metered").groupBy("session_id").agg(*[F.min_by(c, "line").alias(c) for c in ("model", "project", "speed", "meter", "composer_mode")], F.first("composer_at").alias("composer_at"), F.min_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("line"))).alias("first_at"))
    credits = credits.select(
        F.lit("cursor").alias("tool"), "model", "project", "speed", "session_id", F.col("meter").alias("input_tokens"), F.coalesce("composer_at", "first_at").alias("timestamp"), F.concat(F.lit("cursor:composer-input:"), "session_id").alias("dedup_key"), F.lit("estimated").alias("token_quality"),
        F.when(F.coalesce("composer_at", "first_at").isNotNull(), "session").otherwise("unknown").alias("timestamp_quality"), F.col("composer_mode").alias("interaction_mode"), F.array().cast("array<string>").alias("superseded"), F.lit(2**31).cast("long").alias("line"),
    )
    return as_calls(calls.unionByName(credits, allowMissingColumns=True), "superseded", "token_quality", "timestamp_quality", "interaction_mode")


def longest_versions(transcripts: DataFrame) -> DataFrame:
    """Of the files of one conversation (conversation_id, path, n_turns, project) the one with most turns, the first of equals; with the first project that a file names, and the paths of all."""
    every = Window.partitionBy("conversation_id")
    best = F.row_number().over(every.orderBy(F.desc("n_turns"), "path"))
    project = F.min_by("project", F.when(F.col("project").isNotNull(), F.col("path"))).over(every)
    return transcripts.where("n_turns > 0").withColumns({"best": best, "project": project, "paths": F.sort_array(F.collect_set("path").over(every))}).where("best = 1").drop("best")


def empty(spark) -> Stores:
    """No rows in any table."""
    none = lambda schema: spark.createDataFrame([], schema)
    return Stores(none(COMPOSERS), none(BUBBLES), none(AGENT_TURNS), none(CONTEXTS), none(TURNS), none(TURNS), none(SESSIONS), none(SESSIONS), none(SESSIONS), none(SESSIONS))
