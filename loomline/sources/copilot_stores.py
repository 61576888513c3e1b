"""Copilot's other stores as DataFrames: trace spans, chat journals, the turn store and running totals (S30-S33), and what they supersede.

A store's tables come as DataFrames of their columns; rows of the calls are those of
session_logs.CALLS with superseded, the keys of rows that the call takes the place of.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fences import epoch_time
from ..functions.texts import split_commands
from .session_logs import PROMPT_CHARS, as_calls

AUTO, OTHER_PROJECT = "copilot-auto", "copilot-cli"
# The names of the same tool.
TOOLS = {
    "bash": "Bash", "run_in_terminal": "Bash", "kill_terminal": "Bash", "read_file": "Read", "write_file": "Edit", "edit_file": "Edit", "replace_string_in_file": "Edit", "apply_patch": "Edit", "create_file": "Write",
    "delete_file": "Delete", "search_files": "Grep", "file_search": "Grep", "find_files": "Glob", "list_directory": "LS", "list_dir": "LS", "web_search": "WebSearch", "fetch_webpage": "WebFetch", "github_repo": "GitHub", "memory": "Memory",
}
# The attributes of spans that are read.
ATTRIBUTES = {
    "conversation": "gen_ai.conversation.id", "repository": "github.copilot.git.repository", "tool_name": "gen_ai.tool.name", "arguments": "gen_ai.tool.call.arguments", "parent": "copilot_chat.parent_chat_session_id",
    "agent": "gen_ai.agent.name", "input": "gen_ai.usage.input_tokens", "output": "gen_ai.usage.output_tokens", "cache_read": "gen_ai.usage.cache_read.input_tokens", "cache_write": "gen_ai.usage.cache_creation.input_tokens",
    "answered_by": "gen_ai.response.model", "asked": "gen_ai.request.model", "turn": "github.copilot.chat.turn.id",
}


def tool_name(name: Column) -> Column:
    """A tool's common name."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in TOOLS.items() for x in pair])[name], name)


def _some(text: Column) -> Column:
    """The text, null if empty."""
    return F.when(text != "", text)


def _count(text: Column) -> Column:
    """A whole number of 0 or more, else 0."""
    digits = F.trim(text)
    return F.coalesce(F.when(digits.rlike(r"^\+?[0-9]+$"), digits.try_cast("long")), F.lit(0).cast("long"))


def span_calls(spans: DataFrame, attributes: DataFrame, project: str = "copilot-chat") -> DataFrame:
    """A call for each chat span with tokens, by time and span.

    spans: span_id, trace_id, operation_name, start_time_ms, response_model. attributes: span_id, key, value; of repeated
    keys the last by row counts, if there is such a column. Tools and commands are those of the trace's
    other spans, the project that of the first span of the conversation with a repository.
    """
    # only the keys that are read go through the shuffle
    names = {key: name for name, key in ATTRIBUTES.items()}
    read = attributes.where(F.col("key").isin(list(names)))
    last = F.col("row") if "row" in attributes.columns else F.lit(0)
    value = F.coalesce("value", F.lit(""))
    wide = read.groupBy("span_id").agg(*[F.max_by(F.when(F.col("key") == key, value), F.when(F.col("key") == key, last)).alias(name) for key, name in names.items()])
    rows = spans.join(wide, "span_id", "left").withColumn("operation", F.coalesce("operation_name", F.lit("")))
    place = F.struct("start_time_ms", "span_id")
    repository = F.regexp_replace(F.element_at(F.split(F.regexp_replace(F.trim("repository"), "/+$", ""), "/"), -1), r"(\.git)+$", "")
    projects = rows.where("conversation is not null and repository <> ''").groupBy("conversation").agg(F.min_by(repository, place).alias("named"))
    name = tool_name(F.col("tool_name"))
    command = F.coalesce(F.get_json_object("arguments", "$.command"), F.get_json_object("arguments", "$.cmd"))
    run = F.when((name == "Bash") & command.isNotNull(), split_commands(F.translate(command, "\n", ";")))
    used = rows.where("(operation = 'execute_tool' and tool_name <> '') or (operation = 'invoke_agent' and parent is not null and agent <> '')")
    used = used.select("trace_id", F.struct(place.alias("place"), F.when(F.col("operation") == "invoke_agent", "Agent").otherwise(name).alias("tool"), F.when(F.col("operation") == "execute_tool", run).alias("commands")).alias("use"))
    traces = used.groupBy("trace_id").agg(F.sort_array(F.collect_list("use")).alias("uses"))
    chats = rows.where("operation = 'chat'").withColumns({c: _count(F.col(c)) for c in ("input", "output", "cache_read", "cache_write")}).where("input > 0 or output > 0")
    chats = chats.join(traces, "trace_id", "left").join(projects, "conversation", "left")
    session = F.coalesce(_some(F.col("conversation")), F.col("trace_id"))
    model = F.coalesce(_some(F.coalesce("answered_by", "asked")), _some(F.col("response_model")), F.lit(AUTO))
    calls = chats.select(
        "span_id", F.col("start_time_ms").alias("line"), F.lit("copilot").alias("tool"), model.alias("model"), F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cache_write").alias("cache_write_tokens"), F.col("cache_read").alias("cache_read_tokens"),
        F.transform("uses", lambda u: u["tool"]).alias("tools"), F.flatten(F.filter(F.transform("uses", lambda u: u["commands"]), lambda c: c.isNotNull())).alias("commands"), epoch_time(F.col("start_time_ms")).alias("timestamp"),
        F.concat(F.lit("copilot-otel:"), "span_id").alias("dedup_key"), session.alias("session_id"), F.coalesce("named", F.lit(project)).alias("project"),
        F.when(F.col("turn") != "", F.array(F.concat(F.lit("copilot:"), session, F.lit(":"), "turn"))).otherwise(F.array().cast("array<string>")).alias("superseded"),
    )
    calls = calls.withColumn("nth", F.row_number().over(Window.partitionBy("dedup_key").orderBy("line"))).where("nth = 1")
    return as_calls(calls, "superseded")


#: What is kept of a request while a journal is folded; the rest, its answer above all, is not read.
_REQUEST = ("result", "completionTokens", "modelId", "requestId", "timestamp", "message")


def _walk(root: list, segments: list[str]):
    """(container, key) of the value at a path, with empty objects made where null stands; None if there is no such place. root holds the document."""
    holder, key = root, 0
    for name in segments:
        if holder[key] is None:
            holder[key] = {}
        value = holder[key]
        if isinstance(value, dict):
            value.setdefault(name, None)
            holder, key = value, name
        elif isinstance(value, list) and re.fullmatch(r"\+?[0-9]+", name) and int(name) < len(value):
            holder, key = value, int(name)
        else:
            return None
    return holder, key


def _segments(path) -> list[str] | None:
    if not isinstance(path, list) or any(isinstance(s, bool) or not isinstance(s, str | int | float) for s in path):
        return None
    return [s if isinstance(s, str) else json.dumps(s) for s in path]


def _lean(request):
    return {k: request[k] for k in _REQUEST if k in request} if isinstance(request, dict) else request


def fold_journal(root: list, line: str) -> None:
    """Apply one line of a journal to the document that root holds: kind 0 sets it, 1 sets a value at a path, 2 appends to a list at a path (requests, if none is given)."""
    try:
        entry = json.loads(line)
    except ValueError:
        return
    kind = entry.get("kind") if isinstance(entry, dict) else None
    if isinstance(kind, bool) or not isinstance(kind, int) or "v" not in entry:
        return
    value = entry["v"]
    if kind == 0:
        if isinstance(value, dict) and isinstance(value.get("requests"), list):
            value["requests"] = [_lean(r) for r in value["requests"]]
        root[0] = value
    elif kind == 1 and (segments := _segments(entry.get("k"))):
        if segments[0] == "requests" and len(segments) == 2:
            value = _lean(value)
        if segments[0] == "requests" and len(segments) > 2 and segments[2] not in _REQUEST:
            return
        place = _walk(root, segments[:-1])
        if place and isinstance(target := place[0][place[1]], dict):
            target[segments[-1]] = value
    elif kind == 2:
        segments = _segments(entry.get("k"))
        segments = ["requests"] if segments is None else segments
        if segments[:1] == ["requests"] and len(segments) > 2 and segments[2] not in _REQUEST:
            return
        if place := _walk(root, segments):
            if place[0][place[1]] is None:
                place[0][place[1]] = []
            items = place[0][place[1]]
            if isinstance(items, list):
                more = value if isinstance(value, list) else [value]
                items += [_lean(r) for r in more] if segments == ["requests"] else more


def _fold_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines come sorted by path and line; a task holds one journal's document at a time."""
    root, open_path = [None], None

    def requests() -> pa.RecordBatch:
        doc = root[0] if isinstance(root[0], dict) else {}
        found = doc.get("requests") if isinstance(doc.get("requests"), list) else []
        session = doc["sessionId"] if isinstance(doc.get("sessionId"), str) else None
        created = doc.get("creationDate")
        created = created if isinstance(created, int) and not isinstance(created, bool) and abs(created) < 1 << 63 else None
        n = len(found)
        return pa.RecordBatch.from_arrays([pa.array([open_path] * n, pa.string()), pa.array([session] * n, pa.string()), pa.array([created] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([json.dumps(r) for r in found], pa.string())], ["path", "session", "created", "line", "request"])

    for batch in batches:
        for path, line in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if path != open_path:
                if open_path is not None:
                    yield requests()
                root, open_path = [None], path
            fold_journal(root, line or "")
    if open_path is not None:
        yield requests()


_USES = "toolName:string,name:string,tool:string"
_NESTED = ("tools", "toolCalls", "toolRequests")
_FIELDS = (
    f"struct<result:struct<metadata:struct<promptTokens:bigint,outputTokens:bigint,resolvedModel:string,toolCallRounds:array<struct<{_USES},{','.join(f'{n}:array<struct<{_USES}>>' for n in _NESTED)}>>>>,"
    "completionTokens:bigint,modelId:string,requestId:string,message:struct<text:string>>"
)


def journal_calls(lines: DataFrame, project: str = "copilot-chat") -> DataFrame:
    """A call for each request with tokens of each folded journal; lines: path, line, value.

    A journal's lines are folded in one task, which keeps only what is read of its requests; journals are dealt out by their path.
    """
    dealt = lines.select("path", "line", "value").repartition("path").sortWithinPartitions("path", "line")
    rows = dealt.select("path", "value").mapInArrow(_fold_files, "path string, session string, created bigint, line bigint, request string")
    r = rows.withColumn("r", F.from_json("request", _FIELDS))
    meta = lambda name: F.col(f"r.result.metadata.{name}")
    count = lambda c: F.when(c >= 0, c)
    answered = F.coalesce(F.when(meta("outputTokens") > 0, meta("outputTokens")), count(F.col("r.completionTokens")), F.lit(0))
    chosen = F.regexp_replace("r.modelId", "^copilot/", "")
    model = F.coalesce(_some(meta("resolvedModel")), F.when((chosen != "") & (chosen != "auto"), chosen), F.lit(AUTO))
    session = F.coalesce("session", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    first = lambda u: F.coalesce(*[_some(u[k]) for k in ("toolName", "name", "tool")])
    nested = lambda u: [F.transform(F.coalesce(u[n], F.array().cast(f"array<struct<{_USES}>>")), first) for n in _NESTED]
    names = F.flatten(F.transform(meta("toolCallRounds"), lambda u: F.concat(F.array(first(u)), *nested(u))))
    raw = F.get_json_object("request", "$.timestamp")
    at = F.coalesce(epoch_time(raw.try_cast("long")), F.try_to_timestamp(raw), epoch_time(F.col("created")))
    calls = r.select(
        "path", "line", F.lit("copilot").alias("tool"), model.alias("model"), F.coalesce(count(meta("promptTokens")), F.lit(0)).alias("input_tokens"), answered.alias("output_tokens"), F.transform(F.filter(names, lambda n: n.isNotNull()), tool_name).alias("tools"), at.alias("timestamp"),
        F.concat(F.lit("copilot-chatsession:"), session, F.lit(":"), F.coalesce("r.requestId", F.concat(F.lit("request-"), "line"))).alias("dedup_key"), session.alias("session_id"), F.lit(project).alias("project"),
        F.left(F.coalesce("r.message.text", F.lit("")), F.lit(PROMPT_CHARS)).alias("user_message"), F.coalesce("r.message.text", F.lit("")).alias("transcript_user"), F.array().cast("array<string>").alias("superseded"),
    )
    calls = calls.where("input_tokens > 0 or output_tokens > 0")
    calls = calls.withColumn("nth", F.row_number().over(Window.partitionBy("dedup_key").orderBy("path", "line"))).where("nth = 1")
    return as_calls(calls, "superseded")


def _store_time(text: Column) -> Column:
    """With a zone, or to the second in UTC."""
    zoned = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ].*([Zz]|[+-][0-9]{2}:[0-9]{2})$"), F.try_to_timestamp(text))
    return F.coalesce(zoned, F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), F.try_to_timestamp(text)))


def _store_project(project: str) -> Column:
    cwd, repository = F.trim("cwd"), F.trim("repository")
    return F.coalesce(F.when((F.length(cwd) > 1) & (cwd != "null"), cwd), F.when((repository != "") & (repository != "null"), repository), F.lit(project))


def _bytes_over_four(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / F.lit(4.0)).cast("long")


def store_calls(turns: DataFrame, sessions: DataFrame, events: DataFrame, project: str = OTHER_PROJECT) -> DataFrame:
    """A call for each usage event, and an estimate for each turn without one.

    turns: session_id, turn_index, user_message, assistant_response, timestamp. sessions: id, cwd, repository.
    events: id, session_id, turn_index, model, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens, created_at.
    A turn's texts go with its first event. An event supersedes its turn's estimate and its session's running total.
    """
    places = sessions.select(F.col("id").alias("session_id"), "cwd", "repository")
    said = F.trim(F.coalesce("user_message", F.lit(""))) != ""
    answered = F.trim(F.coalesce("assistant_response", F.lit(""))) != ""
    texts = turns.where(said | answered).select("session_id", "turn_index", F.coalesce("user_message", F.lit("")).alias("user"), F.coalesce("assistant_response", F.lit("")).alias("assistant"), "timestamp")
    first_of_turn = (F.row_number().over(Window.partitionBy("session_id", "turn_index").orderBy("id")) == 1) & F.col("turn_index").isNotNull()
    n = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long")
    used = events.withColumns({c: n(F.col(c)) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")}).withColumn("first", first_of_turn)
    used = used.join(places, "session_id", "left").join(texts.dropDuplicates(["session_id", "turn_index"]).drop("timestamp"), ["session_id", "turn_index"], "left")
    read = F.least("cache_read_tokens", "input_tokens")
    turn_key = F.concat(F.lit("copilot:"), "session_id", F.lit(":turn-"), "turn_index")
    own = lambda c: F.when(F.col("first"), F.col(c))
    from_events = used.select(
        F.lit("copilot").alias("tool"), F.when(F.trim(F.coalesce("model", F.lit(""))) == "", AUTO).otherwise(F.col("model")).alias("model"), (F.col("input_tokens") - read).alias("input_tokens"), "output_tokens", "cache_write_tokens", read.alias("cache_read_tokens"), "reasoning_tokens",
        _store_time(F.col("created_at")).alias("timestamp"), F.concat(F.coalesce(turn_key, F.concat(F.lit("copilot:"), "session_id")), F.lit(":usage-"), F.col("id").cast("string")).alias("dedup_key"), F.left(F.coalesce(own("user"), F.lit("")), F.lit(PROMPT_CHARS)).alias("user_message"),
        own("user").alias("transcript_user"), own("assistant").alias("transcript_assistant"), "session_id", _store_project(project).alias("project"), F.col("id").alias("line"),
        F.array_compact(F.array(F.concat(F.lit("copilot:cli:"), "session_id"), turn_key)).alias("superseded"),
    )
    bare = texts.join(events.where("turn_index is not null").select("session_id", "turn_index").distinct(), ["session_id", "turn_index"], "left_anti").join(places, "session_id", "left")
    estimates = bare.select(
        F.lit("copilot").alias("tool"), F.lit(AUTO).alias("model"), _bytes_over_four(F.col("user")).alias("input_tokens"), _bytes_over_four(F.col("assistant")).alias("output_tokens"), _store_time(F.col("timestamp")).alias("timestamp"), turn_key.alias("dedup_key"),
        F.left("user", F.lit(PROMPT_CHARS)).alias("user_message"), F.col("user").alias("transcript_user"), F.col("assistant").alias("transcript_assistant"), "session_id", _store_project(project).alias("project"), F.col("turn_index").alias("line"),
    ).dropDuplicates(["dedup_key"])
    return as_calls(from_events.unionByName(estimates.withColumn("superseded", F.array().cast("array<string>")), allowMissingColumns=True), "superseded")


def total_calls(totals: DataFrame, events: DataFrame, project: str = OTHER_PROJECT) -> DataFrame:
    """A call for each session's running total, but for sessions with usage events.

    totals: id, model, total_input_tokens, total_output_tokens, total_cached_tokens, total_reasoning_tokens, created_at, updated_at.
    """
    n = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long")
    rows = totals.join(events.select(F.col("session_id").alias("id")).distinct(), "id", "left_anti")
    rows = rows.select("*", n("total_input_tokens").alias("all_input"), n("total_output_tokens").alias("output_tokens"), n("total_reasoning_tokens").alias("reasoning_tokens")).where("all_input > 0 or output_tokens > 0")
    read = F.least(n("total_cached_tokens"), F.col("all_input"))
    calls = rows.select(
        F.lit("copilot").alias("tool"), F.when(F.trim(F.coalesce("model", F.lit(""))) == "", AUTO).otherwise(F.col("model")).alias("model"), (F.col("all_input") - read).alias("input_tokens"), "output_tokens", read.alias("cache_read_tokens"), "reasoning_tokens",
        F.coalesce(_store_time(F.col("updated_at")), _store_time(F.col("created_at"))).alias("timestamp"), F.concat(F.lit("copilot:cli:"), "id").alias("dedup_key"), F.col("id").alias("session_id"), F.lit(project).alias("project"), F.array().cast("array<string>").alias("superseded"),
    )
    return as_calls(calls.dropDuplicates(["dedup_key"]), "superseded")


def superseded_keys(calls: DataFrame) -> DataFrame:
    """(tool, dedup_key) of the rows that other calls supersede, for archive.zero_superseded."""
    return calls.select("tool", F.explode("superseded").alias("dedup_key"), F.col("dedup_key").alias("by")).where("`by` <> dedup_key").select("tool", "dedup_key").distinct()
