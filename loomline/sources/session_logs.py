"""Readers of AI coding tools' session files: one row for each model call, in the columns of CALLS.

Lines keep their file and order, so state that a file carries forward (the prompt,
the model, running totals) is a window fill over each file. A file is one session,
so its lines meet in one task; files are many. Lines that aren't JSON are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fences import code_fences, file_language
from ..functions.scripts import added_lines, lines_of, nested_calls_of
from ..functions.texts import elapsed_ms, split_commands
from ..operators.archive import merge_blocks

CALLS = (
    "tool string, model string, input_tokens bigint, output_tokens bigint, cache_write_tokens bigint, cache_write_1h_tokens bigint, cache_read_tokens bigint, reasoning_tokens bigint, "
    "web_search_requests bigint, tools array<string>, commands array<string>, timestamp timestamp, speed string, dedup_key string, user_message string, session_id string, project string, "
    "is_canceled boolean, prompt_chars bigint, response_chars bigint, elapsed_ms bigint, edited_files array<string>, referenced_files array<string>, code_blocks array<struct<language:string,loc:bigint>>, transcript_user string, transcript_assistant string, "
    "path string, line bigint"
)
# An interruption's mark, wrappers that aren't prompts, names of the same tool.
INTERRUPTED = "[Request interrupted by user"
WRAPPERS = ("<command-", "<local-command-")
CODEX_TOOLS = {"exec_command": "Bash", "read_file": "Read", "write_file": "Edit", "apply_patch": "Edit", "apply_diff": "Edit", "web_search": "WebSearch"}
GEMINI_TOOLS = {
    "read_file": "Read", "ReadFile": "Read", "write_file": "Write", "create_file": "Write", "WriteFile": "Write", "edit_file": "Edit", "EditFile": "Edit", "replace": "Edit",
    "delete_file": "Delete", "list_dir": "LS", "ListDir": "LS", "grep_search": "Grep", "search_files": "Grep", "SearchText": "Grep", "find_files": "Glob", "run_command": "Bash",
    "Shell": "Bash", "web_search": "WebSearch",
}
DEFAULT_CODEX_MODEL = "gpt-5"
MOST_FILES, FILE_CHARS, PROMPT_CHARS = 64, 512, 500


def read_lines(spark: SparkSession, path: str | list[str], pattern: str = "*.jsonl") -> DataFrame:
    """(path, line, value), with line rising in file order; splits of large files stay in order by their start."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    order = Window.partitionBy("path").orderBy("start", "id")
    return rows.withColumn("line", F.row_number().over(order).cast("long")).select("path", "line", "value")


def _json(column: str | Column, *path: str) -> Column:
    return F.get_json_object(column, "$." + ".".join(path))


def _long(column: str | Column, *path: str) -> Column:
    return F.coalesce(_json(column, *path).try_cast("long"), F.lit(0).cast("long"))


def _time(text: Column) -> Column:
    return F.try_to_timestamp(text)


def _forward(value: Column, order) -> Column:
    """The last value at or before a row."""
    return F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))


def _renamed(names: dict[str, str], name: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[name], name)


def _some(files: Column) -> Column:
    """The first distinct files, each cut to its bound."""
    return F.slice(F.array_distinct(F.transform(F.filter(files, lambda f: f.isNotNull() & (f != "")), lambda f: F.left(f, F.lit(FILE_CHARS)))), 1, MOST_FILES)


def _stem(path: str = "path") -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def as_calls(rows: DataFrame, *more: str) -> DataFrame:
    """rows with all columns of CALLS, and those in more: zero tokens, empty lists and nulls where a source has none."""
    out = []
    for field in CALLS.split(", "):
        name, kind = field.split(" ")
        empty = F.lit(0) if kind == "bigint" and name.endswith(("tokens", "requests")) else F.array() if kind.startswith("array") else F.lit(False) if kind == "boolean" else F.lit("standard") if name == "speed" else F.lit(None)
        out.append((F.coalesce(F.col(name).cast(kind), empty.cast(kind)) if name in rows.columns else empty.cast(kind)).alias(name))
    return rows.select(*out, *more)


_BLOCK = "array<struct<type:string,text:string,name:string,input:struct<command:string,file_path:string,notebook_path:string,content:string,new_string:string,new_source:string,edits:array<struct<new_string:string>>>>>"
_CODE = "array<struct<language:string,loc:bigint>>"


def _claude_text(content: Column, blocks: Column, between: str) -> Column:
    """A string as it is, or the text blocks joined; blocks: null for a string, which may start with a bracket too."""
    parts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.coalesce(F.array_join(parts, between), content, F.lit(""))


def _edit_blocks(edits: Column) -> Column:
    """Lines that edits write, by the language of the file."""
    nothing = F.array().cast(_CODE)

    def of(b: Column) -> Column:
        given = b["input"]
        language = file_language(F.coalesce(given["file_path"], given["notebook_path"]))
        one = lambda text: F.when(text != "", F.array(F.struct(language.alias("language"), lines_of(text).alias("loc"))))
        many = F.flatten(F.transform(F.coalesce(given["edits"], F.array().cast("array<struct<new_string:string>>")), lambda e: F.coalesce(one(e["new_string"]), nothing)))
        payload = F.when(b["name"] == "Write", one(given["content"])).when(b["name"] == "Edit", one(given["new_string"])).when(b["name"] == "NotebookEdit", one(given["new_source"])).otherwise(many)
        return F.coalesce(payload, nothing)

    return F.flatten(F.transform(edits, of))


def claude_rows(lines: DataFrame) -> DataFrame:
    """Lines with what their file carries forward: the prompt, the project, the last call that began, and which call an interruption cancels."""
    order = Window.partitionBy("path").orderBy("line")
    kind, role, content = _json("value", "type"), _json("value", "message", "role"), _json("value", "message", "content")
    rows = lines.where(F.get_json_object("value", "$.type").isNotNull()).select("path", "line", "value", kind.alias("kind"), role.alias("role"), content.alias("content"), _time(_json("value", "timestamp")).alias("timestamp"))
    rows = rows.withColumn("blocks", F.from_json(F.when(F.ltrim("content").startswith("["), F.col("content")), _BLOCK))
    text = F.when((F.col("kind") == "user") & (F.col("role") == "user"), _claude_text(F.col("content"), F.col("blocks"), " "))
    shown = F.trim(text)
    plain = (shown != "") & ~shown.startswith(INTERRUPTED) & ~shown.startswith(WRAPPERS[0]) & ~shown.startswith(WRAPPERS[1])
    prompt = F.when(plain, F.struct(text.alias("text"), F.col("timestamp").alias("at")))
    cwd = _json("value", "cwd")
    rows = rows.withColumn("prompt", _forward(prompt, order)).withColumn("project", _forward(F.when(F.trim(cwd) != "", cwd), order)).withColumn("interrupted", shown.startswith(INTERRUPTED))
    key = F.coalesce(_json("value", "message", "id"), F.concat(F.lit("claude:"), F.coalesce(_json("value", "timestamp"), F.lit(""))))
    billed = (F.col("kind") == "assistant") & _json("value", "message", "model").isNotNull() & _json("value", "message", "usage").isNotNull()
    rows = rows.withColumn("dedup_key", F.when(F.col("kind") == "assistant", key))
    # an interruption belongs to the last call that began before it
    rows = rows.withColumn("billed", billed).withColumn("begun", _forward(F.when(billed, F.col("dedup_key")), order))
    return rows.withColumn("cancels", F.when(F.col("interrupted"), F.col("begun")))


def claude_calls(lines: DataFrame) -> DataFrame:
    """Assistant lines with a model and usage; lines that repeat a message's id add activity, tokens stay the first line's."""
    return claude_calls_of(claude_rows(lines))


def claude_calls_of(rows: DataFrame) -> DataFrame:
    """claude_calls of claude_rows."""
    usage = lambda *p: _long("value", "message", "usage", *p)
    canceled = rows.where("cancels is not null").select("path", F.col("cancels").alias("dedup_key"), F.lit(True).alias("is_canceled")).distinct()
    uses = F.filter(F.coalesce("blocks", F.array().cast(_BLOCK)), lambda b: (b["type"] == "tool_use") & (b["name"] != ""))
    edits = F.filter(uses, lambda b: b["name"].isin("Write", "Edit", "MultiEdit", "NotebookEdit"))
    total = F.greatest(usage("cache_creation_input_tokens"), usage("cache_creation", "ephemeral_5m_input_tokens") + usage("cache_creation", "ephemeral_1h_input_tokens"))
    made = rows.where("dedup_key is not null").select(
        "path", "line", "dedup_key", "timestamp", "project", "prompt", "billed",
        F.transform(uses, lambda b: b["name"]).alias("tools"),
        F.flatten(F.transform(F.filter(uses, lambda b: b["name"].isin("Bash", "BashOutput") & b["input"]["command"].isNotNull()), lambda b: split_commands(b["input"]["command"]))).alias("commands"),
        F.transform(edits, lambda b: F.coalesce(b["input"]["file_path"], b["input"]["notebook_path"])).alias("edited_files"),
        F.transform(F.filter(uses, lambda b: b["name"] == "Read"), lambda b: b["input"]["file_path"]).alias("referenced_files"),
        _claude_text(F.col("content"), F.col("blocks"), "\n").alias("reply"), _edit_blocks(edits).alias("written"),
        _json("value", "message", "model").alias("model"), F.coalesce(_json("value", "sessionId"), _stem()).alias("session_id"),
        usage("input_tokens").alias("input_tokens"), usage("output_tokens").alias("output_tokens"), total.alias("cache_write_tokens"),
        F.least(usage("cache_creation", "ephemeral_1h_input_tokens"), total).alias("cache_write_1h_tokens"), usage("cache_read_input_tokens").alias("cache_read_tokens"),
        usage("server_tool_use", "web_search_requests").alias("web_search_requests"),
        F.when(_json("value", "message", "usage", "speed") == "fast", "fast").otherwise("standard").alias("speed"),
    )
    # what comes before the billed line of a message doesn't count
    ordered = made.withColumn("first", F.min(F.when(F.col("billed"), F.col("line"))).over(Window.partitionBy("path", "dedup_key"))).where("line >= first")
    from_first = [F.min_by(c, "line").alias(c) for c in ("timestamp", "project", "prompt", "model", "session_id", "input_tokens", "output_tokens", "cache_write_tokens", "cache_write_1h_tokens", "cache_read_tokens", "web_search_requests", "speed")]
    gathered = F.sort_array(F.collect_list(F.struct("line", "tools", "commands", "edited_files", "referenced_files", "reply", F.concat(code_fences(F.col("reply")), F.col("written")).alias("code")))).alias("all")
    calls = ordered.groupBy("path", "dedup_key").agg(*from_first, gathered, F.min("line").alias("line")).join(canceled, ["path", "dedup_key"], "left")
    replies = F.filter(F.col("all.reply"), lambda r: r != "")
    calls = calls.select(
        "*", F.lit("claude-code").alias("tool"), F.flatten("all.tools").alias("tools"), F.flatten("all.commands").alias("commands"), _some(F.flatten("all.edited_files")).alias("edited_files"),
        _some(F.flatten("all.referenced_files")).alias("referenced_files"), merge_blocks(F.flatten("all.code")).alias("code_blocks"), F.array_join(replies, "\n").alias("transcript_assistant"), F.aggregate(F.transform(replies, F.length), F.lit(0), lambda a, n: a + n).alias("response_chars"),
        F.col("prompt.text").alias("transcript_user"), F.left("prompt.text", F.lit(PROMPT_CHARS)).alias("user_message"), F.length("prompt.text").alias("prompt_chars"), elapsed_ms(F.col("timestamp"), F.col("prompt.at")).alias("elapsed_ms"),
    )
    return as_calls(calls)


def codex_calls(lines: DataFrame) -> DataFrame:
    """token_count events as deltas of running totals; tools and replies since the event before belong to each."""
    order = Window.partitionBy("path").orderBy("line")
    p = lambda *path: _json("value", "payload", *path)
    rows = lines.where(_json("value", "type").isNotNull()).select("path", "line", "value", _json("value", "type").alias("kind"), p("type").alias("event"), _json("value", "timestamp").alias("at"))
    meta = F.when((F.col("line") == 1) & (F.col("kind") == "session_meta"), F.struct(p("id").alias("id"), p("forked_from_id").alias("parent"), p("cwd").alias("cwd"), p("originator").alias("originator"), _time(F.col("at")).alias("at")))
    rows = rows.withColumn("meta", _forward(meta, order)).where(F.lower("meta.originator").contains("codex")).withColumn("timestamp", _time(F.col("at")))
    hint = F.coalesce(*[F.nullif(F.trim(p(*path, n)), F.lit("")) for path in (("info",), ("info", "metadata"), (), ("metadata",)) for n in ("model", "model_name")])
    counted = (F.col("kind") == "event_msg") & (F.col("event") == "token_count")
    says = F.when((F.col("kind") == "event_msg") & (F.col("event") == "user_message"), F.nullif(F.trim(p("message")), F.lit("")))
    rows = rows.withColumn("model", _forward(F.when((F.col("kind") == "turn_context") | counted, hint), order))
    rows = rows.withColumn("prompt", _forward(F.when(says.isNotNull(), F.struct(says.alias("text"), F.col("timestamp").alias("at"))), order))
    raw, space = p("name"), p("namespace")
    is_call = (F.col("kind") == "response_item") & F.col("event").isin("function_call", "custom_tool_call") & raw.isNotNull()
    named = F.when(space.rlike("^mcp__.+__$"), F.concat(space, raw)).otherwise(_renamed(CODEX_TOOLS, raw))
    # a script names the tools that it calls
    inner = nested_calls_of(F.when(is_call & (raw == "exec"), F.coalesce(p("arguments"), p("input"))))
    rows = rows.withColumn("inner", inner)
    scripted = F.size("inner") > 0
    named = F.when(scripted, F.transform("inner", lambda c: _renamed(CODEX_TOOLS, c["name"]))).otherwise(F.array(named))
    commands = F.flatten(F.transform(F.filter("inner", lambda c: (c["name"] == "exec_command") & c["command"].isNotNull()), lambda c: split_commands(c["command"])))
    args = F.when(scripted, commands).when(is_call & (raw == "exec_command"), split_commands(_json(p("arguments"), "cmd")))
    reply = F.when((F.col("kind") == "event_msg") & (F.col("event") == "agent_message"), p("message"))
    ends = counted & p("info").isNotNull() & (p("info", "total_token_usage").isNotNull() | p("info", "last_token_usage").isNotNull())
    rows = rows.withColumns({"named": F.when(is_call, named), "args": args, "reply": reply, "ends": ends, "aborted": (F.col("kind") == "event_msg") & (F.col("event") == "turn_aborted")})
    rows = rows.withColumn("step", F.coalesce(F.sum(F.col("ends").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    patched = F.when((F.col("kind") == "event_msg") & (F.col("event") == "patch_apply_end") & (p("success") == "true"), p("changes"))
    changes = F.json_object_keys(patched)
    diffs = F.map_entries(F.from_json(patched, "map<string,struct<unified_diff:string>>"))
    added = F.filter(F.transform(diffs, lambda d: F.struct(file_language(d["key"]).alias("language"), added_lines(d["value"]["unified_diff"]).alias("loc"))), lambda b: b["loc"] > 0)
    code = F.concat(code_fences(F.col("reply")), F.coalesce(added, F.array().cast(_CODE)))
    steps = rows.groupBy("path", "step").agg(F.sort_array(F.collect_list(F.struct("line", F.col("named"), F.col("args"), F.col("reply"), changes.alias("files"), code.alias("code")))).alias("all"))
    names = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
    total, last = p("info", "total_token_usage"), p("info", "last_token_usage")
    events = rows.where("ends").select("path", "line", "step", "at", "timestamp", "meta", "model", "prompt", total.isNotNull().alias("running"), F.struct(*[_long(F.coalesce(total, last), n).alias(n) for n in names]).alias("t"))
    before = F.last(F.when(F.col("running"), F.col("t")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    delta = lambda n: F.when(F.col("running"), F.greatest(F.col(f"t.{n}") - F.coalesce(F.col(f"before.{n}"), F.lit(0)), F.lit(0))).otherwise(F.col(f"t.{n}"))
    events = events.withColumn("before", before).withColumns({n: delta(n) for n in names})
    root = F.coalesce(*[F.nullif(c, F.lit("")) for c in (F.col("meta.parent"), F.col("meta.id"))], _stem())
    key = F.when(F.col("running"), F.concat_ws(":", F.lit("codex"), root, *[F.col(f"t.{n}") for n in names])).otherwise(F.concat_ws(":", F.lit("codex"), root, F.lit("last"), F.coalesce("at", F.lit("")), *[F.col(n) for n in names[:4]]))
    replayed = (F.col("meta.parent") != "") & (F.col("timestamp") < F.col("meta.at") + F.expr("INTERVAL 5 SECONDS"))
    spent = F.col("input_tokens") + F.col("cached_input_tokens") + F.col("output_tokens") + F.col("reasoning_output_tokens") > 0
    events = events.withColumn("dedup_key", key).where(spent & ~F.coalesce(replayed, F.lit(False)))
    events = events.withColumn("place", F.row_number().over(Window.partitionBy("dedup_key").orderBy("path", "line"))).where("place = 1")
    # an abort belongs to the last call before it
    aborts = events.select("path", "line", F.lit(False).alias("abort")).unionByName(rows.where("aborted").select("path", "line", F.lit(True).alias("abort")))
    aborts = aborts.withColumn("call", _forward(F.when(~F.col("abort"), F.col("line")), order))
    canceled = aborts.where("abort and call is not null").select("path", F.col("call").alias("line"), F.lit(True).alias("is_canceled")).distinct()
    joined = events.join(steps, ["path", "step"]).join(canceled, ["path", "line"], "left")
    replies = F.filter(F.col("all.reply"), lambda r: r.isNotNull())
    calls = joined.select(
        "path", "line", "timestamp", "dedup_key", "is_canceled", F.lit("codex").alias("tool"), F.coalesce("model", F.lit(DEFAULT_CODEX_MODEL)).alias("model"),
        F.greatest(F.col("input_tokens") - F.col("cached_input_tokens"), F.lit(0)).alias("input_tokens"), (F.col("output_tokens") + F.col("reasoning_output_tokens")).alias("output_tokens"),
        F.col("cached_input_tokens").alias("cache_read_tokens"), F.col("reasoning_output_tokens").alias("reasoning_tokens"), F.flatten(F.filter("all.named", lambda n: n.isNotNull())).alias("tools"), merge_blocks(F.flatten("all.code")).alias("code_blocks"),
        F.flatten(F.filter("all.args", lambda a: a.isNotNull())).alias("commands"), _some(F.flatten(F.filter("all.files", lambda a: a.isNotNull()))).alias("edited_files"), _stem().alias("session_id"),
        F.col("meta.cwd").alias("project"), F.col("prompt.text").alias("transcript_user"), F.left("prompt.text", F.lit(PROMPT_CHARS)).alias("user_message"), F.length("prompt.text").alias("prompt_chars"),
        F.array_join(replies, "\n").alias("transcript_assistant"), F.when(F.size(replies) > 0, F.aggregate(F.transform(replies, F.length), F.lit(0), lambda a, n: a + n)).alias("response_chars"),
        elapsed_ms(F.col("timestamp"), F.col("prompt.at")).alias("elapsed_ms"),
    )
    return as_calls(calls)


_GEMINI = "struct<sessionId:string,startTime:string,messages:array<string>>"
_GEMINI_CALLS = "array<struct<name:string,displayName:string,args:struct<command:string>>>"


def gemini_calls(files: DataFrame) -> DataFrame:
    """Files are (path, value) with whole texts: one JSON document, or JSON lines after a line about the session."""
    doc = F.from_json("value", _GEMINI)
    split = F.filter(F.split("value", r"\r?\n"), lambda v: F.trim(v) != "")
    header = F.get(F.filter(split, lambda v: _json(v, "sessionId").isNotNull() & _json(v, "startTime").isNotNull()), 0)
    whole = F.coalesce((F.col("doc.sessionId") != "") & (F.size("doc.messages") > 0), F.lit(False))
    rows = files.withColumn("doc", doc).select(
        "path", F.when(whole, F.col("doc.sessionId")).otherwise(_json(header, "sessionId")).alias("session_id"), F.when(whole, F.col("doc.startTime")).otherwise(_json(header, "startTime")).alias("started"),
        F.posexplode(F.when(whole, F.col("doc.messages")).otherwise(F.filter(split, lambda v: _json(v, "id").isNotNull() & _json(v, "type").isNotNull()))).alias("line", "m"),
    )
    rows = rows.where("session_id <> ''")
    order = Window.partitionBy("path").orderBy("line")
    content = _json("m", "content")
    parts = F.from_json(F.when(F.ltrim(content).startswith("["), content), "array<struct<text:string>>")
    text = F.when(F.ltrim(content).startswith("["), F.array_join(F.filter(parts["text"], lambda t: t.isNotNull()), " ")).otherwise(F.coalesce(content, F.lit("")))
    rows = rows.withColumns({"text": text, "at": _time(_json("m", "timestamp"))})
    rows = rows.withColumn("prompt", _forward(F.when((_json("m", "type") == "user") & (F.trim("text") != ""), F.struct("text", "at")), order))
    t = {n: _long("m", "tokens", n) for n in ("input", "output", "cached", "thoughts", "tool", "total")}
    rows = rows.withColumns({f"t_{n}": c for n, c in t.items()}).withColumn("model", _json("m", "model"))
    rows = rows.where(_json("m", "type").isin("gemini", "model", "assistant") & (F.col("model") != "") & _json("m", "tokens").isNotNull() & (F.col("t_input") + F.col("t_output") + F.col("t_cached") + F.col("t_thoughts") > 0))
    made = F.col("t_output") + F.col("t_tool")
    unexplained = F.greatest(F.col("t_total") - (F.col("t_input") + made + F.col("t_cached") + F.col("t_thoughts")), F.lit(0))
    by_id, by_what = F.concat_ws(":", F.lit("gemini"), "session_id", _json("m", "id")), F.concat_ws(":", F.lit("gemini"), "session_id", F.coalesce(_json("m", "timestamp"), F.lit("")), "model", F.concat_ws("+", "t_input", "t_output", F.col("t_cached") + F.col("t_tool") + F.col("t_total")))
    used = F.coalesce(F.from_json(_json("m", "toolCalls"), _GEMINI_CALLS), F.array().cast(_GEMINI_CALLS))
    known = lambda n: F.create_map(*[F.lit(x) for pair in GEMINI_TOOLS.items() for x in pair])[n]
    tool = lambda c: F.coalesce(known(F.coalesce(c["displayName"], F.lit(""))), known(F.coalesce(c["name"], F.lit(""))), F.nullif(c["displayName"], F.lit("")), c["name"], F.lit(""))
    calls = rows.select(
        "path", F.col("line").cast("long").alias("line"), "session_id", "model", F.lit("gemini").alias("tool"), F.greatest(F.col("t_input") - F.col("t_cached"), F.lit(0)).alias("input_tokens"),
        (made + unexplained + F.col("t_thoughts")).alias("output_tokens"), F.col("t_cached").alias("cache_read_tokens"), F.col("t_thoughts").alias("reasoning_tokens"),
        F.when(F.coalesce(_json("m", "id"), F.lit("")) != "", by_id).otherwise(by_what).alias("dedup_key"), F.coalesce("at", _time(F.col("started"))).alias("timestamp"),
        F.filter(F.transform(used, tool), lambda n: n != "").alias("tools"), F.flatten(F.transform(F.filter(used, lambda c: (tool(c) == "Bash") & c["args"]["command"].isNotNull()), lambda c: split_commands(c["args"]["command"]))).alias("commands"),
        F.col("prompt.text").alias("transcript_user"), F.left("prompt.text", F.lit(PROMPT_CHARS)).alias("user_message"), F.length("prompt.text").alias("prompt_chars"), F.col("text").alias("transcript_assistant"), merge_blocks(code_fences(F.col("text"))).alias("code_blocks"),
        F.length("text").alias("response_chars"), elapsed_ms(F.col("at"), F.col("prompt.at")).alias("elapsed_ms"),
    )
    calls = calls.withColumn("place", F.row_number().over(Window.partitionBy("dedup_key").orderBy("path", "line"))).where("place = 1")
    return as_calls(calls)


_METRICS = "map<string,struct<usage:struct<inputTokens:bigint,cacheReadTokens:bigint,cacheWriteTokens:bigint>>>"


def copilot_event_calls(lines: DataFrame) -> DataFrame:
    """Output by reply under the last model chosen, each prompt with its first reply, and the input that the shutdown event sums up by model."""
    order = Window.partitionBy("path").orderBy("line")
    kind = _json("value", "type")
    session = F.element_at(F.split("path", "/"), -2)
    rows = lines.where(kind.isNotNull()).select("path", "line", "value", kind.alias("kind"), session.alias("session_id"), _time(_json("value", "timestamp")).alias("timestamp"))
    rows = rows.withColumn("model", _forward(F.when(F.col("kind") == "session.model_change", F.nullif(_json("value", "data", "newModel"), F.lit(""))), order))
    said = F.when(F.col("kind") == "user.message", _json("value", "data", "content"))
    rows = rows.withColumn("prompt", _forward(F.when(said.isNotNull(), F.struct("line", said.alias("text"))), order))
    replies = rows.where((F.col("kind") == "assistant.message") & (_long("value", "data", "outputTokens") > 0) & F.col("model").isNotNull() & _json("value", "data", "messageId").isNotNull())
    replies = replies.withColumn("dedup_key", F.concat_ws(":", F.lit("copilot"), "session_id", _json("value", "data", "messageId")))
    replies = replies.withColumn("place", F.row_number().over(Window.partitionBy("dedup_key").orderBy("path", "line"))).where("place = 1")
    first = F.row_number().over(Window.partitionBy("path", "prompt.line").orderBy("line")) == 1
    names = F.from_json(_json("value", "data", "toolRequests"), "array<struct<name:string>>")["name"]
    spoken = replies.withColumn("mine", F.when(first, F.col("prompt.text"))).select("path", "line", "session_id", "model", "timestamp", "dedup_key", _long("value", "data", "outputTokens").alias("output_tokens"), F.filter(names, lambda n: n != "").alias("tools"), F.left("mine", F.lit(PROMPT_CHARS)).alias("user_message"), F.length("mine").alias("prompt_chars"), F.col("mine").alias("transcript_user"))
    metrics = F.explode(F.from_json(_json("value", "data", "modelMetrics"), _METRICS)).alias("model", "m")
    started = F.timestamp_millis(_long("value", "data", "sessionStartTime"))
    ends = rows.where("kind = 'session.shutdown'").select("path", "line", "session_id", F.coalesce("timestamp", started).alias("timestamp"), metrics)
    n = lambda name: F.coalesce(F.col(f"m.usage.{name}"), F.lit(0))
    ends = ends.select("path", "line", "session_id", "timestamp", "model", F.concat_ws(":", F.lit("copilot"), "session_id", F.lit("shutdown"), "model").alias("dedup_key"), F.greatest(n("inputTokens") - n("cacheReadTokens") - n("cacheWriteTokens"), F.lit(0)).alias("input_tokens"), n("cacheReadTokens").alias("cache_read_tokens"), n("cacheWriteTokens").alias("cache_write_tokens"))
    ends = ends.where("input_tokens + cache_read_tokens + cache_write_tokens > 0").withColumn("place", F.row_number().over(Window.partitionBy("dedup_key").orderBy("path", "line"))).where("place = 1")
    return as_calls(spoken.unionByName(ends.drop("place"), allowMissingColumns=True).withColumn("tool", F.lit("copilot")))


def codex_limits(lines: DataFrame) -> DataFrame:
    """The rate-limit states that token_count events carry."""
    limits = _json("value", "payload", "rate_limits")
    rows = lines.where((_json("value", "payload", "type") == "token_count") & (_json(limits, "limit_id") != "")).select("path", "line", _time(_json("value", "timestamp")).alias("observed_at"), limits.alias("l"))

    def window(name: str) -> Column:
        w = _json("l", name)
        return F.when(w.isNotNull(), F.struct(_json(w, "used_percent").try_cast("double").alias("used_percent"), _json(w, "window_minutes").try_cast("long").alias("window_minutes"), F.timestamp_seconds(_json(w, "resets_at").try_cast("long")).alias("resets_at"))).alias(name)

    c = _json("l", "credits")
    credits = F.when(c.isNotNull(), F.struct((_json(c, "has_credits") == "true").alias("has_credits"), (_json(c, "unlimited") == "true").alias("unlimited"), _json(c, "balance").try_cast("double").alias("balance"))).alias("credits")
    return rows.select(F.lit("codex").alias("tool"), _json("l", "limit_id").alias("limit_id"), _json("l", "limit_name").alias("limit_name"), _json("l", "plan_type").alias("plan_type"), "observed_at", window("primary"), window("secondary"), credits, "path", "line")


def all_calls(*by_tool: DataFrame) -> DataFrame:
    """Sources in their order; of calls with one (tool, dedup_key) the first by source, path and line stays."""
    ranked = [c.withColumn("source_rank", F.lit(i)) for i, c in enumerate(by_tool)]
    every = ranked[0]
    for c in ranked[1:]:
        every = every.unionByName(c)
    first = Window.partitionBy("tool", "dedup_key").orderBy("source_rank", "path", "line")
    return every.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
