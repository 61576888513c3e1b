"""Rows of the driver's tables in the forms that the readers of sources take."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cursor_state
from .copilot_stores import ATTRIBUTES


def spans(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans and their attributes: two chats, a tool and an agent of every four events, seven events a trace."""
    i = F.col("event_id")
    rows = events.select(
        F.concat(F.lit("s"), i).alias("span_id"), F.concat(F.lit("t"), F.floor(i / 7)).alias("trace_id"), F.element_at(F.array(*map(F.lit, ("chat", "execute_tool", "invoke_agent", "chat"))), (i % 4 + 1).cast("int")).alias("operation_name"),
        (i * 1000 + 1_700_000_000_000).alias("start_time_ms"), F.when(i % 5 == 0, "m-2").alias("response_model"),
    )
    own: dict[str, Column] = {
        "conversation": F.when(i % 3 != 0, F.concat(F.lit("c"), F.floor(i / 70))), "repository": F.when(i % 11 == 0, F.concat(F.lit("https://h/o/r"), i % 10, F.lit(".git"))),
        "tool_name": F.element_at(F.array(*map(F.lit, ("run_in_terminal", "read_file", "odd"))), (i % 3 + 1).cast("int")), "arguments": F.when(i % 3 == 0, F.lit('{"command": "git add .\\ncargo test"}')),
        "parent": F.when(i % 8 == 2, "p"), "agent": F.lit("helper"), "input": F.get_json_object("props", "$.k"), "output": (i % 50).cast("string"), "answered_by": F.when(i % 3 == 0, "m-1").when(i % 3 == 1, ""), "asked": F.when(i % 2 == 0, "m-0"),
        "turn": F.when(i % 5 == 0, i.cast("string")),
    }
    pairs = F.array(*[F.struct(F.lit(ATTRIBUTES[name]).alias("key"), value.alias("value")) for name, value in own.items()])
    attributes = events.select(F.concat(F.lit("s"), i).alias("span_id"), F.explode(pairs).alias("x")).select("span_id", "x.*").where("value is not null")
    return rows, attributes


def journals(conversations: DataFrame) -> DataFrame:
    """(path, line, value): for each conversation a journal that starts empty, appends its rows as requests and then sets their results."""
    every = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    text = conversations.groupBy("conv_id").agg(every.alias("rows"))
    start = F.to_json(F.struct(F.lit(0).alias("kind"), F.struct(F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.array().cast("array<string>").alias("requests")).alias("v")))
    request = lambda r, i: F.struct(F.concat(F.lit("r"), i).alias("requestId"), F.struct(r["text"].alias("text")).alias("message"), F.array(r["text"]).alias("response"))
    appended = F.transform("rows", lambda r, i: F.to_json(F.struct(F.lit(2).alias("kind"), request(r, i).alias("v"))))
    result = lambda r, i: F.struct(F.struct(F.length(r["text"]).alias("promptTokens"), (r["turn"] * 3).alias("outputTokens"), F.lit("gpt-5").alias("resolvedModel")).alias("metadata"))
    # a path has strings and numbers, so it is written by hand
    placed = F.transform("rows", lambda r, i: F.concat(F.lit('{"kind": 1, "k": ["requests", '), i, F.lit(', "result"], "v": '), F.to_json(result(r, i)), F.lit("}")))
    lines = F.concat(F.array(start), appended, placed)
    return text.select(F.concat(F.lit("/journals/"), "conv_id", F.lit(".json")).alias("path"), F.posexplode(lines).alias("line", "value")).select("path", F.col("line").cast("long").alias("line"), "value")


def stores(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Turns, sessions, usage events of every third turn, and running totals."""
    i, t = F.col("conv_id"), F.col("turn_index")
    by_role = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    both = conversations.withColumn("turn_index", F.floor(F.col("turn") / 2)).groupBy("conv_id", "turn_index").agg(by_role("user").alias("user_message"), by_role("assistant").alias("assistant_response"))
    session = F.concat(F.lit("s"), i)
    turns = both.select(session.alias("session_id"), "turn_index", "user_message", "assistant_response", F.lit("2024-01-01 10:00:00").alias("timestamp"))
    each = conversations.select("conv_id").distinct()
    sessions = each.select(session.alias("id"), F.when(i % 2 == 0, F.concat(F.lit(" /w/p"), i % 5)).alias("cwd"), F.when(i % 3 == 0, "o/r").otherwise("null").alias("repository"))
    events = both.where((i + t) % 3 == 0).select(
        (i * 1000 + t).alias("id"), session.alias("session_id"), F.when(i % 7 != 0, t).alias("turn_index"), F.when(i % 2 == 0, "m").otherwise(" ").alias("model"), (F.length(F.coalesce("user_message", F.lit(""))) * 2).cast("long").alias("input_tokens"),
        (t - 1).alias("output_tokens"), (i % 90).alias("cache_read_tokens"), F.lit(3).cast("long").alias("cache_write_tokens"), F.lit(None).cast("long").alias("reasoning_tokens"), F.lit("2024-01-01T10:00:00+02:00").alias("created_at"),
    )
    none = F.lit(None).cast("string")
    totals = each.select(session.alias("id"), F.lit("m").alias("model"), (i % 4 * 100).alias("total_input_tokens"), (i % 2 * 9).alias("total_output_tokens"), (i * 7).alias("total_cached_tokens"), F.lit(-1).cast("long").alias("total_reasoning_tokens"), F.lit("2024-01-02 00:00:00").alias("created_at"), none.alias("updated_at"))
    return turns, sessions, events, totals


#: Files that session_files spreads conversations over.
FILES = 16


def session_files(conversations: DataFrame, folder: str) -> None:
    """Write conversations as session files of JSON lines, a file for each conv_id modulo FILES, by conversation and turn."""
    user = F.struct(F.lit("user").alias("type"), F.lit("2024-01-01T10:00:00Z").alias("timestamp"), F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content")).alias("message"))
    key = F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn")
    usage = F.struct(F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"))
    reply = F.struct(F.lit("assistant").alias("type"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.lit("2024-01-01T10:00:05Z").alias("timestamp"), F.struct(key.alias("id"), F.lit("assistant").alias("role"), F.lit("claude-opus-4").alias("model"), F.col("text").alias("content"), usage.alias("usage")).alias("message"))
    rows = conversations.withColumns({"text": F.coalesce("text", F.lit("")), "file": F.col("conv_id") % FILES}).select("file", "conv_id", "turn", "role", F.when(F.col("role") == "assistant", F.to_json(reply)).otherwise(F.to_json(user)).alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "conv_id", "turn", "role", "value").select("file", "value").write.partitionBy("file").text(folder)


def _as(df: DataFrame, schema: str) -> DataFrame:
    """df with all columns of a schema, null where it has none."""
    fields = [f.split(" ") for f in schema.split(", ")]
    return df.select(*[(F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def cursor_stores(conversations: DataFrame) -> cursor_state.Stores:
    """Conversations as Cursor's: headers in their order, every fourth with its own tokens, every third with a meter, every fifth with a store's turns."""
    i = F.col("conv_id")
    every = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    gathered = conversations.groupBy("conv_id").agg(every.alias("rows"))
    composer = F.concat(F.lit("c"), i)
    composers = gathered.select(composer.alias("id"), F.transform("rows", lambda r, n: F.concat(F.lit("b"), n)).alias("headers"), F.when(i % 2 == 0, "gpt-5").alias("model"), F.when(i % 3 == 0, (i * 10).cast("string")).alias("meter_used"), F.lit("ask").alias("unified_mode"))
    each = gathered.select("conv_id", F.posexplode("rows").alias("n", "r")).select("conv_id", "n", "r.*")
    bubbles = each.select(
        composer.alias("composer_id"), F.concat(F.lit("bubbleId:"), "n").alias("key"), F.concat(F.lit("b"), "n").alias("id"), F.when(F.col("role") == "user", 1).otherwise(2).alias("type"), "text",
        F.when((F.col("role") == "user") & (F.col("n") % 4 < 2), F.concat(F.lit("r"), i, F.lit("-"), "n")).alias("request_id"), F.when((i % 4 == 0) & (F.col("role") != "user"), F.col("n") % 3 * 5).alias("output_tokens"),
    )
    stored = gathered.where(i % 5 == 0).select(composer.alias("composer_id"), F.lit(0).alias("place"), F.lit("stored answer").alias("response_text"), F.array(F.lit("Read")).alias("tools"))
    spark = conversations.sparkSession
    return dataclasses.replace(cursor_state.empty(spark), composers=_as(composers, cursor_state.COMPOSERS), bubbles=_as(bubbles, cursor_state.BUBBLES), store_turns=_as(stored, cursor_state.TURNS))


def _document(orders: DataFrame, value: Column) -> DataFrame:
    return orders.select(F.concat(F.lit("/limits/"), "o_orderkey").alias("path"), F.to_json(value).alias("value"), F.col("o_orderdate").cast("timestamp").alias("modified"))


def limit_documents(orders: DataFrame) -> dict[str, DataFrame]:
    """(path, value, modified) for each order in the form of a status line, of two subscriptions and of quotas."""
    i = F.col("o_orderkey")
    s = lambda **fields: F.struct(*[c.alias(n) for n, c in fields.items()])
    at = F.concat(F.lit("2024-01-0"), i % 9 + 1, F.lit("T00:00:00Z"))
    status = s(rate_limits=s(five_hour=s(used_percentage=i % 101, resets_at=i * 1000), seven_day=F.when(i % 3 != 0, s(used_percentage=i % 7))))
    claude = s(observed_at=at, usage=s(five_hour=s(utilization=i % 150, resets_at=F.when(i % 4 != 0, at)), seven_day_opus=s(utilization=i % 5)), overage=F.when(i % 2 == 0, s(monthly_limit=i % 3 * 1000, used_credits=i % 900)))
    codex = s(plan_type=F.lit("plus"), rate_limit=s(primary_window=s(used_percent=i % 120, limit_window_seconds=i % 3 * 3600, reset_at=F.when(i % 2 == 0, i * 1000)), limit_reached=i % 11 == 0), credits=s(has_credits=i % 6 == 0, balance=F.when(i % 4 == 0, (i % 10).cast("string"))), spend_control=s(reached=i % 9 == 0))
    sku = F.when(i % 3 == 0, "monthly_subscriber_quota").when(i % 3 == 1, "copilot_business_seat")
    quotas = F.create_map(F.lit("premium_interactions"), s(entitlement=F.lit(300), remaining=i % 400, unlimited=F.lit(False)), F.lit("chat"), s(entitlement=F.lit(0), remaining=F.lit(0).cast("long"), unlimited=F.lit(True)))
    copilot = s(login=F.when(i % 5 == 0, "me"), payload=s(access_type_sku=sku, copilot_plan=F.lit("individual_max"), quota_reset_date=F.lit("2024-02-01"), quota_snapshots=quotas))
    return {name: _document(orders, value) for name, value in (("status", status), ("claude", claude), ("codex", codex), ("copilot", copilot))}
