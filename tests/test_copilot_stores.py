"""Spans, chat journals and stores on small hand-made tables."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.operators import archive
from loomline.sources import copilot_stores as stores

SPANS = "span_id string, trace_id string, operation_name string, start_time_ms long, response_model string"


def test_spans(spark):
    spans = spark.createDataFrame([
        ("c1", "t1", "chat", 1_700_000_000_000, None), ("c2", "t2", "chat", 1_700_000_001, "gpt-x"), ("c3", "t1", "chat", 1_700_000_002_000, ""), ("c4", "t3", "chat", 1_700_000_003_000, None),
        ("x1", "t1", "execute_tool", 1_700_000_000_500, None), ("x2", "t1", "execute_tool", 1_700_000_000_400, None), ("x3", "t1", "execute_tool", 1_700_000_000_600, None),
        ("a1", "t1", "invoke_agent", 1_700_000_000_300, None), ("a2", "t1", "invoke_agent", 1_700_000_000_700, None), ("n1", "t9", None, 5, None),
    ], SPANS)
    attributes = {
        "c1": {"gen_ai.usage.input_tokens": " 12 ", "gen_ai.usage.output_tokens": "3", "gen_ai.usage.cache_read.input_tokens": "-4", "gen_ai.usage.cache_creation.input_tokens": "7", "gen_ai.response.model": "m-1", "gen_ai.request.model": "m-0", "gen_ai.conversation.id": "conv", "github.copilot.chat.turn.id": "turn9"},
        "c2": {"gen_ai.usage.output_tokens": "5", "gen_ai.response.model": "", "gen_ai.request.model": "m-0", "gen_ai.conversation.id": ""},
        "c3": {"gen_ai.usage.input_tokens": "1.5", "gen_ai.usage.output_tokens": "x"},
        "c4": {"gen_ai.usage.input_tokens": "1", "gen_ai.conversation.id": "conv"},
        "x1": {"gen_ai.tool.name": "run_in_terminal", "gen_ai.tool.call.arguments": json.dumps({"cmd": "git add .\ngit push"}), "github.copilot.git.repository": "https://host/owner/late.git", "gen_ai.conversation.id": "conv"},
        "x2": {"gen_ai.tool.name": "read_file", "github.copilot.git.repository": " https://host/owner/app.git/ ", "gen_ai.conversation.id": "conv"},
        "x3": {"gen_ai.tool.name": ""},
        "a1": {"copilot_chat.parent_chat_session_id": "p", "gen_ai.agent.name": "helper"},
        "a2": {"gen_ai.agent.name": "root"},
        "zz": {"gen_ai.tool.name": "bash"},
    }
    rows = [(s, k, v, 1) for s, own in attributes.items() for k, v in own.items()] + [("c1", "gen_ai.usage.output_tokens", "99", 0), ("c1", "unread", None, 0)]
    got = {r.dedup_key: r for r in stores.span_calls(spans, spark.createDataFrame(rows, "span_id string, key string, value string, row int")).collect()}
    assert set(got) == {"copilot-otel:c1", "copilot-otel:c2", "copilot-otel:c4"}
    c1, c2, c4 = (got[f"copilot-otel:c{i}"] for i in (1, 2, 4))
    assert (c1.input_tokens, c1.output_tokens, c1.cache_read_tokens, c1.cache_write_tokens, c1.model, c1.session_id) == (12, 3, 0, 7, "m-1", "conv")
    assert c1.tools == ["Agent", "Read", "Bash"] and c1.commands == ["git add .", "git push"] and c1.project == "app" and c1.superseded == ["copilot:conv:turn9"]
    assert (c2.model, c2.session_id, c2.project, c2.superseded, c2.tools) == ("gpt-x", "t2", "copilot-chat", [], []) and c2.timestamp.year == 2023
    assert (c4.model, c4.project, c4.tools) == ("copilot-auto", "app", [])


JOURNAL = [
    {"kind": 1, "k": ["lost"], "v": 1}, {"kind": 0, "v": {"sessionId": "s1", "creationDate": 1_700_000_000_000, "requests": [{"requestId": "r0", "response": ["dropped"], "modelId": "copilot/gpt-5"}]}}, "not json", {"kind": 9, "v": 1}, {"kind": 1, "k": ["x"]}, {"kind": True, "v": 2},
    {"kind": 2, "v": [{"requestId": "r1", "message": {"text": "hi"}, "timestamp": "2026-01-01T00:00:00Z"}, 7]}, {"kind": 2, "k": ["requests"], "v": {"requestId": "r1", "completionTokens": 4}}, {"kind": 2, "k": [None], "v": {"completionTokens": 6, "modelId": "auto", "timestamp": 1_700_000_100}},
    {"kind": 1, "k": ["requests", 0, "result"], "v": {"metadata": {"promptTokens": 10, "outputTokens": 0, "toolCallRounds": [{"toolName": "", "name": "read_file", "toolCalls": [{"tool": "bash"}, {"name": 5}]}, {"tools": [{"name": "custom"}]}]}}}, {"kind": 1, "k": ["requests", "0", "completionTokens"], "v": 8},
    {"kind": 1, "k": ["requests", 1, "result", "metadata"], "v": {"promptTokens": 99}}, {"kind": 1, "k": ["requests", 1, "result"], "v": {"metadata": {}}}, {"kind": 1, "k": ["requests", 1, "result", "metadata", "outputTokens"], "v": 3}, {"kind": 1, "k": ["requests", 1, "result", "metadata", "resolvedModel"], "v": "m-2"},
    {"kind": 1, "k": ["requests", 50, "result"], "v": {}}, {"kind": 2, "k": ["requests", 0, "response"], "v": ["big"]}, {"kind": 2, "k": ["new", "list"], "v": 1}, {"kind": 1, "k": ["requests", 3, "result"], "v": {"metadata": {"promptTokens": "12"}}},
]


def plain_fold(lines):
    """The whole document, folded without leaving anything out."""
    doc = [None]
    for x in lines:
        if not isinstance(x, dict) or x.get("kind") is True or "v" not in x:
            continue
        x = json.loads(json.dumps(x))
        if x["kind"] == 0:
            doc[0] = x["v"]
            continue
        path = x.get("k")
        path = [str(s) for s in path] if isinstance(path, list) and None not in path else ["requests"] if x["kind"] == 2 else None
        if path is None or x["kind"] not in (1, 2):
            continue
        parent, key = doc, 0
        for s in path[:-1] if x["kind"] == 1 else path:
            if parent[key] is None:
                parent[key] = {}
            here = parent[key]
            if isinstance(here, dict):
                here.setdefault(s, None)
                parent, key = here, s
            elif isinstance(here, list) and s.isdigit() and int(s) < len(here):
                parent, key = here, int(s)
            else:
                parent = None
                break
        if parent is None:
            continue
        if x["kind"] == 1 and isinstance(parent[key], dict):
            parent[key][path[-1]] = x["v"]
        if x["kind"] == 2:
            if parent[key] is None:
                parent[key] = []
            if isinstance(parent[key], list):
                parent[key] += x["v"] if isinstance(x["v"], list) else [x["v"]]
    return doc[0]


def test_the_lean_fold_equals_the_whole_one():
    for end in range(len(JOURNAL) + 1):
        root = [None]
        for x in JOURNAL[:end]:
            stores.fold_journal(root, x if isinstance(x, str) else json.dumps(x))
        whole = plain_fold(JOURNAL[:end])
        if isinstance(whole, dict) and "requests" in whole:
            whole["requests"] = [{k: v for k, v in r.items() if k != "response"} if isinstance(r, dict) else r for r in whole["requests"]]
        assert root[0] == whole, end


def test_journals(spark):
    rows = [(p, i, x if isinstance(x, str) else json.dumps(x)) for p in ("/a/one.json", "/b/two.json") for i, x in enumerate(JOURNAL)]
    rows += [("/c/three.json", 0, json.dumps({"kind": 2, "v": {"completionTokens": 1}})), ("/d/four.json", 0, "junk")]
    calls = {r.dedup_key: r for r in stores.journal_calls(spark.createDataFrame(rows, "path string, line long, value string").repartition(7)).collect()}
    assert set(calls) == {"copilot-chatsession:s1:r0", "copilot-chatsession:s1:r1", "copilot-chatsession:s1:request-4", "copilot-chatsession:three:request-0"}
    r0, r1, r4 = (calls[f"copilot-chatsession:s1:{k}"] for k in ("r0", "r1", "request-4"))
    assert (r0.input_tokens, r0.output_tokens, r0.model, r0.tools, r0.timestamp.year) == (10, 8, "gpt-5", ["Read", "Bash", "5", "custom"], 2023)
    assert (r1.input_tokens, r1.output_tokens, r1.model, r1.user_message, r1.timestamp.isoformat()) == (0, 3, "m-2", "hi", "2026-01-01T00:00:00")
    assert (r4.output_tokens, r4.model, r4.timestamp.year) == (6, "copilot-auto", 2023)


@pytest.fixture(scope="module")
def store(spark):
    turns = spark.createDataFrame([("s1", 0, "héllo", "answer", "2026-01-01 10:00:00"), ("s1", 1, "two", None, "2026-01-01T10:00:00+02:00"), ("s1", 2, " ", None, None), ("s2", 0, None, "x" * 9, "junk"), ("s3", 0, "p", "q", None)], "session_id string, turn_index long, user_message string, assistant_response string, timestamp string")
    sessions = spark.createDataFrame([("s1", " /w/app ", "o/r"), ("s2", "/", "o/r"), ("s4", "null", " ")], "id string, cwd string, repository string")
    events = spark.createDataFrame([(1, "s1", 0, "m", 100, 5, 120, 2, None, "2026-01-01 09:00:00"), (2, "s1", 0, " ", 10, -5, 4, 0, 1, None), (3, "s4", None, None, 7, 1, 0, 0, 0, None)], "id long, session_id string, turn_index long, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, reasoning_tokens long, created_at string")
    return turns, sessions, events


def test_turn_store(spark, store):
    calls = {r.dedup_key: r for r in stores.store_calls(*store).collect()}
    assert set(calls) == {"copilot:s1:turn-0:usage-1", "copilot:s1:turn-0:usage-2", "copilot:s4:usage-3", "copilot:s1:turn-1", "copilot:s2:turn-0", "copilot:s3:turn-0"}
    one, two, three = calls["copilot:s1:turn-0:usage-1"], calls["copilot:s1:turn-0:usage-2"], calls["copilot:s4:usage-3"]
    assert (one.input_tokens, one.cache_read_tokens, one.cache_write_tokens, one.output_tokens, one.model, one.user_message, one.transcript_assistant, one.project) == (0, 100, 2, 5, "m", "héllo", "answer", "/w/app")
    assert (two.input_tokens, two.cache_read_tokens, two.output_tokens, two.model, two.user_message, two.transcript_user) == (6, 4, 0, "copilot-auto", "", None)
    assert (three.project, three.superseded) == ("copilot-cli", ["copilot:cli:s4"]) and one.superseded == ["copilot:cli:s1", "copilot:s1:turn-0"]
    assert (calls["copilot:s1:turn-1"].input_tokens, calls["copilot:s1:turn-1"].timestamp.hour) == (1, 8)
    assert (calls["copilot:s2:turn-0"].output_tokens, calls["copilot:s2:turn-0"].project, calls["copilot:s2:turn-0"].timestamp) == (3, "o/r", None)


def test_totals_and_what_is_superseded(spark, store):
    kinds = "id string, model string, total_input_tokens long, total_output_tokens long, total_cached_tokens long, total_reasoning_tokens long, created_at string, updated_at string"
    totals = spark.createDataFrame([("s1", "m", 100, 5, 50, 0, None, None), ("s2", " ", 100, 5, 150, -2, "2026-01-01 09:00:00", "junk"), ("s3", "m", -5, 0, 3, 0, None, None)], kinds)
    got = [(r.dedup_key, r.model, r.input_tokens, r.cache_read_tokens, r.reasoning_tokens, r.timestamp.hour) for r in stores.total_calls(totals, store[2]).collect()]
    assert got == [("copilot:cli:s2", "copilot-auto", 0, 100, 0, 9)]
    kept = spark.createDataFrame([("copilot", "copilot:cli:s1", 9, 1.0), ("copilot", "copilot:s1:turn-0", 8, 2.0), ("copilot", "copilot:s1:turn-1", 7, 3.0), ("codex", "copilot:cli:s1", 6, 4.0)], "tool string, dedup_key string, input_tokens long, cost double")
    zeroed = archive.zero_superseded(kept, stores.superseded_keys(stores.store_calls(*store)))
    assert {(r.tool, r.dedup_key): (r.input_tokens, r.cost) for r in zeroed.collect()} == {("copilot", "copilot:cli:s1"): (0, 0.0), ("copilot", "copilot:s1:turn-0"): (0, 0.0), ("copilot", "copilot:s1:turn-1"): (7, 3.0), ("codex", "copilot:cli:s1"): (6, 4.0)}


def test_no_rows(spark, store):
    empty = [t.limit(0) for t in store]
    assert stores.store_calls(*empty).count() == 0
    assert stores.span_calls(spark.createDataFrame([], SPANS), spark.createDataFrame([], "span_id string, key string, value string")).count() == 0
    assert stores.journal_calls(spark.createDataFrame([], "path string, line long, value string")).agg(F.count("*")).first()[0] == 0
