"""Readers of session files on small hand-made files."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.functions.texts import split_commands
from loomline.sources import session_logs as logs


def save(folder, name, lines):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def assistant(at, key, content, model="claude-opus-4", **usage):
    return {"type": "assistant", "timestamp": at, "sessionId": "s1", "cwd": "/w/app", "message": {"id": key, "role": "assistant", "model": model, "content": content, "usage": usage}}


def user(at, content):
    return {"type": "user", "timestamp": at, "message": {"role": "user", "content": content}}


def test_claude_lines(spark, tmp_path):
    use = {"type": "tool_use", "name": "Bash", "input": {"command": "git add . && git commit -m 'a; b' | cat"}}
    save(tmp_path, "p/s1.jsonl", [
        user("2026-01-01T10:00:00Z", "please fix it"), "not json",
        user("2026-01-01T10:00:01Z", "<command-name>x</command-name>"),
        assistant("2026-01-01T10:00:05Z", "m1", [{"type": "text", "text": "ok"}], input_tokens=10, output_tokens=2, cache_creation_input_tokens=3, cache_creation={"ephemeral_5m_input_tokens": 1, "ephemeral_1h_input_tokens": 4}),
        assistant("2026-01-01T10:00:06Z", "m1", [use, {"type": "tool_use", "name": "Edit", "input": {"file_path": "/w/a.py", "new_string": "x"}}], input_tokens=99),
        user("2026-01-01T10:00:09Z", [{"type": "text", "text": "[Request interrupted by user]"}]),
        assistant("2026-01-01T13:00:00Z", "m2", "plain", output_tokens=1),
        {"type": "assistant", "message": {"id": "m3", "content": "no usage"}},
    ])
    got = {r.dedup_key: r for r in logs.claude_calls(logs.read_lines(spark, str(tmp_path))).collect()}
    assert set(got) == {"m1", "m2"}
    m1, m2 = got["m1"], got["m2"]
    assert (m1.input_tokens, m1.output_tokens, m1.cache_write_tokens, m1.cache_write_1h_tokens) == (10, 2, 5, 4)
    assert m1.tools == ["Bash", "Edit"] and m1.commands == ["git add .", "git commit -m 'a; b'", "cat"] and m1.edited_files == ["/w/a.py"]
    assert m1.is_canceled and not m2.is_canceled and m1.user_message == "please fix it" and m1.elapsed_ms == 5000 and m2.elapsed_ms is None
    assert m1.transcript_assistant == "ok" and m1.response_chars == 2 and m2.transcript_assistant == "plain" and m1.project == "/w/app"


def count(at, total=None, last=None, **more):
    return {"type": "event_msg", "timestamp": at, "payload": {"type": "token_count", "info": {"total_token_usage": total, "last_token_usage": last}, **more}}


def tokens(i, c, o, r):
    return {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": r, "total_tokens": i + o}


def test_codex_lines(spark, tmp_path):
    meta = {"type": "session_meta", "timestamp": "2026-01-01T10:00:00Z", "payload": {"id": "A", "cwd": "/w", "originator": "codex_cli"}}
    call = {"type": "response_item", "payload": {"type": "function_call", "name": "exec_command", "arguments": json.dumps({"cmd": "ls; pwd"})}}
    body = [
        {"type": "turn_context", "payload": {"model": "gpt-5-mini"}}, {"type": "event_msg", "timestamp": "2026-01-01T10:00:10Z", "payload": {"type": "user_message", "message": " go "}}, call,
        {"type": "event_msg", "payload": {"type": "agent_message", "message": "done"}}, {"type": "event_msg", "payload": {"type": "patch_apply_end", "success": True, "changes": {"/w/x.py": {}}}},
        count("2026-01-01T10:00:12Z", tokens(100, 40, 10, 5)), count("2026-01-01T10:00:13Z", tokens(100, 40, 10, 5)),
        {"type": "event_msg", "payload": {"type": "turn_aborted"}}, count("2026-01-01T10:01:12Z", tokens(150, 40, 30, 5)),
    ]
    fork = {"type": "session_meta", "timestamp": "2026-01-01T11:00:00Z", "payload": {"id": "B", "forked_from_id": "A", "cwd": "/w", "originator": "codex_cli"}}
    save(tmp_path, "a.jsonl", [meta, *body])
    save(tmp_path, "b.jsonl", [fork, *[json.loads(json.dumps(x).replace("T10:0", "T11:0").replace(":12Z", ":01Z").replace(":13Z", ":01Z")) for x in body[:7]], count("2026-01-01T11:30:00Z", tokens(120, 40, 11, 5))])
    save(tmp_path, "c.jsonl", [{"type": "session_meta", "payload": {"originator": "other"}}, *body])
    rows = logs.codex_calls(logs.read_lines(spark, str(tmp_path))).orderBy("session_id", "line").collect()
    assert [(r.session_id, r.input_tokens, r.cache_read_tokens, r.output_tokens) for r in rows] == [("a", 60, 40, 15), ("a", 50, 0, 20), ("b", 20, 0, 1)]
    assert rows[0].commands == ["ls", "pwd"] and rows[0].tools == ["Bash"] and rows[0].edited_files == ["/w/x.py"] and rows[0].is_canceled and not rows[1].is_canceled
    assert rows[0].dedup_key == "codex:A:100:40:10:5:110" and rows[0].model == "gpt-5-mini" and rows[0].user_message == "go" and rows[0].elapsed_ms == 2000 and rows[1].tools == []


def test_codex_limits(spark, tmp_path):
    limits = {"limit_id": "codex", "primary": {"used_percent": 17.0, "window_minutes": 300, "resets_at": 1777477636}, "secondary": None, "credits": {"has_credits": False, "unlimited": False, "balance": "2.5"}, "plan_type": "plus"}
    save(tmp_path, "a.jsonl", [count("2026-01-01T10:00:12Z", rate_limits=limits), count("2026-01-01T10:00:13Z", rate_limits={"limit_id": ""})])
    [r] = logs.codex_limits(logs.read_lines(spark, str(tmp_path))).collect()
    assert (r.limit_id, r.primary.used_percent, r.primary.window_minutes, r.secondary, r.credits.balance, r.plan_type) == ("codex", 17.0, 300, None, 2.5, "plus")


@pytest.mark.parametrize("whole", [True, False])
def test_gemini_files(spark, tmp_path, whole):
    messages = [
        {"id": "1", "type": "user", "timestamp": "2026-01-01T10:00:00Z", "content": [{"text": "hi"}, {"text": "you"}]},
        {"id": "2", "type": "gemini", "timestamp": "2026-01-01T10:00:03Z", "content": "yo", "model": "gemini-2.5", "tokens": {"input": 50, "output": 5, "cached": 20, "thoughts": 3, "tool": 1, "total": 90}, "toolCalls": [{"name": "run_command", "args": {"command": "make && ls"}}, {"name": "my_tool", "displayName": "Mine"}]},
        {"id": "3", "type": "gemini", "content": "none", "model": "gemini-2.5", "tokens": {"input": 0}},
    ]
    head = {"sessionId": "S", "startTime": "2026-01-01T09:00:00Z"}
    text = json.dumps(head | {"messages": messages}, indent=1) if whole else "\n".join(map(json.dumps, [head, {"$set": {"x": 1}}, *messages]))
    files = spark.createDataFrame([("f.json", text), ("g.json", ""), ("h.json", None)], "path string, value string")
    [r] = logs.gemini_calls(files).collect()
    assert (r.input_tokens, r.cache_read_tokens, r.output_tokens, r.dedup_key) == (30, 20, 6 + 11 + 3, "gemini:S:2")
    assert r.tools == ["Bash", "Mine"] and r.commands == ["make", "ls"] and r.user_message == "hi you" and r.elapsed_ms == 3000


def test_copilot_events(spark, tmp_path):
    reply = lambda key: {"type": "assistant.message", "timestamp": "2026-01-01T10:00:03Z", "data": {"messageId": key, "outputTokens": 7, "toolRequests": [{"name": "bash"}]}}
    save(tmp_path, "sess/events.jsonl", [reply("early"), {"type": "session.model_change", "data": {"newModel": "gpt-5"}}, {"type": "user.message", "data": {"content": "q"}}, reply("a"), reply("b"), {"type": "session.shutdown", "data": {"sessionStartTime": 1767261600000, "modelMetrics": {"gpt-5": {"usage": {"inputTokens": 100, "cacheReadTokens": 30, "cacheWriteTokens": 10}}, "x": {"usage": {}}}}}])
    rows = logs.copilot_event_calls(logs.read_lines(spark, str(tmp_path))).orderBy("line").collect()
    assert [(r.dedup_key, r.output_tokens, r.input_tokens, r.user_message) for r in rows] == [("copilot:sess:a", 7, 0, "q"), ("copilot:sess:b", 7, 0, None), ("copilot:sess:shutdown:gpt-5", 0, 60, None)]
    every = logs.all_calls(logs.copilot_event_calls(logs.read_lines(spark, str(tmp_path))), logs.copilot_event_calls(logs.read_lines(spark, str(tmp_path))))
    assert every.count() == 3


def test_commands_split_outside_quotes(spark):
    cases = {"a && b || c; d | e": ["a", "b", "c", "d", "e"], "echo 'x && y' & z": ["echo 'x && y' & z"], 'echo "a;\\"b" ; c': ['echo "a;\\"b"', "c"], "a \\; b": ["a \\; b"], "": [], "echo 'open; end": ["echo 'open; end"]}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", split_commands(F.col("c")).alias("s")).collect()
    assert {r.c: r.s for r in got} == cases
