"""Cursor's conversations on small hand-made tables, each branch once."""

import dataclasses
from datetime import datetime

import pytest

from loomline.sources import cursor_state as cursor

AT = datetime(2026, 1, 1, 10)


def rows(spark, schema, *given):
    """Rows by name; what isn't named is null."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in given], schema)


def bubble(composer, id, type, minute=None, **more):
    return {"composer_id": composer, "key": f"bubbleId:{composer}:{id}", "id": id, "type": type, "created_raw": str(minute or ""), "created_at": AT.replace(minute=minute) if minute is not None else None, **more}


@pytest.fixture(scope="module")
def calls(spark):
    s = cursor.empty(spark)
    s = dataclasses.replace(
        s,
        composers=rows(
            spark, cursor.COMPOSERS,
            {"id": "c1", "headers": ["u1", "a1", "a1b", "u2", "a2"], "model": "gpt-5-fast", "unified_mode": "Chat", "status": "aborted", "created_at": AT, "meter_used": "99"},
            {"id": "c2", "headers": [], "meter_used": "0", "meter_context": " 1234.9 ", "created_at": AT.replace(hour=8), "force_mode": "edit"}, {"id": "c4", "meter_used": "nan"}, {"id": "c5", "meter_used": "7"},
        ),
        bubbles=rows(
            spark, cursor.BUBBLES,
            # c1 out of order in time: the header decides; one message before any user's, one of an unknown type
            bubble("c1", "u2", 1, 1, text="second", request_id="r2"), bubble("c1", "a2", 2, 0, text="later", output_tokens=4, input_tokens=-3), bubble("c1", "a1", 2, 5, text="one", tool_name="read_file", tool_files=["/w/a", ""], attached_files=["/w/b"], duration_ms=77, request_id="r1"),
            bubble("c1", "a1b", 0, 7, text="two", tool_name="Terminal", tool_commands=["ls"], unified_mode="background agent", model="m-b"), bubble("c1", "u1", 1, 3, text="x <user_query> do it </user_query> y", attached_files=["/w/c", "/w/b"], legacy_conversation_id="old", input_tokens=10),
            bubble("c1", "zz", 9, 8, text="unread"),
            # c2 has no header: time, then key; a message before the first prompt is in no turn
            bubble("c2", "b0", 2, 0, text="lost"), bubble("c2", "b2", 2, 2, text="12345", tool_name="edit_file", tool_status="cancelled", tool_files=["/w/no"]), bubble("c2", "b1", 1, 1, text="Workspace Path: /home/me/app\nhello"), bubble("c2", "b4", 2, 4, tool_name="write", tool_files=["/w/yes"]), bubble("c2", "b3", 1, 3, text="next"),
            # c3 has no composer
            bubble("c3", "p", 1, text="no times"), bubble("c4", "q", 1, 1), bubble("c5", "only", 2, 1, text="no user"), bubble("", "none", 1, 1),
        ),
        agent_turns=rows(spark, cursor.AGENT_TURNS, {"request_id": "r2", "model": "agent-model", "user_message": "agent says", "tools": ["Grep"], "elapsed_ms": 5}),
        contexts=rows(spark, cursor.CONTEXTS, {"composer_id": "c1", "bubble_id": "u2", "referenced_files": ["/ctx"], "edited_files": ["/ed"]}),
        store_turns=rows(
            spark, cursor.TURNS,
            {"composer_id": "c1", "place": 5, "request_id": "r1", "user_message": "from the store", "reasoning_text": "why", "commands": ["pwd"]}, {"composer_id": "c1", "place": 0, "request_id": "other", "user_message": "beside"},
            {"composer_id": "c2", "place": 1, "response_text": "by place"},
        ),
        transcript_turns=rows(spark, cursor.TURNS, {"composer_id": "c3", "place": 0, "response_text": "told", "edited_files": ["/t"], "elapsed_ms": 9}),
        tracking=rows(spark, cursor.SESSIONS, {"composer_id": "c2", "model": "tracked", "edited_files": ["/never"], "project": "/tracked"}, {"composer_id": "c4", "mode": "plan", "edited_files": ["/last"], "project": "/tracked"}),
        store_sessions=rows(spark, cursor.SESSIONS, {"composer_id": "c4", "model": "stored", "project": "/stored"}),
        transcripts=rows(spark, cursor.SESSIONS, {"composer_id": "c3", "project": "/told", "paths": ["/f1", "/f2"]}),
        workspaces=rows(spark, cursor.SESSIONS, {"composer_id": "c1", "project": "/workspace"}),
    )
    return {r.dedup_key: r for r in cursor.cursor_calls(s).collect()}


def test_turns_open_with_a_user_s_message_in_header_order(calls):
    assert set(calls) == {"cursor:composer:c1:r1", "cursor:composer:c1:r2", "cursor:composer:c2:b1", "cursor:composer:c2:b3", "cursor:composer:c3:p", "cursor:composer:c4:q", "cursor:composer-input:c2"}


def test_first_turn(calls):
    r = calls["cursor:composer:c1:r1"]
    assert (r.user_message, r.transcript_assistant, r.prompt_chars, r.response_chars) == ("from the store", "one\ntwo", 14, 10)
    assert r.tools == ["Read", "Bash"] and r.commands == ["ls", "pwd"] and r.referenced_files == ["/w/c", "/w/b", "/w/a"] and r.edited_files == []
    # the user's own input counts, the output is guessed; the meter gives way to it
    assert (r.input_tokens, r.output_tokens, r.token_quality, r.elapsed_ms) == (10, 3, "mixed", 77)
    assert (r.model, r.speed, r.interaction_mode, r.project, r.is_canceled) == ("m-b", "standard", "agent", "/workspace", False)
    # no message without a tool has text: the last one's time counts
    assert r.timestamp.minute == 7 and r.superseded == ["cursor:old:3:10:0", "cursor:unknown:5:0:0", "cursor:unknown:7:0:0", "cursor:agentKv:r1"]


def test_second_turn(calls):
    r = calls["cursor:composer:c1:r2"]
    assert (r.user_message, r.model, r.tools, r.referenced_files, r.edited_files) == ("second", "agent-model", ["Grep"], ["/ctx"], ["/ed"])
    assert (r.input_tokens, r.output_tokens, r.token_quality, r.interaction_mode, r.is_canceled) == (2, 4, "mixed", "chat", True)
    assert r.elapsed_ms == 5 and r.timestamp.minute == 0  # its time is before the prompt's, so the agent's figure counts


def test_metered_conversation(calls):
    first, second, credit = calls["cursor:composer:c2:b1"], calls["cursor:composer:c2:b3"], calls["cursor:composer-input:c2"]
    assert (first.input_tokens, first.output_tokens, first.token_quality, first.project, first.edited_files, first.tools) == (0, 2, "estimated", "/home/me/app", [], [])
    assert (second.transcript_assistant, second.edited_files, second.tools, second.project, second.elapsed_ms) == ("by place", ["/w/yes"], ["Write"], "/tracked", 60_000)
    assert (credit.input_tokens, credit.output_tokens, credit.model, credit.project, credit.timestamp.hour, credit.timestamp_quality, credit.token_quality, credit.interaction_mode) == (1234, 0, "tracked", "/home/me/app", 8, "session", "estimated", "agent")


def test_turns_without_composer_times_or_texts(calls):
    told, bare = calls["cursor:composer:c3:p"], calls["cursor:composer:c4:q"]
    assert (told.transcript_assistant, told.edited_files, told.elapsed_ms, told.timestamp, told.timestamp_quality, told.project, told.model, told.interaction_mode) == ("told", ["/t"], 9, None, "unknown", "/told", "cursor-auto", "unknown")
    assert told.superseded == ["cursor:unknown::0:0", "cursor:transcript:/f1:c3:0", "cursor:transcript:/f2:c3:0"]
    assert (bare.input_tokens, bare.output_tokens, bare.token_quality, bare.edited_files, bare.model, bare.project, bare.interaction_mode) == (0, 0, "unknown", ["/last"], "stored", "/tracked", "plan")


def test_longest_version_and_no_rows(spark):
    files = spark.createDataFrame([("a", "/2", 3, "/p2"), ("a", "/1", 3, None), ("a", "/3", 9, "/p3"), ("b", "/4", 0, None), ("c", "/6", 1, None), ("c", "/5", 1, None)], "conversation_id string, path string, n_turns int, project string")
    assert {(r.conversation_id, r.path, r.project, tuple(r.paths)) for r in cursor.longest_versions(files).collect()} == {("a", "/3", "/p2", ("/1", "/2", "/3")), ("c", "/5", None, ("/5", "/6"))}
    assert cursor.cursor_calls(cursor.empty(spark)).count() == 0
