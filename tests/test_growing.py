"""The growing archive and followed files against one full parse."""

import json
import os

from pyspark.sql import functions as F

from loomline.operators import growing
from loomline.sources import session_logs as logs
from loomline.streaming import tail

SHOWN = ("dedup_key", "model", "input_tokens", "output_tokens", "tools", "commands", "edited_files", "code_blocks", "is_canceled", "prompt_chars", "response_chars", "elapsed_ms", "user_message", "project", "session_id")
KINDS = "seq long, tool string, dedup_key string, timestamp timestamp_ntz, timestamp_quality string, cost double, input_tokens long"


def line(**x):
    return json.dumps(x) + "\n"


def user(at, text, cwd=None):
    return line(type="user", timestamp=f"2026-01-01T10:{at}Z", message={"role": "user", "content": text}, **({"cwd": cwd} if cwd else {}))


def reply(at, key, *content, **usage):
    blocks = [{"type": "text", "text": c} if isinstance(c, str) else {"type": "tool_use", "name": c[0], "input": c[1]} for c in content]
    return line(type="assistant", timestamp=f"2026-01-01T10:{at}Z", sessionId="s", message={"id": key, "role": "assistant", "model": "claude-opus-4", "content": blocks, "usage": {"input_tokens": 5, **usage}})


def shown(df):
    return {r.dedup_key: tuple(r) for r in df.select(*SHOWN).collect()}


def versions(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(f"{path}/rows") for f in names if f.endswith(".parquet"))


def test_followed_files_equal_a_full_parse(spark, tmp_path):
    files, out = tmp_path / "files", str(tmp_path / "out")
    files.mkdir()
    a, b = files / "a.jsonl", files / "b.jsonl"

    def follow():
        query = tail.follow_claude(tail.tail_lines(spark, str(files)), out, str(tmp_path / "checkpoint"), buckets=4)
        assert query.awaitTermination(180) and query.exception() is None
        return shown(growing.read(spark, f"{out}/calls"))

    full = lambda: shown(logs.claude_calls(logs.read_lines(spark, str(files))))
    a.write_text(user("00:00", "[note] please fix", "/w/app") + reply("00:05", "m1", "ok") + reply("00:09", "m2", ("Bash", {"command": "git add ."}))[:40])
    b.write_text(user("00:00", "other") + reply("00:01", "n1", "fine"))
    assert set(follow()) == {"m1", "n1"}
    # the open line ends, its message goes on, a prompt of the batch before still counts, and an interruption cancels the last call
    whole = reply("00:09", "m2", ("Bash", {"command": "git add ."}))
    with a.open("a") as f:
        f.write(whole[40:] + reply("00:10", "m2", ("Edit", {"file_path": "/w/x.py"}), "é done"))
    assert follow() == full()
    with a.open("a") as f:
        f.write("not json\n" + user("00:20", "[Request interrupted by user]") + user("01:00", "again") + reply("01:02", "m3", "yes", output_tokens=3))
    with b.open("a") as f:
        f.write(reply("00:30", "n1", ("Read", {"file_path": "/w/y"}), "more"))
    got = follow()
    assert got == full() and got["m2"][SHOWN.index("is_canceled")] and got["n1"][SHOWN.index("tools")] == ["Read"]
    before = versions(f"{out}/calls")
    assert follow() == got and versions(f"{out}/calls") == before
    # a rewritten file and a shorter one are read anew; what is gone from them stays in the archive
    a.write_text(user("05:00", "rewritten " * 80) + reply("05:01", "m4", "new") + reply("05:02", "m5", ("Bash", {"command": "ls"})))
    b.write_text(user("00:00", "other") + reply("00:01", "n1", "fine"))
    got, now = follow(), full()
    assert {k: got[k] for k in ("m4", "m5")} == {k: now[k] for k in ("m4", "m5")} and set(got) == {"m1", "m2", "m3", "m4", "m5", "n1"}


def test_parts_of_a_file_hold_each_line_once(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "PART_BYTES", 37)
    monkeypatch.setattr(tail, "BLOCK", 8)
    monkeypatch.setattr(tail, "ROWS", 3)
    lines = ["x" * (i * 7 % 90) + f"é{i}" for i in range(60)]
    (tmp_path / "a.jsonl").write_bytes("\r\n".join(lines).encode() + b"\nopen")
    reader = tail._Tail(str(tmp_path), "*.jsonl")
    found = [r for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for batch in reader.read(p) for r in batch.to_pylist()]
    assert [r["value"] for r in sorted(found, key=lambda r: r["line"])] == lines
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []


def test_bytes_written_follow_the_batch(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = lambda keys, cost: spark.createDataFrame([(i, "codex", f"k{k}", None, "exact", cost, 1) for i, k in enumerate(keys)], KINDS)
    first = growing.upsert(spark, path, rows(range(2_000), 1.0), 0, buckets=32)
    assert first == {"incoming": 2_000, "added": 2_000, "buckets_written": 32, "rows_written": 2_000}
    again = growing.upsert(spark, path, rows(range(2_000), 9.0), 1)
    assert again == {"incoming": 2_000, "added": 0, "buckets_written": 0, "rows_written": 0}
    before = set(versions(path))
    one = growing.upsert(spark, path, rows([5, 9_999], 7.0), 2)
    assert one["added"] == 1 and one["buckets_written"] == 1 and one["rows_written"] < 150
    after = set(versions(path))
    assert before < after and growing.upsert(spark, path, rows([5, 9_999, 10_000], 7.0), 2)["rows_written"] == 0 and set(versions(path)) == after
    assert growing.read(spark, path).agg(F.count("*"), F.sum("cost")).first()[:] == (2_001, 2_007.0)
    assert growing.vacuum(spark, path) == 1 and growing.read(spark, path).count() == 2_001 and growing.vacuum(spark, path) == 0


def test_sync_skips_known_sources_and_keeps_missing_ones(spark, tmp_path):
    files, out = tmp_path / "files", str(tmp_path / "out")
    files.mkdir()
    for name in "ab":
        (files / f"{name}.jsonl").write_text(user("00:00", name) + reply("00:01", f"{name}1", "x"))
    run = lambda: growing.sync(spark, str(files), out, logs.claude_calls, logs.read_lines, buckets=4)
    assert run() == {"sources_seen": 2, "sources_parsed": 2, "calls_inserted": 2}
    assert run() == {"sources_seen": 2, "sources_parsed": 0, "calls_inserted": 0}
    (files / "a.jsonl").unlink()
    with (files / "b.jsonl").open("a") as f:
        f.write(reply("00:02", "b2", "y"))
    assert run() == {"sources_seen": 1, "sources_parsed": 1, "calls_inserted": 1}
    assert set(shown(growing.read(spark, f"{out}/calls"))) == {"a1", "b1", "b2"}
    growing.reset(spark, out)
    assert growing.read(spark, f"{out}/calls") is None and run()["calls_inserted"] == 2


def test_repair_raises_only_rows_under_the_floor_and_only_once(spark, tmp_path):
    path = str(tmp_path / "archive")
    kinds = KINDS + ", output_tokens long, cache_write_tokens long, cache_read_tokens long, web_search_requests long, model string, speed string"
    charged = 1000 * 3e-6 + 10 * 15e-6 + 100 * 3.75e-6 + 50 * 3e-7
    rows = [
        (0, "claude-code", "a", None, "exact", charged + 0.02, 1000, 10, 100, 50, 2, "vendor/claude-opus-5-20260401", "standard"), (1, "claude-code", "b", None, "exact", charged * 5 / 3, 1000, 10, 100, 50, 0, "claude-opus-5", "standard"),
        (2, "cursor", "c", None, "exact", charged, 1000, 10, 100, 50, 0, "claude-opus-5-fast", "standard"), (3, "claude-code", "d", None, "exact", charged, 1000, 10, 100, 50, 0, "claude-opus-5", "fast"),
    ]
    growing.upsert(spark, path, spark.createDataFrame(rows, kinds), 0, buckets=4)
    done = growing.repair(spark, path, 1)
    got = {r.dedup_key: round(r.cost, 9) for r in growing.read(spark, path).collect()}
    assert got == {k: round(v, 9) for k, v in {"a": charged * 5 / 3 + 0.02, "b": charged * 5 / 3, "c": charged, "d": charged * 10 / 3}.items()}
    assert done["incoming"] == 2 and growing.repair(spark, path, 2)["rows_written"] == 0
