"""Scripts, diffs and the code blocks of readers."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.functions import scripts
from loomline.sources import session_logs as logs


@pytest.mark.parametrize(
    ("script", "expected"),
    [
        ("await Promise.all([tools.exec_command({cmd:\"cargo fmt --check && cargo test\"}), tools.mcp__m__search({query:'x', cmd: 'y'})]);", [("exec_command", "cargo fmt --check && cargo test"), ("mcp__m__search", "y")]),
        ("const e = \"tools.exec_command({cmd: 'no'})\";\n// tools.no({});\n/* tools.no() */ await tools.apply_patch(\"*** Begin Patch\");", [("apply_patch", None)]),
        ("tools.a(tools.b({cmd:`in \\` \\n side`}), {cmd: 'out'})", [("a", "in ` \n side"), ("b", "in ` \n side")]),
        ("tools.open({cmd: 'x'}", []),
        ("mytools.a() tools.b tools.c (1) x.tools.d()", [("c", None), ("d", None)]),
        ("tools.a({scmd: 'no', cmd2: 'no', 'cmd': 'no', cmd : 5})", [("a", None)]),
        ("tools.a({cmd: \"bad \\x\"}) tools.b({text: 'it\\'s ) here', cmd: 'ok'})", [("a", None), ("b", "ok")]),
        (") tools.a() 'open string tools.b()", [("a", None)]),
        ("", []),
    ],
)
def test_nested_calls(script, expected):
    assert scripts.nested_calls(script) == expected


def test_scanning_is_linear():
    for piece in ("tools.a(", "'x", "/* ", "cmd: ", "(((", "\\"):
        scripts.nested_calls(piece * 20_000)


def test_added_lines(spark):
    diffs = ["--- a\n+++ b\n@@ -1 +1,2 @@\n-x\n+y\n+\n z\n++++w", "", None, "+a"]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(diffs)], "i int, d string")
    assert [r.n for r in rows.select("i", scripts.added_lines(F.col("d")).alias("n")).orderBy("i").collect()] == [2, 0, 0, 1]


def code(r):
    return [(b.language, b.loc) for b in r.code_blocks]


def test_code_of_claude_and_codex(spark, tmp_path):
    use = lambda name, **given: {"type": "tool_use", "name": name, "input": given}
    content = [{"type": "text", "text": "see\n```py\na = 1\nb = 2\n```"}, use("Write", file_path="/w/x.rs", content="1\n2\n"), use("Edit", file_path="/w/y", new_string=""), use("MultiEdit", file_path="/w/z.py", edits=[{"new_string": "q"}, {"new_string": ""}, {}]), use("NotebookEdit", notebook_path="/w/n.ipynb", new_source="c")]
    lines = [{"type": "assistant", "timestamp": "2026-01-01T10:00:00Z", "message": {"id": "m1", "model": "m", "content": content, "usage": {"input_tokens": 1}}}, {"type": "assistant", "timestamp": "2026-01-01T10:00:01Z", "message": {"id": "m1", "model": "m", "content": [use("Edit", file_path="/w/b.rs", new_string="one")], "usage": {}}}]
    (tmp_path / "claude").mkdir()
    (tmp_path / "claude" / "s.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    row = logs.claude_calls(logs.read_lines(spark, str(tmp_path / "claude"))).first()
    assert code(row) == [("python", 3), ("rust", 3), ("ipynb", 1)] and row.edited_files == ["/w/x.rs", "/w/y", "/w/z.py", "/w/n.ipynb", "/w/b.rs"]

    item = lambda kind, **payload: {"timestamp": "2026-01-01T10:00:00Z", "type": kind, "payload": payload}
    usage = {"info": {"total_token_usage": {"input_tokens": 5, "output_tokens": 1}}}
    events = [
        item("session_meta", id="s1", originator="codex_cli"), item("event_msg", type="agent_message", message="```sql\nselect 1\n```"), item("response_item", type="custom_tool_call", name="exec", input="await tools.exec_command({cmd:'ls | wc'}); tools.apply_patch('p')"),
        item("response_item", type="custom_tool_call", name="exec", input="no calls"), item("event_msg", type="patch_apply_end", success=True, changes={"/w/a.py": {"unified_diff": "+++ b\n+one\n-two\n+three"}, "/w/b.md": {"type": "delete"}}), item("event_msg", type="token_count", **usage),
    ]
    (tmp_path / "codex").mkdir()
    (tmp_path / "codex" / "r.jsonl").write_text("\n".join(map(json.dumps, events)) + "\n")
    row = logs.codex_calls(logs.read_lines(spark, str(tmp_path / "codex"))).first()
    assert (row.tools, row.commands, row.edited_files, code(row)) == (["Bash", "Edit", "exec"], ["ls", "wc"], ["/w/a.py", "/w/b.md"], [("sql", 1), ("python", 2)])
