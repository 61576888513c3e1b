"""Merges into the archive, and reports."""

import datetime as dt

from pyspark.sql import functions as F

from loomline.operators import archive, details, reports
from loomline.operators.usage import enrich
from loomline.plans import catalog

SF = "/root/testdata/sf0.001"
COLUMNS = "tool string, dedup_key string, seq long, cost double, input_tokens long, output_tokens long, tools array<string>, commands array<string>, code_blocks array<struct<language:string,loc:long>>, edited_files array<string>, referenced_files array<string>, is_canceled boolean, prompt_chars long, response_chars long, elapsed_ms long, user_message string, timestamp timestamp, timestamp_quality string, token_quality string"
AT = dt.datetime(2026, 1, 1)


def row(tool, key, seq, cost=1.0, tokens=(10, 1), tools=(), blocks=(), files=(), canceled=False, chars=None, reply=None, elapsed=None, said="", quality="unknown"):
    return (tool, key, seq, cost, *tokens, list(tools), [], list(blocks), list(files), [], canceled, chars, reply, elapsed, said, AT, quality, quality)


def test_merge_by_tool(spark):
    old = spark.createDataFrame([
        row("claude-code", "a", 1, 5.0, tools=["Read"], blocks=[("py", 2)], files=["x"], reply=3), row("claude-code", "b", 2, tools=["Read"], reply=9),
        row("codex", "c", 3, tools=["Bash"], said=""), row("copilot", "copilot:cli:d", 4), row("cursor", "e", 5), row("gemini", "f", 6, chars=7, reply=1), row("gemini", "g", 7),
    ], COLUMNS)
    new = [
        row("claude-code", "a", 1, 99.0, (70, 70), ["Edit"], [("py", 3), ("sql", 1)], ["x", "y"], True, reply=4), row("claude-code", "b", 2, 99.0, tools=["Grep"], reply=5),
        row("codex", "c", 3, 99.0, (70, 7), tools=["Edit"], said="hello"), row("copilot", "copilot:cli:d", 4, 99.0, (70, 7)), row("cursor", "e", 5, 99.0, (70, 7)), row("gemini", "f", 6, 99.0, (70, 7), chars=8, reply=8, quality="exact"),
        row("gemini", "g", 7, chars=8, reply=8), row("gemini", "h", 8, 2.0), row("gemini", "h", 9, 3.0),
    ]
    incoming = spark.createDataFrame(new, COLUMNS).withColumn("merge_activity", F.col("dedup_key") == "a")
    got = {r.dedup_key: r for r in archive.merge_calls(old, incoming).collect()}
    a, b, c, f = got["a"], got["b"], got["c"], got["f"]
    assert (a.cost, a.input_tokens, a.tools, a.edited_files, a.response_chars, a.is_canceled) == (5.0, 10, ["Read", "Edit"], ["x", "y"], 7, True)
    assert [tuple(x) for x in a.code_blocks] == [("py", 5), ("sql", 1)] and a.timestamp_quality == "exact"
    assert b.tools == ["Grep"] and b.response_chars == 9 and c.tools == ["Edit"] and c.user_message == "hello" and c.input_tokens == 10
    assert got["copilot:cli:d"].input_tokens == 70 and got["e"].output_tokens == 7 and all(got[k].cost == 1.0 for k in "bcefg")
    assert (f.prompt_chars, f.response_chars, f.token_quality) == (7, 1, "exact") and got["g"].prompt_chars == 8 and got["h"].cost == 2.0
    again = archive.merge_calls(archive.merge_calls(old, incoming.where("dedup_key <> 'a'")), incoming.where("dedup_key <> 'a'"))
    assert sorted(map(str, again.collect())) == sorted(map(str, archive.merge_calls(old, incoming.where("dedup_key <> 'a'")).collect()))
    assert archive.merge_calls(old.limit(0), incoming).count() == 8 and archive.merge_calls(old, incoming.limit(0)).count() == 7


def test_superseded_estimates_are_zeroed(spark):
    old = spark.createDataFrame([row("copilot", "a", 1), row("copilot", "b", 2)], COLUMNS)
    got = {r.dedup_key: r for r in archive.zero_superseded(old, spark.createDataFrame([("copilot", "a"), ("copilot", "a")], "tool string, dedup_key string")).collect()}
    assert (got["a"].cost, got["a"].input_tokens, got["b"].cost, got["b"].input_tokens) == (0.0, 0, 1.0, 10)


def test_transcripts_grow(spark):
    kinds = "tool string, dedup_key string, seq long, user_text string, assistant_text string, project string, origin string"
    old = spark.createDataFrame([("claude-code", "a", 1, "u", "one", "p", "prompt"), ("codex", "b", 2, "long text", "x", "p", "prompt"), ("codex", "z", 3, "s", "", "p", "prompt")], kinds)
    new = spark.createDataFrame([("claude-code", "a", 1, "user", "two", "", "", True), ("codex", "b", 2, "short", "xyz", "q", "", False), ("codex", "c", 4, None, None, "q", "", False), ("codex", "d", 5, "n", None, "q", "", False)], kinds + ", merge_activity boolean")
    once = archive.merge_transcripts(old, new)
    got = {r.dedup_key: (r.user_text, r.assistant_text, r.project, r.origin) for r in once.collect()}
    assert got == {"a": ("user", "one\ntwo", "p", "full"), "b": ("long text", "xyz", "q", "full"), "z": ("s", "", "p", "prompt"), "d": ("n", "", "q", "full")}
    assert sorted(map(str, archive.merge_transcripts(once, new).collect())) == sorted(map(str, once.collect()))


def test_limits_are_added_once(spark):
    kinds = "tool string, limit_id string, observed_at long, used double"
    old = spark.createDataFrame([("t", None, 1, 5.0)], kinds)
    new = spark.createDataFrame([("t", None, 1, 6.0), ("t", "x", 1, 7.0), ("t", "x", 1, 7.0)], kinds)
    assert sorted(r.used for r in archive.merge_limits(old, new, ("tool", "limit_id", "observed_at")).collect()) == [5.0, 7.0]


def test_redaction_and_report_files(spark, tmp_path):
    x = enrich(catalog.tables.calls(spark, SF))
    hidden = reports.redacted(x)
    assert hidden.count() == x.count()
    first = {r.identity: r.project_alias for r in reports.numbered(x, "identity", "seq", "project").select("identity", F.col("alias").alias("project_alias")).collect()}
    assert sorted(first.values()) == sorted(f"project-{i + 1}" for i in range(len(first)))
    seen = list(dict.fromkeys(r.identity for r in x.orderBy("seq").select("identity").collect()))
    assert [first[s] for s in seen] == [f"project-{i + 1}" for i in range(len(seen))]
    assert hidden.where("identity like '/work%' or session_key like '%-2024-%'").count() == 0
    tables = reports.report_tables(hidden)
    for form in ("csv", "json", "parquet"):
        folder = reports.write_tables(tables, str(tmp_path), form, f"r-{form}")
        reader = spark.read.option("header", True) if form == "csv" else spark.read
        assert reader.format(form).load(f"{folder}/projects").count() == len(seen)


def test_every_name_gets_a_number_of_its_own(spark):
    x = spark.range(400_000).selectExpr("id % 390001 AS seq", "concat('n', id % 390001) AS name")
    got = reports.numbered(x, "name", "seq", "project").agg(F.count("*"), F.count_distinct("alias"), F.max(F.expr("int(substr(alias, 9))")), F.sum((F.expr("concat('project-', int(substr(name, 2)) + 1)") == F.col("alias")).cast("int"))).first()
    assert tuple(got) == (390_001,) * 4


def test_limits_show_only_reported_windows(spark):
    window = "struct<used_percent:double,minutes:bigint,resets_at:timestamp_ntz>"
    rows = [("codex", "l1", 1, dt.datetime(2024, 1, 30), (97.6, 300, dt.datetime(2024, 1, 31, 3)), None), ("codex", "l1", 0, dt.datetime(2024, 1, 1), (5.0, 300, None), (5.0, 10080, None)), ("copilot", "l2", 2, dt.datetime(2024, 1, 20), (101.0, 77, None), (-1.0, 43200, dt.datetime(2024, 1, 1)))]
    snapshots = spark.createDataFrame(rows, f"tool string, limit_id string, seq long, observed_at timestamp_ntz, primary {window}, secondary {window}")
    got = [tuple(r) for r in details.limit_windows(snapshots, dt.datetime(2024, 1, 31)).collect()]
    assert got == [("codex", "l1", "primary", "5h", 98, 2, False, 1), ("copilot", "l2", "primary", "77m", 100, 0, True, 2)]
