"""Paths, blocks, setup findings, pulse and lenses by hand, and over nothing."""

import datetime as dt

from pyspark.sql import functions as F

from loomline.operators import activity, turns


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i long, a string, b string")
    return [r.v for r in rows.select("i", column.alias("v")).orderBy("i").collect()]


def test_shown_paths(spark):
    shown = activity.display_file(F.col("a"), F.col("b"))
    assert values(spark, shown, ("/p/", "/p/src/a.rs"), ("/p", "/p"), ("/p", "/q/r/s.rs"), ("", "x/y/z"), ("/p", "/z")) == ["src/a.rs", "/p", "r/s.rs", "x/y/z", "/z"]


def test_junk_and_server_names(spark):
    assert values(spark, activity.junk_part(F.col("a")), ("a/dist/b", ""), ("distant/x", ""), (".git", ""), (None, "")) == ["dist", None, ".git", None]
    assert values(spark, activity.server_key(F.col("a")), ("My-Srv", ""), ("my_srv", "")) == ["my_srv", "my_srv"]


def calls(spark, rows):
    return spark.createDataFrame(rows, "session_key string, tools array<string>, referenced_files array<string>")


def test_setup_findings(spark):
    servers = spark.createDataFrame([(f"s-{i}",) for i in range(9)], "name string")
    files = spark.createDataFrame([("a", 200), ("b", 201)], "path string, lines long")
    x = calls(spark, [("k", ["mcp__S_0__t", "Read"], ["f", "f", "g"]), ("k", None, ["f"] * 3 + ["node_modules/x"] * 3), ("l", [], ["g"]), (None, [], ["h"] * 9)])
    got = {r.finding: (r["count"], r.detail, r.savings) for r in activity.setup_findings(x, servers, files).collect()}
    assert got["unused-mcp-servers"] == (8, "s-1, s-2, s-3, s-4, s-5, s-6, …", 8 * 2000 * 2)
    assert got["claude-md-bloat"] == (1, "b (201)", 13)
    assert "redundant-rereads" not in got  # four: f was read five times in one session
    assert got["junk-directory-reads"] == (3, "node_modules", 1800)
    assert [r.finding for r in activity.setup_findings(calls(spark, []), servers, files.limit(0)).collect()] == ["unused-mcp-servers"]


def test_pulse_takes_the_first_peak(spark):
    points = spark.createDataFrame([(dt.date(2024, 1, d), v, c) for d, v, c in ((1, 1.0, 2), (2, 5.0, 1), (3, 5.0, 9), (4, 0.0, 1))], "day date, cost double, calls long")
    assert tuple(activity.pulse(points).first()) == (13, 9, dt.date(2024, 1, 2), 5.0, dt.date(2024, 1, 4), 0.0)
    assert activity.pulse(points.limit(0)).count() == 0


def test_lens_hides_and_scales(spark):
    edges = spark.createDataFrame([("project_tool", "p", "t", 100.0), ("project_core", "p", "c", 1.0), ("tool_model", "t", "m", 500.0)], "relation string, source string, target string, cost double")
    assert {(r.relation, r.strength) for r in activity.lens(edges).collect()} == {("project_tool", 100.0), ("project_core", 2.0)}
    assert {r.relation for r in activity.lens(edges, "tools", core=False).collect()} == {"project_tool", "tool_model"}
    assert activity.lens(edges.limit(0)).count() == 0


def test_blocks_of_a_day_merge_over_quarters(spark):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    spans = [(at(9, 0), at(9, 1)), (at(9, 14), at(11, 0)), (at(9, 29), at(9, 30)), (at(11, 15), at(11, 20)), (at(11, 36), at(11, 40)), (at(13, 0), at(13, 0))]
    rows = spark.createDataFrame([(dt.date(2024, 1, 1), a, b) for a, b in spans], "day date, start timestamp_ntz, end timestamp_ntz")
    got = sorted((r.start, r.end) for r in turns.day_blocks(rows).collect())
    assert got == [(at(9, 0), at(11, 20)), (at(11, 36), at(11, 40)), (at(13, 0), at(13, 0))]
