"""Every query of the catalogue against its SQL, and small hand-made cases."""

import datetime as dt

import duckdb
import pandas as pd
import pytest

from loomline.operators import lookups, search, turns, usage
from loomline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "conversations documents events lineitem orders part".split():
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        return pd.Timestamp(v)
    return int(v) if isinstance(v, float) and v.is_integer() else v


def rows(frame, columns):
    return sorted(str([plain(v) for v in row]) for row in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got, expected = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(expected, columns)


def test_fair_share_keeps_the_sum(spark):
    x = spark.createDataFrame([(3.0, 30, ["a", "b", "a"]), (1.0, 5, ["mcp__s__t"]), (9.0, 9, [])], "cost double, tokens long, tools array<string>")
    got = {r.tool: (r.cost, r.calls) for r in usage.fair_share(x, usage.core_tools(), "tool").collect()}
    assert got == {"a": (2.0, 2), "b": (1.0, 1)}


def test_superseded_rows_inherit_cost(spark):
    kinds = "tool string, dedup_key string, cost double, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long"
    old = spark.createDataFrame([("t", "a", 5.0, 1, 2, 3, 4), ("t", "b", 7.0, 9, 9, 9, 9)], kinds)
    new = spark.createDataFrame([("t", "c", 1.0, 1, 2, 3, 4, ["b", "a"])], kinds + ", superseded array<string>")
    assert [tuple(r)[:3] for r in lookups.superseded(old, new).collect()] == [("t", "c", 5.0)]


def test_search_takes_hostile_queries(spark):
    t = spark.createDataFrame([("k", "s", "t", "full", "Hello world", "")], "dedup_key string, session_id string, tool string, origin string, user_text string, assistant_text string")
    assert search.search(t, '"" "').count() == 0
    assert search.search(t, "hello wor").count() == 1
    assert search.search(t, "hello OR (*").count() == 0


def test_streaks_and_empty_input(spark):
    x = usage.enrich(catalog.tables.calls(spark, SF)).limit(0)
    assert turns.streaks(turns.turns(x)).count() == 0
    assert usage.period_totals(x).first().calls == 0


def test_edges_are_limited_by_relation_and_end_in_kept_nodes(spark):
    tools = [f"c{i}" for i in range(6)] + [f"mcp__s{i}__t" for i in range(6)]
    calls = [("s", 1.0 + i, 10, "p", "t", f"m{i}", tools) for i in range(8)] + [("s", 0.001, 1, f"q{i:02}", "t", f"n{i:02}", []) for i in range(40)]
    x = spark.createDataFrame(calls, "session_key string, cost double, tokens long, identity string, tool string, canonical string, tools array<string>")
    edges, nodes = turns.all_graph_edges(x), turns.graph_nodes(x)
    kept = turns.kept_edges(edges, nodes).collect()
    n = lambda relation, source: sum((r.relation, r.source) == (relation, source) for r in kept)
    assert [n("project_model", "project:p"), n("project_core", "project:p"), n("project_mcp", "project:p"), n("tool_core", "tool:t"), n("tool_model", "tool:t")] == [6, 5, 5, 6, 24]
    assert n("project_tool", "project:q28") == 1 and n("project_tool", "project:q29") == 0
    # a project whose only model is beyond the limit keeps its tool; a node without any edge goes
    alone = nodes.union(spark.createDataFrame([("core", "z", 0.0, 0.0, 0, 0, 99)], nodes.schema))
    assert "z" not in {r.label for r in turns.kept_nodes(edges, alone).collect()}
