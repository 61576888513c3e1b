"""Queries of archive seeds and removals, code fences, epoch times and turn subsets, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fences
from ..operators import archive, practice
from ..sources import driver_tables as tables
from ..sources.driver_tables import PRACTICE_SQL
from .practice_catalog import practice_view, turns_sql


def _kept(x: DataFrame) -> DataFrame:
    calls = tables.practice_calls(x)
    later = calls.where("seq % 3 = 0").select("tool", F.array(F.concat(F.lit("e"), F.col("seq") - 5), F.concat(F.lit("e"), F.col("seq") - 10)).alias("superseded"), F.col("user_message").alias("user_text"), F.lit(None).cast("string").alias("assistant_text"))
    return archive.without_superseded(archive.seed_transcripts(calls), later)


def _fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines that begin with a, b or t are fences."""
    fenced = F.regexp_replace("text", r"(?dm)^[abtABT]", "  ``` PY $0")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(fences.code_fences(fenced)).alias("b"))
    return rows.groupBy("doc_id", F.col("b.language").alias("language")).agg(F.count("*").alias("blocks"), F.sum("b.loc").alias("loc"), F.max("b.loc").alias("longest"))


def _epochs(x: DataFrame) -> DataFrame:
    i = F.col("seq") + 1_700_000_000
    raw = F.when(F.col("seq") % 3 == 0, i).when(F.col("seq") % 3 == 1, i * 1000 + 7).otherwise(i * 1_000_000_000 + 123_456_789)
    return x.select("seq", fences.epoch_time(raw).cast("timestamp_ntz").alias("at"))


def register(over_calls: Callable, over: Callable, signals_sql: Callable, now) -> None:
    """Add the queries; over_calls(name, build, sql) files one over the enriched calls, over(name, query, sql) one over the tables."""
    seeds = f"""
, {PRACTICE_SQL},
seeds AS (SELECT tool, dedup_key, session_id, project, timestamp, user_message AS user_text, 'prompt' AS origin FROM pc
  WHERE user_message <> '' AND NOT coalesce(tool = 'copilot' AND cost = 0 AND input_tokens = 0 AND output_tokens = 0 AND cache_read_tokens = 0 AND cache_write_tokens = 0, false))
"""
    over_calls("O17_seed_transcripts", lambda x: archive.seed_transcripts(tables.practice_calls(x)), seeds + "SELECT * FROM seeds")
    over_calls("O13_unsuperseded_transcripts", _kept, seeds + "SELECT * FROM seeds WHERE (tool, dedup_key) NOT IN (SELECT (tool, unnest(['e' || (seq - 5), 'e' || (seq - 10)])) FROM pc WHERE seq % 3 = 0 AND user_message <> '')")
    over("X05_code_fences", _fences, r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '(?m)^([abtABT])', '  ``` PY \1', 'g') AS text FROM documents),
p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '(?m)^[^\S\n]*```[^\n]*\n?')) AS part, generate_subscripts(regexp_split_to_array(text, '(?m)^[^\S\n]*```[^\n]*\n?'), 1) AS nth FROM d),
b AS (SELECT doc_id, length(part) - length(replace(part, chr(10), '')) + CASE WHEN part <> '' AND NOT ends_with(part, chr(10)) THEN 1 ELSE 0 END AS loc FROM p WHERE nth % 2 = 0)
SELECT doc_id, 'python' AS language, count(*)::BIGINT AS blocks, sum(loc)::BIGINT AS loc, max(loc)::BIGINT AS longest FROM b WHERE loc > 0 GROUP BY doc_id""")
    over_calls("X22_epoch_times", _epochs, """
SELECT seq, make_timestamp_ms(CASE seq % 3 WHEN 0 THEN (seq + 1700000000) * 1000 WHEN 1 THEN (seq + 1700000000) * 1000 + 7 ELSE (seq + 1700000000) * 1000 + 123 END) AS at FROM x""")
    subsets = lambda t: t.groupBy("tool").agg(F.count_if("prompted").alias("prompt_turns"), F.count_if(F.col("start_at").isNotNull()).alias("timed_turns"), F.count_distinct(F.when(F.col("conversational"), F.col("skey"))).alias("conversations"))
    over_calls("F09_turn_subsets", lambda x: subsets(practice.practice_turns(practice_view(x, now))), turns_sql(signals_sql("message"), "'all'", now) + """
SELECT tool, count(*) FILTER (prompted)::BIGINT AS prompt_turns, count(start_at)::BIGINT AS timed_turns, count(DISTINCT skey) FILTER (conversational)::BIGINT AS conversations FROM pt GROUP BY tool""")
