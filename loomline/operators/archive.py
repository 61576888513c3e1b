"""The archive (O): merges of incoming calls, transcripts and limits into what is kept.

Each merge is one full outer join on (tool, dedup_key), the side that changes a row
decided by its tool, so a repeated batch changes nothing but what it may add to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookups import first_wins

KEY = ["tool", "dedup_key"]
ENRICHMENT = ("is_canceled", "prompt_chars", "response_chars", "elapsed_ms", "code_blocks", "edited_files", "referenced_files")
QUALITIES = ("interaction_mode", "token_quality", "timestamp_quality")
TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
#: Keys of rows whose totals run on and are refreshed in place.
RUNNING_TOTALS = "copilot:cli:"
MOST_BLOCKS, MOST_FILES = 32, 64


def effective_timestamp_quality(quality: Column, timestamp: Column) -> Column:
    """Unknown with a time is exact."""
    return F.when((quality == "unknown") & timestamp.isNotNull(), "exact").otherwise(quality)


def merge_blocks(blocks: Column) -> Column:
    """Lines summed by language, languages in the order they come, the first MOST_BLOCKS."""
    languages = F.slice(F.array_distinct(F.transform(blocks, lambda b: b["language"])), 1, MOST_BLOCKS)
    return F.transform(languages, lambda x: F.struct(x.alias("language"), F.aggregate(F.filter(blocks, lambda b: b["language"] == x), F.lit(0).cast("long"), lambda n, b: n + b["loc"]).alias("loc")))


def _is_empty(column: Column, kind: str) -> Column:
    if kind.startswith("array"):
        return column.isNull() | (F.size(column) == 0)
    return column.isNull() | ~column if kind == "boolean" else column.isNull()


def merge_calls(archive: DataFrame, incoming: DataFrame) -> DataFrame:
    """The archive with incoming calls in its columns.

    New keys are added, the first by seq. A known call keeps its cost. Qualities replace unknown
    ones; enrichment fills a row that has none. Claude rows take the activity anew, or, if
    merge_activity is set, after what is there. Codex rows take tools anew and a missing prompt.
    Running totals and Cursor tokens are refreshed. merge_activity may be absent.
    """
    if "merge_activity" not in incoming.columns:
        incoming = incoming.withColumn("merge_activity", F.lit(False))
    kinds = dict(archive.dtypes)
    old, new = archive.withColumn("_known", F.lit(True)).alias("a"), first_wins(incoming).withColumn("_fresh", F.lit(True)).alias("i")
    a, i = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"i.{c}"))
    tool, tail = F.coalesce(a("tool"), i("tool")), F.coalesce(i("merge_activity"), F.lit(False))
    claude, codex = tool == "claude-code", tool == "codex"
    nothing_there = F.lit(True)
    for c in ENRICHMENT:
        if c in kinds:
            nothing_there = nothing_there & _is_empty(a(c), kinds[c])

    def updated(c: str) -> Column:
        after = F.concat(F.coalesce(a(c), i(c)), F.coalesce(i(c), a(c))) if kinds[c].startswith("array") else None
        if c in QUALITIES:
            fresh = effective_timestamp_quality(i(c), i("timestamp")) if c == "timestamp_quality" else i(c)
            return F.when(a(c) == "unknown", fresh).otherwise(a(c))
        if c in ("tools", "commands"):
            return F.when(claude & tail, after).when(claude | codex, i(c)).otherwise(a(c))
        if c in ("edited_files", "referenced_files"):
            return F.when(claude & tail, F.slice(F.array_distinct(after), 1, MOST_FILES)).when(claude | nothing_there, i(c)).otherwise(a(c))
        if c == "code_blocks":
            return F.when(claude & tail, merge_blocks(after)).when(claude | nothing_there, i(c)).otherwise(a(c))
        if c == "response_chars":
            return F.when(claude & tail, F.coalesce(a(c) + i(c), a(c), i(c))).when(claude, F.greatest(a(c), i(c))).when(nothing_there, i(c)).otherwise(a(c))
        if c == "is_canceled":
            return F.when(claude & tail, a(c) | i(c)).when(nothing_there, i(c)).otherwise(a(c))
        if c in ("prompt_chars", "elapsed_ms"):
            return F.when(nothing_there, i(c)).otherwise(a(c))
        if c == "user_message":
            return F.when(codex & (F.coalesce(a(c), F.lit("")) == ""), i(c)).otherwise(a(c))
        if c in TOKENS:
            return F.when(a("dedup_key").startswith(RUNNING_TOTALS) | (tool == "cursor"), i(c)).otherwise(a(c))
        return a(c)

    def merged(c: str) -> Column:
        if c in KEY:
            return F.coalesce(a(c), i(c)).alias(c)
        fresh = effective_timestamp_quality(i(c), i("timestamp")) if c == "timestamp_quality" else i(c)
        return F.when(F.col("_known").isNull(), fresh).when(F.col("_fresh").isNull(), a(c)).otherwise(updated(c)).alias(c)

    both = old.join(new, [a(k) == i(k) for k in KEY], "full")
    return both.select(*[merged(c) for c in archive.columns])


def zero_superseded(archive: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows named by keys (tool, dedup_key) stay with no tokens and no cost."""
    named = keys.select(*KEY).distinct().withColumn("_named", F.lit(True))
    rows = archive.join(named, KEY, "left")
    zeroed = [F.when(F.col("_named"), F.lit(0)).otherwise(F.col(c)).cast(k).alias(c) if c in (*TOKENS, "cost") else F.col(c) for c, k in archive.dtypes]
    return rows.select(*zeroed)


def stripped(text: Column) -> Column:
    """Transcript text without the two private-use marks of highlights; null: empty."""
    return F.coalesce(F.translate(text, "\ue000\ue001", ""), F.lit(""))


def merge_transcripts(archive: DataFrame, incoming: DataFrame) -> DataFrame:
    """Texts only grow; a Claude tail (merge_activity) is appended unless the text ends with it; what is met again is full."""
    texts = ("user_text", "assistant_text")
    new = first_wins(incoming.withColumns({c: stripped(F.col(c)) for c in texts})).where("user_text <> '' or assistant_text <> ''").alias("i")
    a, i = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"i.{c}"))
    tail = (i("tool") == "claude-code") & F.coalesce(i("merge_activity"), F.lit(False))
    appended = F.when(i("assistant_text") == "", a("assistant_text")).when(a("assistant_text") == "", i("assistant_text")).when(F.endswith(a("assistant_text"), i("assistant_text")), a("assistant_text")).otherwise(F.concat_ws("\n", a("assistant_text"), i("assistant_text")))
    retold = F.when((i("user_text") != "") & ((a("user_text") == "") | (a("origin") == "prompt")), i("user_text")).otherwise(a("user_text"))
    longer = lambda c: F.when(F.length(i(c)) > F.length(a(c)), i(c)).otherwise(a(c))
    known = {
        "user_text": F.when(tail, retold).otherwise(longer("user_text")),
        "assistant_text": F.when(tail, appended).otherwise(longer("assistant_text")),
        "project": F.when(i("project") != "", i("project")).otherwise(a("project")),
        "origin": F.lit("full"),
    }
    new_row, untouched = a("dedup_key").isNull(), i("dedup_key").isNull()

    def merged(c: str) -> Column:
        fresh = F.lit("full") if c == "origin" else i(c)
        return F.when(new_row, fresh).when(untouched, a(c)).otherwise(known.get(c, a(c))).alias(c)

    return archive.alias("a").join(new, [a(k) == i(k) for k in KEY], "full").select(*[merged(c) for c in archive.columns])


def merge_limits(archive: DataFrame, incoming: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Observations with a key not seen before are added; nulls in a key are equal."""
    same = F.to_json(F.struct(*key))
    fresh = incoming.withColumn("_key", same).dropDuplicates(["_key"]).join(archive.select(same.alias("_key")), "_key", "left_anti")
    return archive.unionByName(fresh.select(*archive.columns))


def seed_transcripts(calls: DataFrame) -> DataFrame:
    """A transcript of its prompt for each call that has one, but for zeroed Copilot calls."""
    sums = ("cost", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
    zeroed = (F.col("tool") == "copilot") & reduce(Column.__and__, [F.col(c) == 0 for c in sums])
    rows = calls.where((F.col("user_message") != "") & ~F.coalesce(zeroed, F.lit(False)))
    return rows.select("tool", "dedup_key", "session_id", "project", "timestamp", F.col("user_message").alias("user_text"), F.lit("prompt").alias("origin"))


def without_superseded(transcripts: DataFrame, calls: DataFrame) -> DataFrame:
    """Transcripts but for those that a call supersedes which carries text itself; calls: tool, superseded (keys), user_text, assistant_text."""
    has_text = (F.coalesce("user_text", F.lit("")) != "") | (F.coalesce("assistant_text", F.lit("")) != "")
    gone = calls.where(has_text).select("tool", F.explode("superseded").alias("dedup_key")).distinct()
    return transcripts.join(gone, ["tool", "dedup_key"], "left_anti")
