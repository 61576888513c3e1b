"""The practice rules with all their outcomes (R01-R28), by period, and the scores drawn from them.

Conditions are SQL that Spark and other engines read alike, over the columns that practice_turns and sessions make.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import caps_letter_ratio
from ..functions.texts import WORK_TYPES
from . import turns as plain_turns
from .prompt_rules import signals
from .shared import written

GROUPS = ("prompt_quality", "session_hygiene", "code_review", "tool_mastery")
# Tools whose rows carry a signal.
CANCELS, FILE_REFS, CACHE_READS, CONVERSATIONS = ("claude-code", "codex"), ("claude-code", "codex", "cursor"), ("claude-code", "codex"), ("claude-code", "codex", "cursor")
PREMIUM_RATE, EXAMPLES, EXAMPLE_CHARS = 10.0, 3, 120


@dataclass(frozen=True)
class Rule:
    """Which rows of source count (member), which of them hit, and when that fires; examples come from hits with a text."""

    name: str
    group: str
    severity: str
    source: str
    fires: str
    member: str = "true"
    hit: str = "true"
    value: str = "0"
    more: str = "0"
    text: str = "''"
    detail: str = "''"
    blank: bool = False  # whether an empty text makes an example
    pct: str = "NULL"
    stat: str = "NULL"
    escalate: str = "false"


_PCT, _REST = "occurrences / nullif(total, 0)", "(total - occurrences) / nullif(total, 0)"
# Names, groups, severities and thresholds.
RULES = (
    Rule("lazy-prompting", "prompt_quality", "medium", "turn", "occurrences > 10 and occurrences > 0.3 * total", "prompted", "chars < 30", text="message", detail="concat(chars, ' chars')", pct=_PCT),
    Rule("caps-lock", "prompt_quality", "medium", "turn", "occurrences >= 1", "prompted", "chars >= 10 and caps >= 0.9", text="message"),
    Rule("frustration-signals", "prompt_quality", "medium", "turn", "occurrences >= 2", "prompted", "chars >= 10 and (frustrated or caps_words >= 0.4)", text="message"),
    Rule("repeated-prompts", "prompt_quality", "medium", "repeat", "occurrences >= 3", pct=_PCT, stat="concat(best, '')", escalate="occurrences > 20"),
    Rule("low-constraint-usage", "prompt_quality", "medium", "turn", "total >= 30 and occurrences > 0.92 * total", "prompted and chars >= 40", "not constrained", text="message", detail="'no constraints'", pct=_REST, stat="concat(total - occurrences, '')"),
    Rule("verbose-output", "prompt_quality", "medium", "turn", "occurrences > 10 and occurrences > 0.1 * total", "prompted", "output_tokens > 5000 and chars < 200", text="message", detail="concat(output_tokens, ' output tokens')", pct=_PCT),
    Rule("verbose-prompt-no-compression", "prompt_quality", "low", "turn", "occurrences > 15 and occurrences > 0.2 * total", "prompted", "chars >= 800 and fillers >= 2", text="message", detail="concat(chars, ' chars')", pct=_PCT),
    Rule("excessive-file-context", "prompt_quality", "medium", "turn", "occurrences >= 10 and occurrences >= 0.005 * total", "has_file_refs", "referenced >= 30", "referenced", text="message", detail="concat(referenced, ' files')", blank=True, pct=_PCT, stat="concat(best, '')"),
    Rule("session-drift", "session_hygiene", "medium", "session", "occurrences > 3", "conversational", "n_turns >= 5 and kinds >= 4", text="project", detail="concat(kinds, ' work types in one session')"),
    Rule("late-night-coding", "session_hygiene", "low", "turn", "occurrences > 10", "start_at is not null", "start_hour < 5", text="message", detail="substring(CAST(start_at AS STRING), 1, 16)", pct=_PCT),
    Rule("weekend-overwork", "session_hygiene", "low", "turn", "occurrences > 20 and occurrences > 0.25 * total", "start_at is not null", "on_weekend", pct=_PCT, stat="concat(total - occurrences, '')"),
    Rule("mega-sessions", "session_hygiene", "high", "session", "occurrences > 0", "conversational", "n_turns >= 50", "n_turns", text="project", detail="concat(n_turns, ' messages')", stat="concat(best, '')"),
    Rule("abandon-sessions", "session_hygiene", "low", "session", "occurrences > 10 and occurrences > 0.4 * total", "conversational", "n_turns = 1", text="first_message", detail="project", pct=_PCT),
    Rule("high-cancellation", "session_hygiene", "medium", "turn", "occurrences > 0.15 * total", "has_cancel", "canceled", text="message", pct=_PCT, escalate="occurrences > 0.3 * total"),
    Rule("broken-flow-state", "session_hygiene", "medium", "day", "total >= 5 and occurrences > 0.6 * total", hit="score < 25", value="score", pct=_PCT, stat="concat(CAST(round(sum_all / nullif(total, 0)) AS BIGINT), '')", escalate="occurrences > 0.8 * total"),
    Rule("slow-responses", "session_hygiene", "low", "turn", "occurrences > 5", "elapsed is not null", "elapsed > 300000", "elapsed", text="message", detail="concat(CAST(floor(elapsed / 1000) AS BIGINT), 's')", stat="concat(CAST(floor(floor(sum_value / nullif(occurrences, 0)) / 1000) AS BIGINT), '')"),
    Rule("runaway-agent-loops", "session_hygiene", "high", "turn", "occurrences >= 3", "true", "tool_calls >= 40", "tool_calls", text="message", detail="concat(tool_calls, ' tool calls')", stat="concat(CAST(floor(sum_value / greatest(occurrences, 1)) AS BIGINT), '')"),
    Rule("retry-loops", "session_hygiene", "medium", "chain", "total >= 15 and round(occurrences / nullif(total, 0) * 100) >= 40", hit="retries > 0", value="retries", pct=_PCT, stat="concat(sum_value, '')", escalate="round(occurrences / nullif(total, 0) * 100) >= 60"),
    Rule("copy-paste-blindness", "code_review", "high", "session", "occurrences >= 3", "conversational", "n_turns >= 2 and loc >= 50 and not refined", text="project", detail="concat(loc, ' AI LoC, no refinement')"),
    Rule("speed-accept", "code_review", "high", "turn", "occurrences >= 5", "conversational and loc >= 20 and gap between 0 and 15000", "true", "gap", "loc", "project", "concat(loc, ' LoC accepted in ', CAST(floor(gap / 1000) AS BIGINT), 's')", stat="concat(CAST(floor(sum_more / greatest(occurrences, 1)) AS BIGINT), ' LoC / ', CAST(floor(floor(sum_value / greatest(occurrences, 1)) / 1000) AS BIGINT), 's')"),
    Rule("vibe-coding", "code_review", "high", "session", "occurrences >= 3", "conversational", "loc >= 100 and n_turns <= 5 and coalesce(opening, '') <> '' and not opening_spec", "loc", text="project", detail="concat(loc, ' AI LoC in ', n_turns, ' messages')", stat="concat(sum_value, '')"),
    Rule("tunnel-vision", "code_review", "low", "project", "best >= 3 and occurrences >= 50 and occurrences > 0.95 * total", pct=_PCT, stat="top_name"),
    Rule("no-language-exploration", "code_review", "low", "language", "total >= 4 and best > 0 and occurrences >= 8", stat="concat(best, '')", escalate="occurrences > 12"),
    Rule("mcp-tool-bloat", "tool_mastery", "medium", "session", "occurrences >= 3", "conversational", "distinct_tools > 40", "distinct_tools", text="project", detail="concat(distinct_tools, ' distinct tools')", stat="concat(best, '')"),
    Rule("model-overreliance", "tool_mastery", "medium", "model", "total > 10 and best < 3 and occurrences > 0.8 * total", pct=_PCT, stat="top_name"),
    Rule("reasoning-effort-overuse", "tool_mastery", "medium", "turn", "total > 20 and occurrences > 0.5 * total", "effort is not null", "effort in ('high', 'max')", text="model", detail="concat('effort: ', effort)", pct=_PCT),
    Rule("premium-waste", "tool_mastery", "medium", "turn", "occurrences > 10", "prompted", "loc = 0 and premium and (chars < 50 or (chars < 120 and tool_calls = 0 and lookup))", text="message", detail="model", pct=_PCT),
    Rule("cache-hit-starvation", "tool_mastery", "medium", "turn", "total > 20 and sum_more < 0.1 * sum_value", "has_cache_reads and full_prompt > 5000", "true", "full_prompt", "cache_read", "message", "concat(full_prompt, ' prompt tokens, ', cache_read, ' cached')", stat="printf('%.1f%%', sum_more / nullif(sum_value, 0) * 100.0)"),
)


def effort(model: Column) -> Column:
    """The last part of a model's name that is an effort."""
    named = F.regexp_extract(F.lower(model), r"(?s)^(?:.*[-:])?(low|medium|high|xhigh|max)(?:[-:].*)?\z", 1)
    return F.replace(F.nullif(named, F.lit("")), F.lit("xhigh"), F.lit("max"))


def _judged_prompts(t: DataFrame) -> DataFrame:
    """t with the signals of its message."""
    capitals = F.when(F.col("message").rlike("[A-Z]"), caps_letter_ratio(F.col("message")))
    return signals(t, "message").withColumnRenamed("constraint", "constrained").withColumn("caps", F.coalesce(capitals, F.lit(0.0)))


def practice_turns(x: DataFrame, period: Column | None = None, once: bool = False) -> DataFrame:
    """Turns of sessions (split by period, a string) with their signals and the gap before the next turn.

    x: enriched calls with user_message, edited_files, referenced_files and output_rate; once: each text is judged once, then looked up.
    """
    key = F.concat_ws("|", F.lit("all") if period is None else period, F.coalesce("session_key", F.concat_ws(":", "tool", "project")))
    order = Window.partitionBy("skey").orderBy(F.col("timestamp").asc_nulls_first(), "seq")
    at, exact = F.struct("timestamp", "seq"), F.col("timestamp_quality") == "exact"
    same = F.lag("user_message").over(order).eqNullSafe(F.col("user_message")) & F.lag("prompt_chars").over(order).eqNullSafe(F.col("prompt_chars")) & F.lag("seq").over(order).isNotNull()
    loc = F.aggregate(F.transform("code_blocks", lambda b: b["loc"]), F.lit(0).cast("long"), lambda a, n: a + n)
    size = lambda c: F.size(c).cast("long").alias(c)
    # the sorts carry sizes and names, not files and blocks; the first of a sorted session is its least
    plain = ("timestamp", "seq", "timestamp_quality", "tool", "project", "model", "canonical", "output_rate", "user_message", "prompt_chars", "elapsed_ms", "output_tokens", "input_tokens", "cache_read_tokens", "cache_write_tokens", "is_canceled")
    rows = x.select(key.alias("skey"), *plain, loc.alias("loc"), size("edited_files"), size("referenced_files"), size("tools").alias("tool_calls"), F.struct("tools", F.transform("code_blocks", lambda b: b["language"]).alias("languages")).alias("names"))
    rows = rows.withColumns({"new": (~same).cast("long"), "opened": F.first(at).over(order)}).withColumn("turn", F.sum("new").over(order))
    first = F.min_by(F.struct("tool", "project", "model", "canonical", "output_rate", F.col("user_message").alias("message"), F.col("prompt_chars").alias("chars")), at)
    t = rows.groupBy("skey", "turn").agg(
        first.alias("f"), F.min("opened").alias("opened"), F.min(F.when(exact, F.col("timestamp"))).alias("start_at"), F.max(F.when(exact, F.col("timestamp"))).alias("end_at"), F.max(F.when(exact, F.col("elapsed_ms"))).alias("elapsed"),
        F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")).alias("full_prompt"), F.sum("cache_read_tokens").alias("cache_read"), F.sum("loc").alias("loc"),
        F.collect_list("names").alias("names"), F.sum("tool_calls").alias("tool_calls"), F.sum("edited_files").alias("edited"), F.sum("referenced_files").alias("referenced"), F.max("is_canceled").alias("canceled"),
    ).select("*", "f.*", F.array_distinct(F.flatten("names.languages")).alias("languages"), F.array_distinct(F.flatten("names.tools")).alias("tool_names")).drop("f", "names")
    w = Window.partitionBy("skey").orderBy("turn")
    gap = F.timestamp_diff("MILLISECOND", F.col("end_at"), F.lead("start_at").over(w)) - F.coalesce(F.lead("elapsed").over(w), F.lit(0))
    t = t.withColumn("gap", gap)
    if once:
        # a prompt stands in all calls of its turn, and many are said again; written, so that few texts are known to be few
        said = written(_judged_prompts(x.select(F.col("user_message").alias("message")).distinct()), "prompts").withColumnRenamed("message", "said")
        t = t.join(said, t["message"].eqNullSafe(said["said"]), "left").drop("said")
    else:
        t = _judged_prompts(t)
    has = lambda tools: F.col("tool").isin(*tools)
    return t.withColumns({
        "period": F.substring_index("skey", "|", 1), "prompted": (F.coalesce("chars", F.lit(0)) > 0) & (F.col("message") != ""),
        "start_hour": F.hour("start_at"), "on_weekend": F.weekday("start_at") >= 5, "effort": effort(F.col("model")),
        "premium": F.col("output_rate") >= PREMIUM_RATE, "has_cancel": has(CANCELS), "has_file_refs": has(FILE_REFS), "has_cache_reads": has(CACHE_READS), "conversational": has(CONVERSATIONS),
    })


def sessions(t: DataFrame) -> DataFrame:
    """One row for each session of practice_turns: X35 and what the session rules ask for."""
    spoken = F.col("message") != ""
    later = (F.col("turn") > 1) & ((F.col("edited") > 0) | (spoken & F.col("refinement")))
    opening = F.min_by(F.when(spoken, F.struct("message", "spec")), F.when(spoken, F.col("turn")))
    # work types are few and fixed, so a bit for each tells how many there are
    bit = F.expr("shiftleft(1, " + "CASE work_type " + " ".join(f"WHEN '{n}' THEN {i}" for i, (n, _) in enumerate(WORK_TYPES, 1)) + " ELSE 0 END)")
    return t.groupBy("period", "skey").agg(
        F.min("opened").alias("opened"), F.lit(0).cast("long").alias("turn"), F.count("*").alias("n_turns"), F.sum("loc").alias("loc"), F.coalesce(F.bit_count(F.bit_or(F.when(spoken, bit))), F.lit(0)).cast("long").alias("kinds"), F.max(later).alias("refined"),
        F.min_by(F.struct("project", "conversational", "message"), "turn").alias("f"), opening.alias("o"), F.size(F.array_distinct(F.flatten(F.collect_list("tool_names")))).cast("long").alias("distinct_tools"),
    ).select("*", "f.project", "f.conversational", F.col("f.message").alias("first_message"), F.col("o.message").alias("opening"), F.col("o.spec").alias("opening_spec")).drop("f", "o")


def _hour() -> Column:
    """Whole hours up to the session's first call; a session without a time comes first."""
    return F.coalesce(F.timestamp_diff("HOUR", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("opened.timestamp")), F.lit(-(1 << 62)))


def _judged(r: Rule) -> tuple[Column, Column, Column]:
    """Whether a row counts, whether it hits, and the text of its example."""
    member = F.coalesce(F.expr(r.member), F.lit(False))
    hit = member & F.coalesce(F.expr(r.hit), F.lit(False))
    text = F.expr(r.text)
    return member, hit, F.when(hit if r.blank else hit & (text != ""), text)


def _counted(rows: DataFrame, source: str) -> DataFrame:
    """(period, hour, rule) with the figures of each rule of this source: one aggregation over rows as they are, not over a row for each rule."""
    made = []
    for r in RULES:
        if r.source == source:
            member, hit, text = _judged(r)
            occurrences, total = F.count_if(hit), F.count_if(member)

            def figure(of, what: str, who: Column, many: Column) -> Column:
                return F.when(many > 0, F.lit(0).cast("long")) if what == "0" else of(F.when(who, F.expr(what).cast("long")))  # noqa: B023

            figures = {
                "occurrences": occurrences, "total": total, "best": figure(F.max, r.value, member, total), "sum_value": figure(F.sum, r.value, hit, occurrences), "sum_more": figure(F.sum, r.more, hit, occurrences),
                "sum_all": figure(F.sum, r.value, member, total), "shown": F.count_if(text.isNotNull()),
            }
            made.append(F.struct(F.lit(r.name).alias("rule"), *[c.alias(n) for n, c in figures.items()]))
    sums = rows.groupBy("period", _hour().alias("hour")).agg(F.array(*made).alias("made"))
    return written(sums.select("period", "hour", F.explode("made").alias("d")).select("period", "hour", "d.*").where("total > 0"), f"{source}-figures")


def _summed(counted: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("sum_value", "sum_more", "sum_all")]
    return counted.groupBy("period", "rule").agg(F.sum("occurrences").alias("occurrences"), F.sum("total").alias("total"), F.max("best").alias("best"), *sums, F.lit(None).cast("string").alias("top_name"))


def _early_hits(rows: DataFrame, source: str, counted: DataFrame) -> DataFrame:
    """(period, rule, text, detail, opened, turn) of hits with a text, up to the hour of a session's opening by which a rule has EXAMPLES of them."""
    before = F.sum("shown").over(Window.partitionBy("period", "rule").orderBy("hour")) - F.col("shown")
    last = counted.where("shown > 0").withColumn("before", before).where(F.col("before") < EXAMPLES).groupBy("period", "rule").agg(F.max("hour").alias("until"))
    last = last.groupBy("period").agg(F.max("until").alias("last"), F.map_from_entries(F.collect_list(F.struct("rule", "until"))).alias("until"))
    early = rows.withColumn("hour", _hour()).join(F.broadcast(last), "period").where(F.col("hour") <= F.col("last"))  # a row for each period
    made = []
    for r in RULES:
        if r.source == source:
            text = _judged(r)[2]
            made.append(F.when(text.isNotNull() & (F.col("hour") <= F.col("until")[r.name]), F.struct(F.lit(r.name).alias("rule"), text.alias("text"), F.expr(r.detail).alias("detail"))))
    return early.select("period", "opened", "turn", F.explode(F.array_compact(F.array(*made))).alias("d")).select("period", "d.*", "opened", "turn")


def _first_examples(hits: DataFrame, *order: Column) -> DataFrame:
    """The first EXAMPLES of each rule, as one text."""
    place = F.row_number().over(Window.partitionBy("period", "rule").orderBy(*order))
    kept = hits.withColumn("place", place).where(F.col("place") <= EXAMPLES)
    line = F.concat(F.left(F.trim("text"), F.lit(EXAMPLE_CHARS)), F.lit(" | "), "detail")
    return kept.groupBy("period", "rule").agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", line.alias("line"))))["line"], "\n").alias("examples"))


def _shares(rows: DataFrame, rule: str, name: str, weight: Column) -> DataFrame:
    """Turns by name: the largest share, of how many names."""
    counts = rows.groupBy("period", F.col(name).alias("name")).agg(F.sum(weight).alias("count"))
    top = F.max_by("name", F.struct("count", "name"))
    zero = F.lit(None).cast("long")
    return counts.groupBy("period").agg(F.lit(rule).alias("rule"), F.max("count").alias("occurrences"), F.sum("count").alias("total"), F.count("*").alias("best"), zero.alias("sum_value"), zero.alias("sum_more"), zero.alias("sum_all"), top.alias("top_name"))


def retry_chains(x: DataFrame, period: Column | None = None) -> DataFrame:
    """For each session and edited file, the edits that come after a shell run since the last one; an edit is judged before its own call's run."""
    key = F.concat_ws("|", F.lit("all") if period is None else period, F.coalesce("session_key", F.concat_ws(":", "tool", "project")))
    order = Window.partitionBy("skey").orderBy(F.col("timestamp").asc_nulls_first(), "seq")
    rows = x.withColumn("skey", key).withColumn("session_tool", F.first("tool").over(order)).where(F.col("session_tool").isin(*FILE_REFS))
    rows = rows.withColumn("runs", F.coalesce(F.sum((F.size("commands") > 0).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edits = rows.select("skey", "timestamp", "seq", "runs", F.explode(F.array_distinct("edited_files")).alias("file"))
    chain = Window.partitionBy("skey", "file").orderBy(F.col("timestamp").asc_nulls_first(), "seq")
    again = F.coalesce(F.col("runs") > F.lag("runs").over(chain), F.lit(False))
    return edits.withColumn("again", again).groupBy(F.substring_index("skey", "|", 1).alias("period"), "skey", "file").agg(F.count("*").alias("edits"), F.count_if("again").alias("retries"))


def outcomes(x: DataFrame, period: Column | None = None, examples: bool = True) -> DataFrame:
    """Every rule in every period that has calls, whether it fires or not; findings and scores ask for no examples."""
    t = written(practice_turns(x, period, once=True), "turns")
    s = written(sessions(t), "sessions")
    by_turn, by_session = _counted(t, "turn"), _counted(s, "session")
    prompts = t.where("prompted").withColumn("key", F.trim(F.lower(F.left("message", F.lit(100)))))
    every = prompts.groupBy("period").agg(F.count("*").alias("total"))
    groups = prompts.where(F.length("key") >= 10).groupBy("period", "key").agg(F.count("*").alias("n"), F.min_by("message", F.struct("opened", "turn")).alias("text")).where("n >= 3")
    zero = F.lit(None).cast("long")
    repeated = groups.groupBy("period").agg(F.sum("n").alias("occurrences"), F.count("*").alias("best")).join(every, "period").select("period", F.lit("repeated-prompts").alias("rule"), "occurrences", "total", "best", zero.alias("sum_value"), zero.alias("sum_more"), zero.alias("sum_all"), F.lit(None).cast("string").alias("top_name"))
    flow = plain_turns.session_flow(t.select("skey", "turn", F.col("start_at").alias("start"), F.col("end_at").alias("end"), F.col("elapsed").alias("elapsed_ms")))
    days = flow.groupBy(F.substring_index("skey", "|", 1).alias("period"), "day").agg(F.round(F.avg("score")).cast("long").alias("score"))
    days = days.select("*", F.lit(None).cast("struct<timestamp:timestamp_ntz,seq:bigint>").alias("opened"), F.lit(0).cast("long").alias("turn"))
    chains = written(retry_chains(x, period), "chains").select("*", F.lit(None).cast("struct<timestamp:timestamp_ntz,seq:bigint>").alias("opened"), F.lit(0).cast("long").alias("turn"))
    weeks = t.where("start_at is not null and size(languages) > 0").select("period", (F.extract(F.lit("YEAROFWEEK"), "start_at") * 53 + F.weekofyear("start_at")).cast("long").alias("week"), F.explode("languages").alias("language"))
    seen = weeks.where("language <> 'unknown'").groupBy("period", "language").agg(F.min("week").alias("week")).groupBy("period").agg(F.max("week").alias("newest"), F.count("*").alias("best"))
    active = weeks.groupBy("period").agg(F.max("week").alias("last"), F.count_distinct("week").alias("total"))
    languages = active.join(seen, "period").select("period", F.lit("no-language-exploration").alias("rule"), F.greatest(F.col("last") - F.col("newest"), F.lit(0)).cast("long").alias("occurrences"), "total", "best", zero.alias("sum_value"), zero.alias("sum_more"), zero.alias("sum_all"), F.lit(None).cast("string").alias("top_name"))
    figures = _summed(by_turn).unionByName(_summed(by_session)).unionByName(_summed(_counted(days, "day"))).unionByName(_summed(_counted(chains, "chain"))).unionByName(repeated).unionByName(languages)
    figures = figures.unionByName(_shares(s, "tunnel-vision", "project", F.col("n_turns"))).unionByName(_shares(t.where("model <> ''"), "model-overreliance", "canonical", F.lit(1)))
    rules = x.sparkSession.createDataFrame([(r.name, r.group, r.severity) for r in RULES], "rule string, group string, severity string")
    full = t.select("period").distinct().crossJoin(F.broadcast(rules)).join(figures, ["period", "rule"], "left")  # 28 rules
    if examples:
        order = (F.col("opened").asc_nulls_first(), F.col("turn").asc())
        files = chains.where("retries > 0").groupBy("period", F.col("file").alias("text")).agg(F.sum("retries").alias("n")).select("period", F.lit("retry-loops").alias("rule"), "text", F.concat("n", F.lit(" shell-verified re-edits")).alias("detail"), "n")
        same = groups.select("period", F.lit("repeated-prompts").alias("rule"), "text", F.concat(F.lit("repeated "), "n", F.lit("x")).alias("detail"), "n", "key")
        shown = _first_examples(_early_hits(t, "turn", by_turn), *order).unionByName(_first_examples(_early_hits(s, "session", by_session), *order)).unionByName(_first_examples(files, F.desc("n"), F.asc("text"))).unionByName(_first_examples(same, F.desc("n"), F.asc("key")))
        full = full.join(shown, ["period", "rule"], "left")
    full = full.withColumns({"occurrences": F.coalesce("occurrences", F.lit(0)).cast("long"), "total": F.coalesce("total", F.lit(0)).cast("long")})

    def of_rule(pick) -> Column:
        out = F.when(F.lit(False), F.lit(None))
        for r in RULES:
            out = out.when(F.col("rule") == r.name, F.expr(pick(r)))
        return out

    fires = F.coalesce(of_rule(lambda r: r.fires), F.lit(False))
    full = full.withColumn("fires", fires).withColumn("escalate", F.col("fires") & F.coalesce(of_rule(lambda r: r.escalate), F.lit(False)))
    pct = F.round(of_rule(lambda r: f"CAST({r.pct} AS DOUBLE)") * 100).cast("long")
    effective = F.when(F.col("escalate"), "high").otherwise(F.col("severity"))
    fired = lambda c: F.when(F.col("fires"), c)
    return full.select("period", "rule", "group", "severity", effective.alias("effective"), "fires", "occurrences", "total", fired(pct).alias("pct"), fired(of_rule(lambda r: f"CAST({r.stat} AS STRING)")).alias("stat"), "escalate", *([fired(F.col("examples")).alias("examples")] if examples else []))


def _penalty(severity: str = "effective") -> Column:
    return F.when(F.col(severity) == "high", 12).when(F.col(severity) == "medium", 7).otherwise(3)


def group_scores(found: DataFrame) -> DataFrame:
    """By period and group, the score, the rules that fired and the worst of them (of equals the one listed last)."""
    place = F.array_position(F.array(*[F.lit(r.name) for r in RULES]), F.col("rule"))
    lost = F.coalesce(F.sum(F.when(F.col("fires"), _penalty())), F.lit(0))
    top = F.max_by(F.when(F.col("fires"), F.col("rule")), F.when(F.col("fires"), F.struct(_penalty(), place)))
    return found.groupBy("period", "group").agg(F.greatest(F.round(100.0 * (1 - lost / (F.count("*") * 12.0))), F.lit(0.0)).cast("long").alias("score"), F.count_if("fires").alias("triggered"), F.count("*").alias("total_rules"), top.alias("top_rule"))


def grade(score: Column) -> Column:
    """C16."""
    out = F.when(score >= 97, "a_plus")
    for least, name in ((90, "a"), (85, "b_plus"), (80, "b"), (70, "c"), (60, "d")):
        out = out.when(score >= least, name)
    return out.otherwise("f")


def composite(scores: DataFrame) -> DataFrame:
    """The mean of the groups' scores by their number of rules, and its grade."""
    mean = F.round(F.sum(F.col("score") * F.col("total_rules")) / F.sum("total_rules")).cast("long")
    return scores.groupBy("period").agg(mean.alias("score")).withColumn("grade", grade(F.col("score")))


def week_of(ts: Column) -> Column:
    """ISO year times 53 plus ISO week, as a string that sorts by time."""
    return (F.extract(F.lit("YEAROFWEEK"), ts) * 53 + F.weekofyear(ts)).cast("long").cast("string")


def trends(weekly: DataFrame, weeks: int = 12) -> DataFrame:
    """Each group's last weeks (oldest first), and the change of the last week on the one before, and of the last four on the four before."""
    back = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("period")))
    last = weekly.withColumn("back", back).where(F.col("back") <= max(weeks, 8))
    mean = lambda lo, hi: F.avg(F.when(F.col("back").between(lo, hi), F.col("score")))
    change = lambda now, then: F.when(then > 0, F.round((now - then) / then * 100.0).cast("long"))
    ordered = F.sort_array(F.collect_list(F.when(F.col("back") <= weeks, F.struct("period", "score"))))["score"]
    n = F.max("back")
    return last.groupBy("group").agg(F.when(n >= 2, change(mean(1, 1), mean(2, 2))).alias("wow_pct"), F.when(n >= 8, change(mean(1, 4), mean(5, 8))).alias("mom_pct"), F.array_join(F.transform(ordered, lambda v: v.cast("string")), ",").alias("trend"))


def findings(found: DataFrame) -> DataFrame:
    """Rules that fired, the greatest effective penalty first, then the most occurrences."""
    place = F.row_number().over(Window.partitionBy("period").orderBy(F.desc(_penalty()), F.desc("occurrences"), "rule"))
    return found.where("fires").select("period", "rule", "effective", "occurrences", place.cast("long").alias("place"))


def flow_by_day(t: DataFrame, today: date) -> DataFrame:
    """By day, the mean flow score and label, sessions, and the longest and all minutes of work blocks of their spans (15 whole minutes apart or less)."""
    flow = plain_turns.session_flow(t.select("skey", "turn", F.col("start_at").alias("start"), F.col("end_at").alias("end"), F.col("elapsed").alias("elapsed_ms"))).where(F.col("day") <= F.lit(today))
    spans = t.where("start_at is not null").groupBy("skey").agg(F.min_by("start_at", "turn").alias("start"), F.max_by("end_at", "turn").alias("end"))
    rows = flow.join(spans, "skey").withColumn("sessions", F.lit(1))
    blocks = plain_turns.day_blocks(rows, "score", "sessions").withColumn("minutes", F.greatest(F.timestamp_diff("MINUTE", F.col("start"), F.col("end")), F.lit(0)))
    days = blocks.groupBy("day").agg(F.round(F.sum("score") / F.sum("sessions")).cast("long").alias("score"), F.sum("sessions").alias("sessions"), F.max("minutes").alias("longest_block"), F.sum("minutes").alias("active"))
    return days.withColumn("label", plain_turns.flow_label(F.col("score")))


def flow_summary(days: DataFrame) -> DataFrame:
    """Over flow_by_day, the mean score, deep and fragmented days and the mean of the longest blocks."""
    return days.agg(F.coalesce(F.round(F.sum("score") / F.count("*")), F.lit(0.0)).cast("long").alias("overall"), F.count_if(F.col("score") >= 70).alias("deep_days"), F.count_if(F.col("score") < 25).alias("fragmented_days"), F.coalesce(F.floor(F.sum("longest_block") / F.count("*")), F.lit(0)).cast("long").alias("mean_longest_block"))


# A long streak, shares of late and weekend turns that are heavy, and how much more the last weeks have if they rise.
STREAK_DAYS, LATE_SHARE, WEEKEND_SHARE, RISE = 14, 0.15, 0.25, 0.20


def pace(t: DataFrame, today: date) -> DataFrame:
    """Streaks of active days (the current one ends today or yesterday), late and weekend shares, alerts and the risk they make."""
    timed = t.where("start_at is not null").select("start_at", F.to_date("start_at").alias("day"), week_of(F.col("start_at")).cast("long").alias("week"))
    late, weekend = (F.hour("start_at") < 5) | (F.hour("start_at") >= 22), F.weekday("start_at") >= 5
    days = timed.groupBy("day", "week").agg(F.count("*").alias("turns"), F.count_if(late).alias("late"), F.count_if(weekend).alias("weekend"))  # a row for each day
    runs = days.withColumn("island", F.date_sub("day", F.row_number().over(Window.orderBy("day")))).groupBy("island").agg(F.max("day").alias("last"), F.count("*").alias("days"))
    until = F.lit(today).cast("date")
    streaks = runs.agg(F.coalesce(F.max("days"), F.lit(0)).alias("longest_streak"))
    # days after today neither end nor join the current streak
    past = days.where(F.col("day") <= until).withColumn("island", F.date_sub("day", F.row_number().over(Window.orderBy("day")))).groupBy("island").agg(F.max("day").alias("last"), F.count("*").alias("days"))
    current = past.agg(F.coalesce(F.max(F.when(F.col("last") >= F.date_sub(until, 1), F.col("days"))), F.lit(0)).alias("current_streak"))
    weeks = days.groupBy("week").agg(F.sum("late").alias("late"), F.sum("weekend").alias("weekend")).withColumn("back", F.row_number().over(Window.orderBy(F.desc("week"))))
    mean = lambda c, lo, hi: F.sum(F.when(F.col("back").between(lo, hi), F.col(c))) / 3.0
    rising = lambda c: F.coalesce((F.max("back") >= 6) & (mean(c, 4, 6) > 0) & (mean(c, 1, 3) > mean(c, 4, 6) * (1.0 + RISE)), F.lit(False))
    trend = weeks.agg(rising("late").alias("late_rising"), rising("weekend").alias("weekend_rising"))
    sums = days.agg(F.coalesce(F.sum("late") / F.sum("turns"), F.lit(0.0)).alias("late_share"), F.coalesce(F.sum("weekend") / F.sum("turns"), F.lit(0.0)).alias("weekend_share"))
    one = streaks.crossJoin(current).crossJoin(trend).crossJoin(sums)  # one row each
    long_streak = F.col("current_streak") >= STREAK_DAYS
    named = ((long_streak, "long_streak"), (F.col("late_rising"), "late_night_rising"), (F.col("weekend_rising"), "weekend_rising"), (F.col("late_share") > LATE_SHARE, "late_night_heavy"), (F.col("weekend_share") > WEEKEND_SHARE, "weekend_heavy"))
    alerts = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in named]))
    risk = F.when((F.size("alerts") >= 3) | (long_streak & F.col("late_rising")), "high").when(F.size("alerts") > 0, "medium").otherwise("low")
    pct = lambda c: F.round(F.col(c) * 100.0).cast("long")
    return one.withColumn("alerts", alerts).select("current_streak", "longest_streak", pct("late_share").alias("late_pct"), pct("weekend_share").alias("weekend_pct"), F.array_join("alerts", ",").alias("alerts"), risk.alias("risk"))
