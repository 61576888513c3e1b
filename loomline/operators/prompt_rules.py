"""Practice rules over prompts and over what turns wrote (R), and weekly scores (C14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.columns import caps_letter_ratio
from . import turns

SIGNALS = ("constraint", "frustrated", "lookup", "refinement", "spec")


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """X11-X16 for each row of docs: flags, distinct fillers, share of words in capitals and the work type."""
    t = F.coalesce(F.col(text), F.lit(""))
    # lowered once, as columns of their own: every phrase reads them
    docs = docs.withColumns({"low": F.lower(t), "low_500": F.lower(F.left(t, F.lit(500))), "low_300": F.lower(F.left(t, F.lit(300)))})
    low = F.col("low")
    return docs.withColumns({
        "constraint": texts.has_constraint(F.col("low_500")), "frustrated": texts.is_frustrated(t, low), "lookup": texts.is_lookup(low), "refinement": texts.has_refinement(low), "spec": texts.looks_like_spec(t, low),
        "fillers": texts.phrase_hits(low, texts.FILLERS), "caps_words": F.round(texts.caps_word_ratio(t), 6), "work_type": texts.work_type(F.col("low_300")),
    }).drop("low", "low_500", "low_300")


def _n(condition: Column | str) -> Column:
    return F.coalesce(F.count_if(F.expr(condition) if isinstance(condition, str) else condition), F.lit(0)).cast("long")


def _rows(figures: DataFrame, rules: list[tuple[str, str, str, str, str]]) -> DataFrame:
    made = [F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.col(n).alias("occurrences"), F.col(t).alias("total"), F.expr(f).alias("fires")) for r, s, n, t, f in rules]
    return figures.select(F.explode(F.array(*made)).alias("r")).select("r.*")


def prompt_rules(prompts: DataFrame) -> DataFrame:
    """R01-R05, R07, R09 over rows of (session_id, user_text), one for each prompt."""
    p = signals(prompts.where("user_text <> ''"), "user_text").withColumn("chars", F.length("user_text")).withColumn("caps", F.coalesce(caps_letter_ratio(F.col("user_text")), F.lit(0.0)))
    of_prompts = p.agg(
        _n(F.lit(True)).alias("prompts"), _n("chars < 30").alias("lazy"), _n("chars >= 10 and caps >= 0.9").alias("caps"), _n("chars >= 10 and (frustrated or caps_words >= 0.4)").alias("frustrated"),
        _n("chars >= 40").alias("long"), _n("chars >= 40 and not `constraint`").alias("loose"), _n("chars >= 800 and fillers >= 2").alias("wordy"),
    )
    key = F.lower(F.trim(F.left("user_text", F.lit(100))))
    repeated = p.groupBy(key.alias("key")).count().where("length(key) >= 10 and count >= 3").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("repeated"))
    sessions = p.groupBy("session_id").agg(F.count("*").alias("n"), F.count_distinct("work_type").alias("types")).agg(_n("n >= 5 and types >= 4").alias("drifted"), _n(F.lit(True)).alias("sessions"))
    return _rows(of_prompts.crossJoin(repeated).crossJoin(sessions), [  # one row each
        ("lazy-prompting", "medium", "lazy", "prompts", "lazy > 10 and lazy > 0.3 * prompts"),
        ("caps-lock", "medium", "caps", "prompts", "caps >= 1"),
        ("frustration-signals", "medium", "frustrated", "prompts", "frustrated >= 2"),
        ("repeated-prompts", "medium", "repeated", "prompts", "repeated >= 3"),
        ("low-constraint-usage", "medium", "loose", "long", "long >= 30 and loose > 0.92 * long"),
        ("verbose-prompt", "low", "wordy", "prompts", "wordy > 15 and wordy > 0.2 * prompts"),
        ("session-drift", "medium", "drifted", "sessions", "drifted > 3"),
    ])


def output_rules(x: DataFrame) -> DataFrame:
    """R20, R22, R24, R25 over enriched calls: turns accepted at once, one project or model only, too many tools."""
    t = turns.turns(x)
    gaps = turns.think_gaps(t)
    order = Window.partitionBy("skey").orderBy(F.col("timestamp").asc_nulls_first(), "seq")
    rows = x.withColumn("skey", F.coalesce("session_key", F.concat_ws(":", "tool", "identity")))
    new = (~F.lag("prompt_chars").over(order).eqNullSafe(F.col("prompt_chars")) | F.lag("seq").over(order).isNull()).cast("long")
    rows = rows.withColumn("new", new).withColumn("turn", F.sum("new").over(order))
    loc = F.aggregate(F.transform("code_blocks", lambda b: b["loc"]), F.lit(0).cast("long"), lambda a, n: a + n)
    of_turn = rows.groupBy("skey", "turn").agg(F.sum(loc).alias("loc"), F.min_by("project", "seq").alias("project"), F.min_by("canonical", "seq").alias("canonical"))
    quick = of_turn.join(gaps, ["skey", "turn"], "left").agg(_n("loc >= 20 and gap_ms between 0 and 15000").alias("quick"), _n("loc >= 20").alias("written"), _n(F.lit(True)).alias("turns"))
    projects = of_turn.groupBy("project").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("top_project"), F.count("*").alias("projects"))
    models = of_turn.groupBy("canonical").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("top_model"), F.count("*").alias("models"))
    tools = rows.select("skey", F.explode_outer("tools").alias("name")).groupBy("skey").agg(F.count_distinct("name").alias("names")).agg(_n("names > 40").alias("bloated"), _n(F.lit(True)).alias("sessions"))
    return _rows(quick.crossJoin(projects).crossJoin(models).crossJoin(tools), [  # one row each
        ("speed-accept", "high", "quick", "written", "quick >= 5"),
        ("tunnel-vision", "low", "top_project", "turns", "top_project > 0.95 * turns and turns >= 50 and projects >= 3"),
        ("mcp-tool-bloat", "medium", "bloated", "sessions", "bloated >= 3"),
        ("model-overreliance", "medium", "top_model", "turns", "turns > 10 and models < 3 and top_model > 0.8 * turns"),
    ])


def retry_chains(x: DataFrame) -> DataFrame:
    """For each session and edited file (calls with edited_files), its edits and those that come after a shell run since the last edit."""
    order = Window.partitionBy("session_key").orderBy(F.col("timestamp").asc_nulls_first(), "seq")
    # edits of a call are judged before its own shell run
    rows = x.where("session_key is not null").withColumn("runs", F.coalesce(F.sum(F.when(F.size("commands") > 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edits = rows.select("session_key", "timestamp", "seq", "runs", F.explode(F.array_distinct("edited_files")).alias("file"))
    chain = Window.partitionBy("session_key", "file").orderBy(F.col("timestamp").asc_nulls_first(), "seq")
    edits = edits.withColumn("again", F.coalesce(F.col("runs") > F.lag("runs").over(chain), F.lit(False)))
    return edits.groupBy("session_key", "file").agg(F.count("*").alias("edits"), F.count_if("again").alias("retries"))


def retry_rule(x: DataFrame) -> DataFrame:
    """Chains that retried; at least 15 chains and 40 of 100."""
    return _rows(retry_chains(x).agg(_n("retries > 0").alias("retried"), _n(F.lit(True)).alias("chains")), [("retry-loops", "medium", "retried", "chains", "chains >= 15 and retried >= 0.4 * chains")])


def weekly_scores(x: DataFrame) -> DataFrame:
    """C14: by ISO week (year * 53 + week), the score of the rules over turns, sessions being split at week edges."""
    week = (F.extract(F.lit("YEAROFWEEK"), "timestamp") * 53 + F.weekofyear("timestamp")).cast("long")
    own = F.concat_ws("|", week, F.coalesce("session_key", F.concat_ws(":", "tool", "identity")))
    t = turns.turns(x.where("timestamp is not null").withColumn("session_key", own)).withColumn("week", F.substring_index("skey", "|", 1).cast("long"))
    return turns.score(turns.rules(t, "week"), "week")
