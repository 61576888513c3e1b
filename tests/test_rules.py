"""Rules over hand-made turns."""

import datetime as dt

from pyspark.sql import functions as F

from loomline.functions.texts import caps_word_ratio, has_phrase, phrase_pattern
from loomline.operators import lookups, practice, prompt_rules
from loomline.plans import catalog

AT = dt.datetime(2026, 1, 1)


def test_a_retry_needs_a_shell_run_between_edits(spark):
    rows = [("s", AT + dt.timedelta(minutes=i), i, commands, files) for i, (commands, files) in enumerate([([], ["a", "b"]), ([], ["a"]), (["ls"], ["b"]), ([], ["a"]), (["ls"], []), ([], ["b"])])]
    x = spark.createDataFrame(rows, "session_key string, timestamp timestamp_ntz, seq long, commands array<string>, edited_files array<string>")
    assert {r.file: (r.edits, r.retries) for r in prompt_rules.retry_chains(x).collect()} == {"a": (3, 1), "b": (3, 1)}
    assert prompt_rules.retry_rule(x).first().fires is False and prompt_rules.retry_rule(x.limit(0)).first().total == 0


def test_signals_of_odd_texts(spark):
    texts = [None, "", "WTF is THIS", "why won't it", "1) do this", "a\nb\nc\nd\n", "The mustard", "You must not", "what is x", "please, thank you kindly"]
    got = [r for r in prompt_rules.signals(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()]
    assert [r.frustrated for r in got][:4] == [False, False, True, True] and [r.spec for r in got][4:8] == [True, True, False, True]
    assert [r.constraint for r in got][6:8] == [False, True] and got[8].lookup and got[9].fillers == 3 and got[0].work_type == "feature" and got[2].caps_words == 1.0


def test_phrases_are_sought_before_their_neighbours_are_judged(spark):
    edges = ["", " ", "\n", "x", "'", "_", "7", "-", "é", "\U0001f600", "\r\n", "every "]
    phrases = ("very", "ui", "come on", "doesn't work")
    texts = spark.createDataFrame([(a + p + b,) for a in edges for b in edges for p in (*phrases, "come  on", "very very", "xvery very")], "text string")
    whole = {p: F.col("text").rlike(phrase_pattern([p])) for p in phrases}
    one = texts.select(*[(has_phrase(F.col("text"), [p]) == whole[p]).alias(p) for p in phrases], (has_phrase(F.col("text"), phrases) == F.col("text").rlike(phrase_pattern(phrases))).alias("any"))
    assert one.distinct().collect() == [(True,) * 5]
    # a pattern that opens with a class is tried at every character of every text, 24 times over
    plan = prompt_rules.signals(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "(^|[^a-z0-9'_])" not in plan and plan.lower().count("lower(") == 3


def test_examples_are_the_first_of_all_hours(spark, monkeypatch):
    rules = (
        practice.Rule("often", "g", "low", "turn", "true", "kept", "n % 2 = 0", "n", text="message", detail="concat(n, '')"),
        practice.Rule("rare", "g", "low", "turn", "true", hit="n in (40, 95)", text="message"),
        practice.Rule("never", "g", "low", "turn", "true", hit="n < 0", text="message"),
        practice.Rule("empty", "g", "low", "turn", "true", hit="n < 30", text="''", blank=True),
    )
    monkeypatch.setattr(practice, "RULES", rules)
    rows = [("p" if n % 3 else "q", (None if n >= 90 else AT - dt.timedelta(minutes=25 * n), n), n % 4, f"m{n}" if n % 5 else "", n, n % 7 > 0) for n in range(100)]
    t = spark.createDataFrame(rows, "period string, opened struct<timestamp:timestamp_ntz,seq:long>, turn long, message string, n long, kept boolean").repartition(5)
    counted = practice._counted(t, "turn")
    figures = {(r.period, r.rule): (r.occurrences, r.total, r.best, r.sum_value, r.sum_all) for r in practice._summed(counted).collect()}
    examples = {(r.period, r.rule): r.examples for r in practice._first_examples(practice._early_hits(t, "turn", counted), F.col("opened").asc_nulls_first(), F.col("turn").asc()).collect()}
    for period in "pq":
        of = sorted((r for r in rows if r[0] == period), key=lambda r: (r[1][0] or dt.datetime.min, r[1][1]))
        kept = [r[4] for r in of if r[5]]
        even = [n for n in kept if n % 2 == 0]
        assert figures[period, "often"] == (len(even), len(kept), max(kept), sum(even), sum(kept)) and figures[period, "never"] == (0, len(of), 0, None, 0)
        assert examples[period, "often"] == "\n".join(f"m{n} | {n}" for n in [n for n in even if n % 5][:3])
        assert examples.get((period, "rare")) is None and (period, "never") not in examples and examples[period, "empty"] == "\n".join([" | "] * 3)
    early = practice._early_hits(t, "turn", counted)
    assert early.count() < t.where("kept and n % 2 = 0 and message <> ''").count()
    assert "Generate" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_rates_of_few_models_do_not_sort_the_calls(spark):
    calls = spark.range(10_000_000).select("id", F.concat(F.lit("t"), F.col("id") % 5).alias("tool"), F.lit("gpt-5").alias("canonical"))
    plan = lookups.output_rates(calls, lookups.price_book(spark), AT.date())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_capitals_are_read_without_splitting(spark):
    odd = ["", " ", "abc", "ABC", "ABC def", "A BC DEF", "AB1 12345 ÀÉÎ", "x" * 1999 + " ABC", "x" * 1996 + " ABCD", "WTF\nIS\tTHIS\x0bBUG\x0cNOW\rOK?", " FIX  This ", "\U0001f600\U0001f600A b", "AB\u00a0CD EFG", "ABc DEF ---", "- a", "a\n  2) b", "a\n\n\nb", "a\n\n\n", "a\r\n# b", "\t* b", "a - b"]
    rows = spark.createDataFrame([(t,) for t in odd], "text string").repartition(1)
    t = F.col("text")
    words = F.filter(F.split(F.left(t, F.lit(2000)), r"\s+"), lambda w: F.length(w) >= 3)
    loud = F.filter(words, lambda w: w.rlike("[A-Z]") & ~w.rlike("[a-z]"))
    got = rows.select("text", caps_word_ratio(t).alias("caps"), F.coalesce(F.try_divide(F.size(loud), F.size(words)), F.lit(0.0)).alias("by_words")).collect()
    assert [(r.text, r.caps) for r in got] == [(r.text, r.by_words) for r in got] and len({r.caps for r in got}) == 4
    plan = prompt_rules.signals(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "lambdafunction" not in plan


def test_the_effort_is_the_last_part_that_names_one(spark):
    models = {None: None, "": None, "high": "high", "gpt-5-high": "high", "a:XHIGH": "max", "max-low-x": "low", "low\n-b": None, "a\nb-max": "max", "highest-x": None, "a--medium-": "medium", "max\n": None}
    rows = spark.createDataFrame([(m,) for m in models], "model string")
    assert {r.model: r.effort for r in rows.select("model", practice.effort(F.col("model")).alias("effort")).collect()} == models


def test_each_prompt_is_judged_once(spark, monkeypatch):
    judged, plain = [], practice.signals

    def counting(docs, text):
        judged.append(sorted(map(str, (r[0] for r in docs.select(text).collect()))))
        return plain(docs, text)

    kinds = "session_key string, timestamp timestamp_ntz, seq long, timestamp_quality string, tool string, project string, model string, canonical string, output_rate double, user_message string, prompt_chars long, elapsed_ms long, output_tokens long, input_tokens long, cache_read_tokens long, cache_write_tokens long, is_canceled boolean, code_blocks array<struct<language:string,loc:bigint>>, edited_files array<string>, referenced_files array<string>, tools array<string>"
    said = ["FIX the bug!!!", None, "continue", "", "continue", "FIX the bug!!!", None, "you must not"]
    x = spark.createDataFrame([(f"s{i % 2}", AT + dt.timedelta(minutes=i), i, "exact", "codex", "p", "gpt-5-high", "gpt-5", 1.0, m, None if m is None else len(m), 5, 1, 1, 1, 1, False, [], [], [], ["Read"]) for i, m in enumerate(said)], kinds)
    each = practice.practice_turns(x)
    monkeypatch.setattr(practice, "signals", counting)
    once = practice.practice_turns(x, once=True)
    assert judged == [["", "FIX the bug!!!", "None", "continue", "you must not"]]
    assert sorted(map(str, once.select(sorted(once.columns)).collect())) == sorted(map(str, each.select(sorted(each.columns)).collect())) and once.count() == 7


def _without_examples(spark, monkeypatch, name):
    def never(*_):
        raise AssertionError("examples are made")

    monkeypatch.setattr(practice, "_first_examples", never)
    monkeypatch.setattr(practice, "_early_hits", never)
    return catalog.QUERIES[name](spark, "/root/testdata/sf0.001")


def test_findings_make_no_examples(spark, monkeypatch):
    assert "examples" not in _without_examples(spark, monkeypatch, "R31_findings").columns


def test_group_scores_make_no_examples(spark, monkeypatch):
    assert "score" in _without_examples(spark, monkeypatch, "C15_group_scores").columns


def test_trends_make_no_examples(spark, monkeypatch):
    assert "trend" in _without_examples(spark, monkeypatch, "C15_trends").columns
