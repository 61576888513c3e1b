"""Queries of the practice rules, scores, flow and pace, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lookups, practice
from ..operators.practice import RULES
from ..sources import driver_tables as tables
from ..sources.driver_tables import PRACTICE_SQL


def practice_view(x: DataFrame, now) -> DataFrame:
    return lookups.output_rates(tables.practice_calls(x), lookups.price_book(x.sparkSession), now.date())


def _value(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"


def _in(tools) -> str:
    return "(" + ", ".join(f"'{t}'" for t in tools) + ")"


def turns_sql(signals_sql: str, period: str, now) -> str:
    """CTEs up to pt (turns) and ps (sessions)."""
    book = ", ".join("(" + ", ".join(map(_value, (p[0], p[1], p[2], p[4]))) + ")" for p in lookups.PRICES)
    return f"""
, {PRACTICE_SQL},
rate AS (SELECT tool, canonical, coalesce((SELECT b.o FROM (VALUES {book}) AS b(scope, key, since, o) WHERE (b.scope IS NULL OR b.scope = k.tool) AND starts_with(k.canonical, b.key) AND (b.since IS NULL OR b.since::DATE <= DATE '{now.date()}')
  ORDER BY b.scope IS NOT NULL DESC, b.key = k.canonical DESC, length(b.key) DESC, b.since::DATE DESC NULLS LAST LIMIT 1), {lookups.FALLBACK[1]}::DOUBLE) AS output_rate FROM (SELECT DISTINCT tool, canonical FROM pc) AS k),
q0 AS (SELECT pc.*, output_rate, {period} || '|' || coalesce(session_key, pc.tool || ':' || project) AS skey, timestamp_quality = 'exact' AS exact FROM pc JOIN rate USING (tool, canonical)),
q1 AS (SELECT *, row_number() OVER w AS nth, CASE WHEN row_number() OVER w > 1 AND lag(user_message) OVER w IS NOT DISTINCT FROM user_message AND lag(prompt_chars) OVER w IS NOT DISTINCT FROM prompt_chars THEN 0 ELSE 1 END AS new FROM q0 WINDOW w AS (PARTITION BY skey ORDER BY timestamp NULLS FIRST, seq)),
q2 AS (SELECT *, sum(new) OVER (PARTITION BY skey ORDER BY nth ROWS UNBOUNDED PRECEDING)::BIGINT AS turn FROM q1),
o0 AS (SELECT skey, arg_min(timestamp, nth) AS opened_at, arg_min(seq, nth) AS opened_seq FROM q2 GROUP BY skey),
t0 AS (SELECT skey, turn, arg_min(tool, nth) AS tool, arg_min(project, nth) AS project, arg_min(model, nth) AS model, arg_min(canonical, nth) AS canonical, arg_min(output_rate, nth) AS output_rate, any_value(user_message) AS message, max(prompt_chars) AS chars,
  min(timestamp) FILTER (exact) AS start_at, max(timestamp) FILTER (exact) AS end_at, max(elapsed_ms) FILTER (exact) AS elapsed, sum(output_tokens)::BIGINT AS output_tokens, sum(input_tokens + cache_read_tokens + cache_write_tokens)::BIGINT AS full_prompt,
  sum(cache_read_tokens)::BIGINT AS cache_read, coalesce(sum(loc), 0)::BIGINT AS loc, list_distinct(list(language) FILTER (language IS NOT NULL)) AS languages, sum(len(tools))::BIGINT AS tool_calls, list_distinct(flatten(list(tools))) AS tool_names,
  sum(len(edited_files))::BIGINT AS edited, sum(len(referenced_files))::BIGINT AS referenced, bool_or(is_canceled) AS canceled FROM q2 GROUP BY skey, turn),
pt AS (SELECT *, "constraint" AS constrained, split_part(skey, '|', 1) AS period, ((epoch_us(lead(start_at) OVER w) - epoch_us(end_at)) // 1000 - coalesce(lead(elapsed) OVER w, 0))::BIGINT AS gap, coalesce(chars, 0) > 0 AND message <> '' AS prompted,
  coalesce(length(regexp_replace(left(message, 2000), '[^A-Z]', '', 'g')) / nullif(length(regexp_replace(left(message, 2000), '[^A-Za-z]', '', 'g')), 0), 0) AS caps, hour(start_at) AS start_hour, isodow(start_at) >= 6 AS on_weekend,
  replace(list_filter(regexp_split_to_array(lower(model), '[-:]'), lambda p: p IN ('low', 'medium', 'high', 'xhigh', 'max'))[-1], 'xhigh', 'max') AS effort, output_rate >= {practice.PREMIUM_RATE} AS premium,
  tool IN {_in(practice.CANCELS)} AS has_cancel, tool IN {_in(practice.FILE_REFS)} AS has_file_refs, tool IN {_in(practice.CACHE_READS)} AS has_cache_reads, tool IN {_in(practice.CONVERSATIONS)} AS conversational
  FROM (SELECT *, {signals_sql} FROM t0) JOIN o0 USING (skey) WINDOW w AS (PARTITION BY skey ORDER BY turn)),
ps AS (SELECT period, skey, any_value(opened_at) AS opened_at, any_value(opened_seq) AS opened_seq, 0::BIGINT AS turn, count(*) AS n_turns, sum(loc)::BIGINT AS loc, count(DISTINCT work_type) FILTER (message <> '') AS kinds, bool_or(turn > 1 AND (edited > 0 OR message <> '' AND refinement)) AS refined,
  arg_min(project, turn) AS project, arg_min(conversational, turn) AS conversational, arg_min(message, turn) AS first_message, arg_min(message, turn) FILTER (message <> '') AS opening, arg_min(spec, turn) FILTER (message <> '') AS opening_spec, len(list_distinct(flatten(list(tool_names))))::BIGINT AS distinct_tools FROM pt GROUP BY period, skey),
f0 AS (SELECT skey, turn, start_at, end_at, (epoch_us(lead(start_at) OVER w) - epoch_us(end_at)) // 1000 - coalesce(lead(elapsed) OVER w, 0) AS gap FROM pt WHERE start_at IS NOT NULL WINDOW w AS (PARTITION BY skey ORDER BY turn)),
f1 AS (SELECT skey, count(*)::BIGINT AS n, list(gap ORDER BY gap) FILTER (gap >= 0) AS gaps, arg_min(start_at, turn) AS start_at, arg_max(end_at, turn) AS end_at FROM f0 GROUP BY skey),
f2 AS (SELECT *, (epoch_us(end_at) - epoch_us(start_at)) // 60000000 AS minutes, gaps[len(gaps) // 2 + 1] // 1000 AS median, len(list_filter(gaps, lambda v: v <= 30000)) / len(gaps) AS rapid FROM f1 WHERE n >= 3 AND len(gaps) > 0),
flow AS (SELECT skey, start_at::DATE AS day, start_at, end_at, least(greatest(round(round(0.40::DOUBLE * rapid * 100 + 0.30::DOUBLE * CASE WHEN median <= 10 THEN 100 WHEN median <= 30 THEN 80 WHEN median <= 60 THEN 60 WHEN median <= 120 THEN 40 WHEN median <= 300 THEN 20 ELSE 0 END
  + 0.15::DOUBLE * CASE WHEN minutes <= 5 THEN 20 WHEN minutes <= 15 THEN 50 WHEN minutes <= 40 THEN 90 WHEN minutes <= 90 THEN 80 ELSE 60 END + 0.15::DOUBLE * least(CASE WHEN minutes > 0 THEN n / minutes ELSE n END * 50, 100), 6)), 0), 100)::BIGINT AS score FROM f2)
"""


def outcomes_sql() -> str:
    """CTEs up to outcome, after turns_sql."""
    sources = {"turn": "pt", "session": "ps", "day": "fd", "chain": "rc"}
    found = []
    for r in RULES:
        if r.source in sources:
            example = f"CASE WHEN {r.hit} THEN {r.text} END"
            shown = example if r.blank else f"nullif({example}, '')"
            place = "opened_at, opened_seq, turn" if r.source in ("turn", "session") else "NULL::TIMESTAMP, 0, 0"
            found.append(f"SELECT period, '{r.name}', coalesce({r.hit}, false), ({r.value})::BIGINT, ({r.more})::BIGINT, {shown}, {r.detail}, {place} FROM {sources[r.source]} WHERE {r.member}")
    case = lambda pick: "CASE rule " + " ".join(f"WHEN '{r.name}' THEN {pick(r)}" for r in RULES) + " END"
    cases = lambda pick: "CASE " + " ".join(f"WHEN rule = '{r.name}' THEN {pick(r)}" for r in RULES) + " END"
    rules = ", ".join(f"('{r.name}', '{r.group}', '{r.severity}', {i})" for i, r in enumerate(RULES))
    return f"""
, fd AS (SELECT period, round(avg(score))::BIGINT AS score FROM (SELECT split_part(skey, '|', 1) AS period, day, score FROM flow) GROUP BY period, day),
ed AS (SELECT skey, nth, unnest(list_distinct(edited_files)) AS file, runs FROM (SELECT *, first_value(tool) OVER w AS session_tool, coalesce(sum((len(commands) > 0)::INT) OVER (PARTITION BY skey ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS runs FROM q2 WINDOW w AS (PARTITION BY skey ORDER BY nth)) WHERE session_tool IN {_in(practice.FILE_REFS)}),
rc AS (SELECT split_part(skey, '|', 1) AS period, skey, file, count(*) AS edits, count(*) FILTER (again) AS retries FROM (SELECT *, coalesce(runs > lag(runs) OVER (PARTITION BY skey, file ORDER BY nth), false) AS again FROM ed) GROUP BY skey, file),
found(period, rule, hit, value, more, text, detail, opened_at, opened_seq, turn) AS ({' UNION ALL '.join(found)}),
rep AS (SELECT period, key, count(*) AS n, arg_min(message, (coalesce(opened_at, TIMESTAMP '0001-01-01'), opened_seq, turn)) AS text FROM (SELECT *, trim(lower(left(message, 100)), ' ') AS key FROM pt WHERE prompted) WHERE length(key) >= 10 GROUP BY period, key HAVING count(*) >= 3),
lw AS (SELECT period, isoyear(start_at) * 53 + week(start_at) AS week, unnest(languages) AS language FROM pt WHERE start_at IS NOT NULL AND len(languages) > 0),
figure AS (
  SELECT period, rule, count(*) FILTER (hit) AS occurrences, count(*) AS total, max(value) AS best, sum(value) FILTER (hit) AS sum_value, sum(more) FILTER (hit) AS sum_more, sum(value) AS sum_all, NULL::VARCHAR AS top_name FROM found GROUP BY period, rule
  UNION ALL SELECT period, 'repeated-prompts', sum(n), (SELECT count(*) FROM pt WHERE prompted AND pt.period = rep.period), count(*), NULL, NULL, NULL, NULL FROM rep GROUP BY period
  UNION ALL SELECT period, 'tunnel-vision', max(n), sum(n), count(*), NULL, NULL, NULL, max_by(project, (n, project)) FROM (SELECT period, project, sum(n_turns) AS n FROM ps GROUP BY period, project) GROUP BY period
  UNION ALL SELECT period, 'model-overreliance', max(n), sum(n), count(*), NULL, NULL, NULL, max_by(canonical, (n, canonical)) FROM (SELECT period, canonical, count(*) AS n FROM pt WHERE model <> '' GROUP BY period, canonical) GROUP BY period
  UNION ALL SELECT a.period, 'no-language-exploration', greatest(last - newest, 0), weeks, n, NULL, NULL, NULL, NULL FROM (SELECT period, max(week) AS last, count(DISTINCT week) AS weeks FROM lw GROUP BY period) AS a
    JOIN (SELECT period, max(w) AS newest, count(*) AS n FROM (SELECT period, language, min(week) AS w FROM lw WHERE language <> 'unknown' GROUP BY period, language) GROUP BY period) AS b USING (period)),
shown AS (SELECT period, rule, string_agg(left(trim(text, ' '), 120) || ' | ' || detail, chr(10) ORDER BY place) AS examples FROM (
  SELECT period, rule, text, detail, row_number() OVER (PARTITION BY period, rule ORDER BY opened_at NULLS FIRST, opened_seq, turn) AS place FROM found WHERE hit AND text IS NOT NULL AND rule NOT IN ('broken-flow-state', 'retry-loops')
  UNION ALL SELECT period, 'retry-loops', file, n || ' shell-verified re-edits', row_number() OVER (PARTITION BY period ORDER BY n DESC, file) FROM (SELECT period, file, sum(retries) AS n FROM rc WHERE retries > 0 GROUP BY period, file)
  UNION ALL SELECT period, 'repeated-prompts', text, 'repeated ' || n || 'x', row_number() OVER (PARTITION BY period ORDER BY n DESC, key) FROM rep) WHERE place <= {practice.EXAMPLES} GROUP BY period, rule),
full0 AS (SELECT p.period, r.*, coalesce(occurrences, 0)::BIGINT AS occurrences, coalesce(total, 0)::BIGINT AS total, best, sum_value, sum_more, sum_all, top_name, examples
  FROM (SELECT DISTINCT period FROM pt) AS p CROSS JOIN (VALUES {rules}) AS r(rule, "group", severity, listed) LEFT JOIN figure USING (period, rule) LEFT JOIN shown USING (period, rule)),
full1 AS (SELECT *, coalesce({case(lambda r: f'({r.fires})')}, false) AS fires FROM full0),
full2 AS (SELECT *, fires AND coalesce({case(lambda r: f'({r.escalate})')}, false) AS escalate FROM full1),
outcome AS (SELECT period, rule, "group", severity, CASE WHEN escalate THEN 'high' ELSE severity END AS effective, fires, occurrences, total, CASE WHEN fires THEN round(({cases(lambda r: f'({r.pct})::DOUBLE')}) * 100)::BIGINT END AS pct,
  CASE WHEN fires THEN {cases(lambda r: f'({r.stat})::VARCHAR')} END AS stat, escalate, CASE WHEN fires THEN examples END AS examples, listed, CASE WHEN escalate OR severity = 'high' THEN 12 WHEN severity = 'medium' THEN 7 ELSE 3 END AS penalty FROM full2),
gscore AS (SELECT period, "group", greatest(round(100.0::DOUBLE * (1 - coalesce(sum(penalty) FILTER (fires), 0) / (count(*) * 12.0::DOUBLE))), 0)::BIGINT AS score, count(*) FILTER (fires)::BIGINT AS triggered, count(*)::BIGINT AS total_rules, arg_max(rule, penalty * 100 + listed) FILTER (fires) AS top_rule FROM outcome GROUP BY period, "group")
"""


def register(over_calls, signals_sql, now) -> None:
    """The queries; over_calls(name, build, sql) files one over the enriched calls."""
    whole, weekly = turns_sql(signals_sql("message"), "'all'", now) + outcomes_sql(), turns_sql(signals_sql("message"), "(isoyear(timestamp) * 53 + week(timestamp))", now).replace("FROM pc JOIN rate USING (tool, canonical))", "FROM pc JOIN rate USING (tool, canonical) WHERE timestamp_quality = 'exact')") + outcomes_sql()
    columns = 'period, rule, "group", severity, effective, fires, occurrences, total, pct, stat, escalate, examples'
    by_week = lambda x: practice.outcomes(practice_view(x, now).where("timestamp_quality = 'exact' and timestamp is not null"), practice.week_of(F.col("timestamp")), examples=False)
    plain = lambda x: practice.outcomes(practice_view(x, now), examples=False)
    over_calls("R01_rule_outcomes", lambda x: practice.outcomes(practice_view(x, now)), whole + f"SELECT {columns} FROM outcome")
    over_calls("R31_findings", lambda x: practice.findings(plain(x)), whole + """
SELECT period, rule, effective, occurrences, row_number() OVER (PARTITION BY period ORDER BY penalty DESC, occurrences DESC, rule)::BIGINT AS place FROM outcome WHERE fires""")
    over_calls("C15_group_scores", lambda x: practice.group_scores(plain(x)), whole + "SELECT * FROM gscore")
    over_calls("C16_composite", lambda x: practice.composite(practice.group_scores(plain(x))), whole + """
SELECT period, score, CASE WHEN score >= 97 THEN 'a_plus' WHEN score >= 90 THEN 'a' WHEN score >= 85 THEN 'b_plus' WHEN score >= 80 THEN 'b' WHEN score >= 70 THEN 'c' WHEN score >= 60 THEN 'd' ELSE 'f' END AS grade
FROM (SELECT period, round(sum(score * total_rules) / sum(total_rules))::BIGINT AS score FROM gscore GROUP BY period)""")
    over_calls("C14_weekly_groups", lambda x: practice.group_scores(by_week(x)), weekly + "SELECT * FROM gscore")
    over_calls("C15_trends", lambda x: practice.trends(practice.group_scores(by_week(x))), weekly + """
, b AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY period DESC) AS back FROM gscore),
m AS (SELECT "group", count(*) AS n, avg(score) FILTER (back = 1) AS a, avg(score) FILTER (back = 2) AS b, avg(score) FILTER (back <= 4) AS c, avg(score) FILTER (back BETWEEN 5 AND 8) AS d, string_agg(score::VARCHAR, ',' ORDER BY period) FILTER (back <= 12) AS trend FROM b GROUP BY "group")
SELECT "group", CASE WHEN n >= 2 AND b > 0 THEN round((a - b) / b * 100)::BIGINT END AS wow_pct, CASE WHEN n >= 8 AND d > 0 THEN round((c - d) / d * 100)::BIGINT END AS mom_pct, trend FROM m""")
    by_day = turns_sql(signals_sql("message"), "'all'", now) + f"""
, g AS (SELECT *, max(end_at) OVER (PARTITION BY day ORDER BY start_at, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM flow WHERE day <= DATE '{now.date()}'),
h AS (SELECT *, sum(CASE WHEN (epoch_us(start_at) - epoch_us(before)) / 60000000 < 16 THEN 0 ELSE 1 END) OVER (PARTITION BY day ORDER BY start_at, skey ROWS UNBOUNDED PRECEDING) AS block FROM g),
k AS (SELECT day, block, greatest((epoch_us(max(end_at)) - epoch_us(min(start_at))) // 60000000, 0) AS minutes, sum(score) AS score, count(*) AS sessions FROM h GROUP BY day, block),
d AS (SELECT day, round(sum(score) / sum(sessions))::BIGINT AS score, sum(sessions)::BIGINT AS sessions, max(minutes)::BIGINT AS longest_block, sum(minutes)::BIGINT AS active FROM k GROUP BY day)
"""
    days = lambda x: practice.flow_by_day(practice.practice_turns(practice_view(x, now)), now.date())
    over_calls("C05_flow_by_day", days, by_day + "SELECT *, CASE WHEN score >= 70 THEN 'deep' WHEN score >= 45 THEN 'moderate' WHEN score >= 25 THEN 'shallow' ELSE 'fragmented' END AS label FROM d")
    over_calls("C06_flow_summary", lambda x: practice.flow_summary(days(x)), by_day + """
SELECT coalesce(round(sum(score) / count(*)), 0)::BIGINT AS overall, count(*) FILTER (score >= 70)::BIGINT AS deep_days, count(*) FILTER (score < 25)::BIGINT AS fragmented_days, coalesce(sum(longest_block) // count(*), 0)::BIGINT AS mean_longest_block FROM d""")
    over_calls("C07_pace", lambda x: practice.pace(practice.practice_turns(practice_view(x, now)), now.date()), turns_sql(signals_sql("message"), "'all'", now) + f"""
, td AS (SELECT start_at::DATE AS day, isoyear(start_at) * 53 + week(start_at) AS week, (hour(start_at) < 5 OR hour(start_at) >= 22)::INT AS late, (isodow(start_at) >= 6)::INT AS weekend FROM pt WHERE start_at IS NOT NULL),
ad AS (SELECT DISTINCT day FROM td), s1 AS (SELECT max(n) AS longest FROM (SELECT count(*) AS n FROM (SELECT day - row_number() OVER (ORDER BY day)::INT AS island FROM ad) GROUP BY island)),
s2 AS (SELECT coalesce(max(n) FILTER (last >= DATE '{now.date()}' - 1), 0) AS current FROM (SELECT count(*) AS n, max(day) AS last FROM (SELECT day, day - row_number() OVER (ORDER BY day)::INT AS island FROM ad WHERE day <= DATE '{now.date()}') GROUP BY island)),
wk AS (SELECT *, row_number() OVER (ORDER BY week DESC) AS back FROM (SELECT week, sum(late) AS late, sum(weekend) AS weekend FROM td GROUP BY week)),
tr AS (SELECT max(back) >= 6 AND sum(late) FILTER (back BETWEEN 4 AND 6) > 0 AND sum(late) FILTER (back <= 3) / 3.0::DOUBLE > sum(late) FILTER (back BETWEEN 4 AND 6) / 3.0::DOUBLE * 1.2::DOUBLE AS lr,
  max(back) >= 6 AND sum(weekend) FILTER (back BETWEEN 4 AND 6) > 0 AND sum(weekend) FILTER (back <= 3) / 3.0::DOUBLE > sum(weekend) FILTER (back BETWEEN 4 AND 6) / 3.0::DOUBLE * 1.2::DOUBLE AS wr FROM wk),
sh AS (SELECT avg(late) AS ls, avg(weekend) AS ws FROM td),
al AS (SELECT *, list_filter([CASE WHEN current >= {practice.STREAK_DAYS} THEN 'long_streak' END, CASE WHEN lr THEN 'late_night_rising' END, CASE WHEN wr THEN 'weekend_rising' END, CASE WHEN ls > {practice.LATE_SHARE} THEN 'late_night_heavy' END, CASE WHEN ws > {practice.WEEKEND_SHARE} THEN 'weekend_heavy' END], lambda a: a IS NOT NULL) AS a FROM s1, s2, tr, sh)
SELECT current::BIGINT AS current_streak, longest::BIGINT AS longest_streak, round(ls * 100)::BIGINT AS late_pct, round(ws * 100)::BIGINT AS weekend_pct, array_to_string(a, ',') AS alerts, CASE WHEN len(a) >= 3 OR current >= {practice.STREAK_DAYS} AND lr THEN 'high' WHEN len(a) > 0 THEN 'medium' ELSE 'low' END AS risk FROM al""")
