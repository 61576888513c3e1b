"""Queries of models, prices, costs, task categories, filters, sorts and limits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import categories, models
from ..functions.columns import bar_or_zero, day_bounds, heat_class, whole_scale
from ..operators import details, pricing
from ..sources import driver_tables as tables
from ..sources.driver_tables import DETAILED_SQL


def _text(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _number(v) -> str:
    return "NULL" if v is None else f"{v}::DOUBLE"


def _identified(x: DataFrame) -> DataFrame:
    found = models.identity(F.col("tool"), F.col("canonical"))
    return tables.detailed_calls(x).withColumn("m", found).select("*", "m.*").drop("m")


def _identity_sql() -> str:
    """A struct of canonical_id, display, provider and family from tool and canonical."""
    title = lambda w: f"(upper({w}[1]) || {w}[2:])"
    pretty = lambda k: f"array_to_string(list_transform(list_filter(string_split({k}, '-'), lambda p: p <> ''), lambda p: {title('p')}), ' ')"
    made = lambda d, p, f: f"{{'canonical_id': CASE WHEN canonical = '' THEN 'unknown' ELSE canonical END, 'display': {d}, 'provider': '{p}', 'family': {f}}}"
    first = lambda k, name: f"(CASE WHEN split_part({k}, '-', 1) = '' THEN '{name}' ELSE {title(f'split_part({k}, chr(45), 1)')} END)"
    more = f"list_transform(list_filter(string_split(canonical, '-')[3:], lambda p: p <> ''), lambda p: {title('p')})"
    cases = []
    for scope, whole, keys, canonical, display, provider, family in models.MODEL_RULES:
        fits = " OR ".join(f"canonical = {_text(k)}" if whole else f"starts_with(canonical, {_text(k)})" for k in keys)
        cases.append(f"WHEN ({fits}){f' AND tool = {_text(scope)}' if scope else ''} THEN {{'canonical_id': {_text(canonical or keys[0])}, 'display': {_text(display)}, 'provider': {_text(provider)}, 'family': {_text(family)}}}")
    major = "split_part(split_part(canonical, '-', 2), '.', 1)"
    cases.append("WHEN starts_with(canonical, 'gpt-') THEN " + made(f"'GPT-' || split_part(canonical, '-', 2) || CASE WHEN len({more}) > 0 THEN ' ' || array_to_string({more}, ' ') ELSE '' END", "openai", f"CASE WHEN {major} = '' THEN 'GPT' ELSE 'GPT-' || {major} END || CASE WHEN list_contains(string_split(canonical, '-'), 'codex') THEN ' Codex' ELSE '' END"))
    cases.append("WHEN starts_with(canonical, 'claude-') THEN " + made(pretty("canonical[8:]"), "anthropic", first("canonical[8:]", "Claude")))
    cases.append("WHEN starts_with(canonical, 'gemini-') THEN " + made(pretty("canonical"), "google", "'Gemini'"))
    unknown = made(f"CASE WHEN canonical = '' THEN 'Unknown' ELSE {pretty('canonical')} END", "other", first("canonical", "Other"))
    return f"CASE {' '.join(cases)} ELSE {unknown} END"


def _prices_sql(now) -> str:
    """CTEs up to priced: dc with the price of each call."""
    entries = ", ".join(f"({e[0]}, {_text(e[1])}, {_text(e[2])}, {_text(e[3])}, {', '.join(map(_number, e[4:]))})" for e in pricing.ENTRIES)
    named = ", ".join(f"({_text(s)}, {_text(m.lower())}, {_text(t)})" for s, m, t in pricing.ALIASES)
    return f""", {DETAILED_SQL},
raw AS (SELECT layer, scope::VARCHAR AS scope, key, since::DATE AS since, p_in, p_out, p_write, p_read, p_web, fast FROM (VALUES {entries}) AS t(layer, scope, key, since, p_in, p_out, p_write, p_read, p_web, fast)),
book AS (SELECT * EXCLUDE (layer, place) FROM (SELECT *, row_number() OVER (PARTITION BY scope, key, since ORDER BY layer DESC) AS place FROM raw) WHERE place = 1),
alias AS (SELECT scope::VARCHAR AS scope, model, target FROM (VALUES {named}) AS t(scope, model, target)),
k0 AS (SELECT DISTINCT tool, canonical, coalesce(timestamp::DATE, DATE '{now.date()}') AS day FROM dc),
k1 AS (SELECT *, coalesce((SELECT target FROM alias WHERE alias.scope = tool AND alias.model = canonical), canonical) AS named FROM k0),
k2 AS (SELECT *, coalesce((SELECT target FROM alias WHERE alias.scope IS NULL AND alias.model = named), named) AS wanted FROM k1),
own AS (SELECT * FROM (SELECT k2.*, book.*, row_number() OVER (PARTITION BY tool, canonical, day ORDER BY scope IS NOT NULL DESC, key = CASE WHEN scope IS NULL THEN wanted ELSE named END DESC, length(key) DESC, since DESC NULLS LAST) AS place
  FROM k2 JOIN book ON (scope = tool AND starts_with(named, key) OR scope IS NULL AND starts_with(wanted, key)) AND (since IS NULL OR since <= day)) WHERE place = 1),
spare AS (SELECT * FROM book WHERE scope IS NULL AND key = '{pricing.FALLBACK}'),
price AS (SELECT k2.tool, k2.canonical, k2.day, own.key IS NULL AS is_fallback, {', '.join(f'coalesce(own.{r}, spare.{r}) AS {r}' for r in pricing.RATES)}, CASE WHEN own.key IS NULL THEN spare.fast ELSE own.fast END AS fast FROM k2 LEFT JOIN own USING (tool, canonical, day), spare),
priced AS (SELECT dc.*, price.* EXCLUDE (tool, canonical) FROM dc JOIN price ON dc.tool = price.tool AND dc.canonical = price.canonical AND coalesce(timestamp::DATE, DATE '{now.date()}') = price.day)
"""


def _label(rate: str, of: str) -> str:
    pct = f"({rate} / {of} * 100)"
    return f"CASE WHEN {rate} <= 0 OR {of} <= 0 THEN '-' WHEN abs({pct} - round({pct})) < 0.05 THEN printf('%.0f%%', {pct}) ELSE printf('%.1f%%', {pct}) END"


def _category_sql() -> str:
    c = categories
    word = r"[^\p{L}\p{N}]"
    low = "lower(coalesce(user_message, ''))"

    def at(phrases) -> str:  # how much stands before the first hit; null: none
        pattern = f"^((?s:.)*?)(?:^|{word})(?:{'|'.join(phrases)})(?:{word}|$)"
        return f"CASE WHEN regexp_matches({low}, {_text(pattern)}) THEN length(regexp_extract({low}, {_text(pattern)}, 1)) END"

    has = lambda names: f"list_has_any(tools, [{', '.join(map(_text, names))}])"
    any_command = lambda pattern: f"len(list_filter(commands, lambda c: regexp_matches(lower(c), {_text(pattern)}))) > 0"
    bash, edits = f"({has(c.BASH_TOOLS)} OR len(commands) > 0)", has(c.EDIT_TOOLS)
    runs = any_command(f"(?:^|{word})(?:{'|'.join(c.TEST_RUNNERS)})(?:{word}|$)")
    opens = lambda phrases: any_command(f"^(?:{'|'.join(phrases)})(?:{word}|$)")
    coding = "CASE WHEN r IS NULL AND f IS NULL AND d IS NULL THEN 'coding' WHEN r <= coalesce(f, 1000000) AND r <= coalesce(d, 1000000) THEN 'refactoring' WHEN f <= coalesce(d, 1000000) THEN 'feature' ELSE 'debugging' END"
    talk = f"CASE WHEN trim({low}) = '' THEN 'conversation' WHEN b IS NOT NULL THEN 'brainstorming' WHEN s IS NOT NULL THEN 'exploration' WHEN f <= coalesce(d, 1000000) THEN 'feature' WHEN d IS NOT NULL THEN 'debugging' WHEN contains({low}, 'http://') OR contains({low}, 'https://') THEN 'exploration' ELSE 'conversation' END"
    return f"""
, ph AS (SELECT *, {at(c.REFACTOR)} AS r, {at(c.FEATURE)} AS f, {at(c.DEBUG)} AS d, {at(c.TEST)} AS t, {at(c.RESEARCH)} AS s, {at(c.BRAINSTORM)} AS b FROM dc),
cat AS (SELECT *, CASE WHEN len(tools) = 0 AND len(commands) = 0 THEN {talk} WHEN {has(c.PLAN_TOOLS)} THEN 'planning' WHEN {has(c.AGENT_TOOLS)} THEN 'delegation'
  WHEN {bash} AND NOT {edits} AND ({runs} OR t IS NOT NULL) THEN 'testing' WHEN {bash} AND NOT {edits} AND {opens(c.GIT)} THEN 'git' WHEN {bash} AND NOT {edits} AND {opens(c.BUILD)} THEN 'build_deploy'
  WHEN {edits} THEN {coding} WHEN {bash} AND {has(c.READ_TOOLS)} THEN 'exploration' WHEN {bash} THEN 'coding' WHEN {has(c.SEARCH_TOOLS)} OR len(list_filter(tools, lambda v: starts_with(v, 'mcp__'))) > 0 THEN 'exploration'
  WHEN {has(c.READ_TOOLS)} THEN CASE WHEN s IS NOT NULL THEN 'exploration' WHEN d IS NOT NULL THEN 'debugging' ELSE 'exploration' END WHEN {has(c.TASK_TOOLS)} THEN 'planning' ELSE 'general' END AS category FROM ph)
"""


def register(over_calls, over, now, latest_sql) -> None:
    """The queries; over_calls(name, build, sql) files one over the enriched calls, over(name, build, sql) one over tables."""
    today, bound = now.date(), f", {DETAILED_SQL}\n"
    book = lambda x: pricing.book(x.sparkSession)
    also = lambda x: pricing.aliases(x.sparkSession)
    priced = lambda x: pricing.lookup(tables.detailed_calls(x), book(x), also(x), today)
    identity = bound + f", id AS (SELECT *, unnest({_identity_sql()}) FROM dc)\n"
    over_calls("J01_model_identity", lambda x: _identified(x).groupBy("tool", "canonical", "canonical_id", "display", "provider", "family").agg(F.count("*").alias("calls")), identity + "SELECT tool, canonical, canonical_id, display, provider, family, count(*)::BIGINT AS calls FROM id GROUP BY ALL")
    over_calls("F06_one_model", lambda x: _identified(x).where("canonical_id = 'claude-opus-4-5'").select("seq", "tool"), identity + "SELECT seq, tool FROM id WHERE canonical_id = 'claude-opus-4-5'")
    over_calls("A14_model_rows", lambda x: details.model_rows(priced(_identified(x).drop("display", "provider", "family"))), _prices_sql(now) + f"""
, id AS (SELECT *, unnest({_identity_sql()}) FROM priced)
SELECT canonical_id, round(sum(cost), 6) AS cost, count(*)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens, round(coalesce(100.0::DOUBLE * sum(cache_read_tokens) / nullif(sum(input_tokens + cache_read_tokens + cache_write_tokens), 0), 0), 6) AS cache_pct,
  CASE WHEN count(DISTINCT {_label('p_read', 'p_in')}) > 1 THEN 'mixed' ELSE min({_label('p_read', 'p_in')}) END AS cache_read_rate FROM id GROUP BY canonical_id""")
    cost = "CASE WHEN speed = 'fast' AND fast IS NOT NULL THEN fast ELSE 1 END * ((input_tokens * p_in + output_tokens * p_out + cache_write_tokens * p_write + least(cache_1h_tokens, cache_write_tokens) * p_write * 0.6::DOUBLE + cache_read_tokens * p_read) / 1000000 + web_searches * p_web)"
    over_calls("J05_call_costs", lambda x: priced(x).select("seq", "is_fallback", F.round(pricing.cost(), 9).alias("priced_cost")), _prices_sql(now) + f"SELECT seq, is_fallback, round({cost}, 9) AS priced_cost FROM priced")
    over("J06_layered_book", lambda spark, d: pricing.book(spark).drop("layer"), "WITH raw AS" + _prices_sql(now).split("raw AS", 1)[1].split("alias AS", 1)[0].rstrip().rstrip(",") + " SELECT scope, key, since AS effective_from, p_in, p_out, p_write, p_read, p_web, fast FROM book")
    over_calls("J07_rate_labels", lambda x: priced(x).select("seq", pricing.rate_label(F.col("price.p_read"), F.col("price.p_in")).alias("cache_read"), pricing.rate_label(F.col("price.p_write"), F.col("price.p_in")).alias("cache_write")), _prices_sql(now) + f"SELECT seq, {_label('p_read', 'p_in')} AS cache_read, {_label('p_write', 'p_in')} AS cache_write FROM priced")
    rates = {"input_price": "p_in", "output_price": "p_out", "cache_read_price": "p_read", "cache_write_price": "p_write"}
    shown = ", ".join([f"CASE WHEN {r} <= 0 THEN '-' ELSE printf('$%.4f', {r}) END AS {n}" for n, r in rates.items()] + [f"{_label('p_read', 'p_in')} AS cache_read_rate, {_label('p_write', 'p_in')} AS cache_write_rate"])
    one = ", ".join(f"CASE WHEN count(DISTINCT {n}) > 1 THEN 'mixed' ELSE min({n}) END AS {n}" for n in (*rates, "cache_read_rate", "cache_write_rate"))
    over_calls("A16_model_detail", lambda x: pricing.model_detail(_identified(x), book(x), also(x), today), _prices_sql(now) + f"""
, id AS (SELECT *, unnest({_identity_sql()}) FROM dc), lastly AS (SELECT canonical_id, tool, canonical, max(timestamp) AS timestamp FROM id GROUP BY ALL),
lp AS (SELECT l.canonical_id, is_fallback, {shown} FROM lastly AS l JOIN price ON l.tool = price.tool AND l.canonical = price.canonical AND coalesce(l.timestamp::DATE, DATE '{today}') = price.day),
r AS (SELECT canonical_id, {one}, bool_or(is_fallback) AS has_fallback FROM lp GROUP BY canonical_id)
SELECT * FROM (SELECT canonical_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(cache_write_tokens)::BIGINT AS cache_write_tokens, round(sum(cost) / count(*), 6) AS cost_per_call FROM id GROUP BY canonical_id) JOIN r USING (canonical_id)""")
    over_calls("A35_report_calls", lambda x: details.report_calls(priced(x)), _prices_sql(now) + f"""
SELECT row_number() OVER (ORDER BY timestamp NULLS FIRST, seq)::BIGINT AS place, timestamp, tool, model, identity, coalesce(session_key, '') AS session_key, dedup_key, round(cost, 6) AS cost_usd, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens,
  {_label('p_read', 'p_in')} AS cache_read_rate, {_label('p_write', 'p_in')} AS cache_write_rate, array_to_string(tools, ', ') AS tools, array_to_string(commands, ' && ') AS commands, trim(regexp_replace(user_message, '\\s+', ' ', 'g')) AS prompt FROM priced""")
    listed = ", ".join(f"('{c}', {i})" for i, c in enumerate(categories.CATEGORIES))
    with_category = lambda x: tables.detailed_calls(x).withColumn("category", categories.category(F.col("tools"), F.col("commands"), F.col("user_message")))
    over_calls("X01_task_categories", lambda x: with_category(x).select("seq", "category"), bound + _category_sql() + "SELECT seq, category FROM cat")
    for mode, first in (("spend", "cost"), ("tokens", "tokens")):
        over_calls(f"A20_categories_by_{mode}", lambda x, m=mode: details.category_rows(with_category(x), m), bound + _category_sql() + f"""
, g AS (SELECT category, any_value(listed) AS listed, round(sum(cost), 6) AS cost, count(*)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens FROM cat JOIN (VALUES {listed}) AS l(category, listed) USING (category) GROUP BY category)
SELECT category, cost, calls, tokens, row_number() OVER (ORDER BY {first} DESC, listed)::BIGINT AS place, CASE WHEN max({first}) OVER () > 0 THEN round(100.0::DOUBLE * {first} / max({first}) OVER ()) ELSE 0 END::BIGINT AS bar FROM g""")
    over_calls("A38_report_categories", lambda x: details.report_categories(with_category(x)), bound + _category_sql() + f"""
, g AS (SELECT category, any_value(listed) AS listed, round(sum(cost), 6) AS cost, count(*)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens FROM cat JOIN (VALUES {listed}) AS l(category, listed) USING (category) GROUP BY category)
SELECT category, cost, calls, tokens, row_number() OVER (ORDER BY cost DESC, calls DESC, listed)::BIGINT AS place FROM g""")
    limits = lambda spark, d: tables.limit_snapshots(spark, d)
    in_month = "observed_at >= TIMESTAMP '1995-03-01' AND observed_at < TIMESTAMP '1995-04-01'"
    over("A39_raw_limits", lambda spark, d: details.raw_limits(limits(spark, d), "month", now.replace(year=1995, month=3)), latest_sql + f"""
SELECT row_number() OVER (ORDER BY observed_at, seq)::BIGINT AS place, tool, limit_id, observed_at, round(used_percent, 6) AS used_percent, window_minutes, plan_type FROM l WHERE {in_month}""")
    over("A39_latest_limits", lambda spark, d: details.report_latest_limits(limits(spark, d), "month", now.replace(year=1995, month=3)), latest_sql + f"""
SELECT tool, limit_id, observed_at, round(used_percent, 6) AS used_percent, plan_type, row_number() OVER (ORDER BY tool, limit_id)::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY tool, limit_id ORDER BY observed_at DESC, seq DESC) AS nth FROM l WHERE {in_month}) WHERE nth = 1""")
    over("A28_limit_windows", lambda spark, d: details.limit_windows(tables.limit_states(limits(spark, d)), now.replace(year=1998, month=8)), latest_sql + """
, a AS (SELECT *, row_number() OVER (PARTITION BY tool, limit_id ORDER BY observed_at DESC, seq DESC) AS nth FROM l),
w AS (SELECT tool, limit_id, observed_at, 'primary' AS kind, used_percent, window_minutes, CASE WHEN seq % 3 > 0 THEN observed_at + to_minutes(window_minutes) END AS resets_at FROM a WHERE nth = 1
  UNION ALL SELECT tool, limit_id, observed_at, 'secondary', 100 - used_percent / 2, 43200::BIGINT, NULL FROM a WHERE nth = 1 AND seq % 2 = 0),
f AS (SELECT *, coalesce(resets_at < TIMESTAMP '1998-08-31', observed_at + INTERVAL 7 DAY < TIMESTAMP '1998-08-31') AS stale, coalesce(resets_at + INTERVAL 7 DAY < TIMESTAMP '1998-08-31', observed_at + INTERVAL 14 DAY < TIMESTAMP '1998-08-31') AS hidden FROM w),
v AS (SELECT *, CASE window_minutes WHEN 300 THEN '5h' WHEN 10080 THEN 'weekly' WHEN 43200 THEN 'monthly' ELSE window_minutes || 'm' END AS label FROM f WHERE NOT hidden)
SELECT tool, limit_id, kind, label, least(greatest(round(used_percent), 0), 100)::BIGINT AS used, least(greatest(round(100 - used_percent), 0), 100)::BIGINT AS remaining, stale,
  row_number() OVER (ORDER BY tool, limit_id, CASE label WHEN '5h' THEN 0 WHEN 'weekly' THEN 1 ELSE 2 END, kind)::BIGINT AS place FROM v""")
    bounds = lambda x: x.groupBy("tool").agg(F.min("timestamp").alias("seen")).select("tool", *[c for p in ("today", "week", "30d", "month", "all") for c in day_bounds(p, today)])
    over_calls("F03_day_bounds", bounds, """
SELECT DISTINCT tool, DATE '2024-01-30' AS today_first, DATE '2024-01-31' AS today_last, DATE '2024-01-25' AS week_first, DATE '2024-01-31' AS week_last, DATE '2024-01-02' AS "30d_first", DATE '2024-01-31' AS "30d_last", DATE '2024-01-01' AS month_first, DATE '2024-01-31' AS month_last, NULL::DATE AS all_first, DATE '2024-01-31' AS all_last FROM x""")
    over_calls("F08_tool_signals", details.tool_signals, """
SELECT tool, bool_and(tool IN ('claude-code', 'codex')) AS cancel, bool_and(tool IN ('claude-code', 'codex', 'cursor')) AS file_refs, bool_and(tool IN ('claude-code', 'codex')) AS cache_reads, bool_and(tool IN ('claude-code', 'codex', 'cursor')) AS conversations FROM x GROUP BY tool""")
    over("F10_included_prices", lambda spark, d: pricing.included(pricing.book(spark), ("opus",), ("gpt-5",)).select("key", "effective_from", "p_in"), "SELECT * FROM (VALUES ('claude-opus-4', NULL::DATE, 15.0::DOUBLE), ('claude-opus-4', DATE '2024-01-15', 5.5), ('claude-opus-4-6', DATE '2024-01-20', 6.0), ('gpt-5', NULL, 1.25)) AS t(key, effective_from, p_in)")
    hours = lambda x: x.groupBy(F.hour("timestamp").cast("long").alias("hour")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"))
    over_calls("K03_bars", lambda x: details.bars(hours(x), bar_or_zero, whole_scale, heat_class), """
, g AS (SELECT hour(timestamp) AS hour, sum(tokens)::BIGINT AS tokens, count(*)::BIGINT AS calls FROM x GROUP BY 1),
b AS (SELECT *, CASE WHEN max(tokens) OVER () <= 0 THEN 0 ELSE least(greatest(round(100.0::DOUBLE * tokens / max(tokens) OVER ()), 0), 100) END::BIGINT AS bar, least(greatest(calls * 100 // max(calls) OVER (), 1), 100)::BIGINT AS scaled FROM g)
SELECT *, CASE WHEN bar = 0 THEN 0 WHEN bar <= 20 THEN 1 WHEN bar <= 40 THEN 2 WHEN bar <= 65 THEN 3 WHEN bar <= 85 THEN 4 ELSE 5 END::BIGINT AS heat FROM b""")
