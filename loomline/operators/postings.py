"""Full-text search over a postings table that is written once.

A query reads only the postings of its terms: every file is sorted by term, so
Parquet's statistics leave out the other row groups, and a frequent term spreads
over all files. Null texts are empty; an empty archive gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import project_identity
from .search import ASSISTANT_WEIGHT, B, K1, USER_WEIGHT
from .shared import written

# Sessions returned and their bound, turns quoted of each, tokens of a quotation, marks around a hit.
SESSIONS, MOST_SESSIONS, QUOTES, QUOTE_TOKENS, HIT = 20, 50, 3, 12, ("\ue000", "\ue001")

WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"
PIECE = WORD + r"[^\p{L}\p{N}]*"


def _plain_letters() -> tuple[str, str]:
    """Lower-case Latin letters that are an ASCII letter with marks, each with its letter; last the marks, which go."""
    bases = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if c.islower()}
    bases = {c: b for c, b in bases.items() if b.isascii()}
    return "".join(bases) + "".join(map(chr, range(0x300, 0x370))), "".join(bases.values())


def fold(text: Column) -> Column:
    """Q02: lower case without the diacritics of Latin letters."""
    return F.translate(F.lower(text), *_plain_letters())


def tokens(text: Column) -> Column:
    """Q02: folded runs of letters, digits and marks."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), fold)


def phrases(query: str) -> list[list[str]]:
    """Q01: for each white-space token its terms; tokens without a letter or digit are dropped."""
    plain = query.lower().translate({ord(c): b for c, b in zip(*_plain_letters())} | {c: None for c in range(0x300, 0x370)})
    return [p for p in (re.findall(r"[^\W_]+", word) for word in plain.split()) if p]


class Index(NamedTuple):
    postings: DataFrame  # term, dedup_key, tool, session_id, u and a (places in both columns), length
    totals: DataFrame  # one row: turns, mean length


def build_index(transcripts: DataFrame) -> Index:
    """Postings by term, and the totals that ranks need."""
    rows = transcripts.select("dedup_key", "tool", "session_id", tokens(F.coalesce("user_text", F.lit(""))).alias("ut"), tokens(F.coalesce("assistant_text", F.lit(""))).alias("at"))
    places = lambda c, user: F.transform(c, lambda t, i: F.struct(t.alias("term"), i.alias("place"), F.lit(user).alias("user")))
    words = rows.select("dedup_key", "tool", "session_id", (F.size("ut") + F.size("at")).alias("length"), F.explode(F.concat(places("ut", True), places("at", False))).alias("w")).select("*", "w.*")
    # a turn's words stand in one task, so that they are grouped before the shuffle
    of = lambda user: F.array_sort(F.collect_list(F.when(user, F.col("place"))))
    postings = words.groupBy("term", "dedup_key", "tool", "session_id", "length").agg(of(F.col("user")).alias("u"), of(~F.col("user")).alias("a"))
    postings = written(postings.sortWithinPartitions("term", "dedup_key"), "postings")
    words = postings.agg(F.sum(F.size("u") + F.size("a")).alias("words"))
    turns = transcripts.agg(F.count("*").alias("n"))
    return Index(postings, written(turns.crossJoin(words).select("n", (F.col("words") / F.col("n")).alias("mean")), "totals"))  # one row each


def _moved(places: str, by: int) -> Column:
    return F.transform(places, lambda p: p + by)


def find(index: Index, query: str) -> DataFrame:
    """Q03: (dedup_key, tool, session_id, rank, at_u, at_a) of turns with all phrases, the last one by prefix; smaller ranks are better."""
    wanted = phrases(query)
    names = [(i, j, t) for i, p in enumerate(wanted) for j, t in enumerate(p)]
    if not names:
        none = "dedup_key string, tool string, session_id string, rank double, at_u array<int>, at_a array<int>"
        return index.postings.sparkSession.createDataFrame([], none)
    term = F.col("term")
    is_term = {(i, j): term.startswith(t) if (i, j) == names[-1][:2] else term == t for i, j, t in names}
    doc = ("dedup_key", "tool", "session_id", "length")
    groups = index.postings.where(reduce(Column.__or__, is_term.values())).groupBy(*doc)
    hits = groups.agg(*[F.array_sort(F.flatten(F.collect_list(F.when(is_term[i, j], F.col(c))))).alias(f"{c}_{i}_{j}") for i, j, _ in names for c in "ua"])

    def starts(c: str, i: int) -> Column:
        """Places where phrase i begins in column c."""
        return reduce(F.array_intersect, [_moved(f"{c}_{i}_{j}", -j) for j in range(len(wanted[i]))])

    hits = hits.select(*doc, *[starts(c, i).alias(f"{c}{i}") for i in range(len(wanted)) for c in "ua"])
    has = [F.size(f"u{i}") + F.size(f"a{i}") > 0 for i in range(len(wanted))]
    stats = index.totals.crossJoin(hits.agg(*[F.count_if(h).alias(f"df{i}") for i, h in enumerate(has)]))  # one row each
    rank = F.lit(0.0)
    for i in range(len(wanted)):
        tf = F.size(f"u{i}") * USER_WEIGHT + F.size(f"a{i}") * ASSISTANT_WEIGHT
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        rank = rank - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    covered = lambda c: F.array_sort(F.array_distinct(F.concat(*[_moved(f"{c}{i}", j) for i in range(len(wanted)) for j in range(len(wanted[i]))])))
    found = hits.crossJoin(F.broadcast(stats)).where(reduce(Column.__and__, has))
    return found.select("dedup_key", "tool", "session_id", rank.alias("rank"), covered("u").alias("at_u"), covered("a").alias("at_a"))


def matches(index: Index, transcripts: DataFrame, query: str, tool: str | None = None, project: str | None = None) -> DataFrame:
    """Found turns with project, timestamp and origin; a project is given as it stands or by its identity."""
    turns = transcripts.select("dedup_key", "project", "timestamp", "origin")
    if project is not None:
        turns = turns.where((F.col("project") == project) | (project_identity(F.col("project")) == project))
    found = find(index, query).join(turns, "dedup_key")
    return found if tool is None else found.where(F.col("tool") == tool)


def best_sessions(found: DataFrame, limit: int = 0) -> DataFrame:
    """Q04, Q06: the best sessions in order, with the number of all that match; limit 0 means SESSIONS, MOST_SESSIONS is the bound."""
    sessions = found.groupBy("tool", "session_id").agg(
        F.min("project").alias("project"), F.max("timestamp").alias("last"), F.count("*").alias("hits"), F.round(F.min("rank"), 6).alias("best"), (F.count_if(F.col("origin") == "full") == 0).alias("prompt_only")
    )
    sessions = written(sessions, "sessions")
    order = [F.col("best"), F.desc_nulls_last("last"), F.col("tool"), F.col("session_id")]
    top = sessions.orderBy(*order).limit(min(limit or SESSIONS, MOST_SESSIONS))
    top = top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # MOST_SESSIONS rows at most
    return top.crossJoin(F.broadcast(sessions.agg(F.count("*").alias("total"))))  # one row


def with_costs(best: DataFrame, calls: DataFrame) -> DataFrame:
    """Q06: best sessions with what their calls cost, 0 without calls."""
    keys = F.broadcast(best.select("tool", "session_id"))  # MOST_SESSIONS rows at most
    costs = calls.join(keys, ["tool", "session_id"], "left_semi").groupBy("tool", "session_id").agg(F.round(F.sum("cost"), 6).alias("cost"))
    return best.join(costs, ["tool", "session_id"], "left").fillna({"cost": 0.0})


def _quote(text: str, at: str) -> Column:
    """QUOTE_TOKENS pieces of text around the first hit, hits marked, an ellipsis where text is left out."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    start = F.greatest(F.lit(0), F.least(F.element_at(at, 1) - (QUOTE_TOKENS - 1) // 2, F.size(pieces) - QUOTE_TOKENS))
    marked = F.transform(pieces, lambda p, i: F.when(F.array_contains(at, i), F.regexp_replace(p, f"^({WORD})", f"{HIT[0]}$1{HIT[1]}")).otherwise(p))
    before, after = F.when(start > 0, "…").otherwise(""), F.when(start + QUOTE_TOKENS < F.size(pieces), "…").otherwise("")
    return F.concat(before, F.array_join(F.slice(marked, start + 1, QUOTE_TOKENS), ""), after)


def quotes(found: DataFrame, best: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Q05: of each best session its QUOTES best turns, quoted from the user's text if that has a hit."""
    keys = F.broadcast(best.select("tool", "session_id"))  # MOST_SESSIONS rows at most
    w = Window.partitionBy("tool", "session_id").orderBy(F.round("rank", 6), "dedup_key")
    turns = found.join(keys, ["tool", "session_id"], "left_semi").withColumn("nth", F.row_number().over(w).cast("long")).where(F.col("nth") <= QUOTES)
    texts = transcripts.select("dedup_key", F.coalesce("user_text", F.lit("")).alias("user_text"), F.coalesce("assistant_text", F.lit("")).alias("assistant_text"))
    rows = texts.join(F.broadcast(turns.select("dedup_key", "tool", "session_id", "nth", "at_u", "at_a")), "dedup_key")  # QUOTES a session
    by_user = F.size("at_u") > 0
    return rows.select("tool", "session_id", "nth", "dedup_key", F.when(by_user, "user").otherwise("assistant").alias("role"), F.when(by_user, _quote("user_text", "at_u")).otherwise(_quote("assistant_text", "at_a")).alias("snippet"))
