"""Full-text search over transcripts (Q): AND of terms, the last one a prefix, BM25 with column weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER_WEIGHT, ASSISTANT_WEIGHT, K1, B = 2.0, 1.0, 1.2, 0.75


def tokens(text: Column) -> Column:
    """Q02 without folding: lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def parse(query: str) -> list[str]:
    """Q01: white-space tokens without quotes, lower-cased; empty ones dropped."""
    return [t for t in (w.replace('"', "").lower() for w in query.split()) if t]


def search(transcripts: DataFrame, query: str) -> DataFrame:
    """Q03: (dedup_key, session_id, tool, origin, rank) of turns with all terms; smaller ranks are better."""
    terms = parse(query)
    rows = transcripts.select("dedup_key", "session_id", "tool", "origin", tokens(F.col("user_text")).alias("u"), tokens(F.col("assistant_text")).alias("a"))
    if not terms:
        return rows.select("dedup_key", "session_id", "tool", "origin", F.lit(0.0).alias("rank")).limit(0)

    def hits(column: str, i: int) -> Column:
        return F.size(F.filter(column, lambda t: t.startswith(terms[i]) if i == len(terms) - 1 else t == terms[i]))

    rows = rows.select("*", (F.size("u") + F.size("a")).alias("length"), *[c.alias(f"{s}{i}") for i in range(len(terms)) for s, c in (("u", hits("u", i)), ("a", hits("a", i)))])
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"u{i}") + F.col(f"a{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    rank, found = F.lit(0.0), F.lit(True)
    for i in range(len(terms)):
        tf = F.col(f"u{i}") * USER_WEIGHT + F.col(f"a{i}") * ASSISTANT_WEIGHT
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        rank = rank - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        found = found & (F.col(f"u{i}") + F.col(f"a{i}") > 0)
    return rows.crossJoin(F.broadcast(stats)).where(found).select("dedup_key", "session_id", "tool", "origin", rank.alias("rank"))  # stats: one row


def session_hits(found: DataFrame) -> DataFrame:
    """Q04, Q06: sessions by their best rank."""
    return found.groupBy("tool", "session_id").agg(F.count("*").alias("hits"), F.round(F.min("rank"), 6).alias("best"), (F.count_if(F.col("origin") == "full") == 0).alias("prompt_only"))
