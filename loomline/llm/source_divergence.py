"""How much the sources of a language differ in their terms: chi-square sums over all kept terms, by inclusion and exclusion over supports.

A group is a (lang, source). Each has a smoothed share p for every kept term of its
language, most of them for terms that it doesn't hold: those all have one share, the
group's p0. The sum of f(p, q) over all terms of a pair of groups is therefore put
together from three parts, none of which lists the terms that a group lacks:

- each group's histogram, the number of its terms for each share, prices its terms
  against the other's q0, and the other's p0 against its terms;
- a join of the postings by term, only where both groups hold it, takes the two
  one-sided prices back and adds the true one;
- the terms that neither holds, V less both supports and plus what they share, are
  that many times f(p0, q0).

Terms are counted in tasks and summed by group and term before anything is joined; a
(lang, term) has a row for each source at most. Tables that every part reads are
written once.

Defined results: null text, lang and source are read as the empty string; a group
without terms has the shares of zero counts; a language without kept terms gives pairs
of value 0 and no terms; repeated rows count as often as they stand there; no
documents give an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, small_batches
from .terms import LETTERS, terms_of

MIN_DOCUMENTS, TOP_TERMS, SCALE = 3, 200, 1_000_000_000
#: Counts held in a task before they are handed on.
HELD = 400_000
#: The histograms of one language meet its groups in so many parts.
PARTS = 16


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) summed in the task, with one row without a term for each group."""
    total: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def flushed() -> pa.RecordBatch:
        terms, counts, in_docs, sizes = [], [], [], []
        for group, own in total.items():
            terms.append(None)
            counts.append(0)
            in_docs.append(0)
            terms.extend(own)
            counts.extend(own.values())
            in_docs.extend(map(docs[group].__getitem__, own))
            sizes.append(1 + len(own))
        which = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        lang, source = (pa.array([g[i] for g in total], pa.string()).take(which) for i in (0, 1))
        return pa.RecordBatch.from_arrays([lang, source, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(in_docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            group = (lang, source)
            terms = terms_of(text, LETTERS)
            total.setdefault(group, Counter()).update(terms)
            docs.setdefault(group, Counter()).update(set(terms))
        if sum(map(len, total.values())) > HELD:
            yield flushed()
            total.clear()
            docs.clear()
    if total:
        yield flushed()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and a row with a null term for each group."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = rows.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), exact; null if no terms are kept."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", scaled, (total + kept).cast("decimal(20,0)")))


def price(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def group_shares(counts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Written tables: (lang, source, kept, total, support, p0) for each group; (lang, source, term, p, q, p0) for each of its kept terms, q its language's share."""
    zero = F.lit(0).cast("long")
    held = counts.where("term is not null")
    terms = materialize(held.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_documents), "kept_terms")
    kept = materialize(held.select("lang", "source", "term", "n").join(terms.select("lang", "term", "lang_n"), ["lang", "term"]), "postings")
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("kept", "lang_total", "total", "support")])
    groups = materialize(groups.withColumn("p0", share(zero, F.col("total"), F.col("kept"))), "groups")
    priced = kept.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    return groups.drop("lang_total"), materialize(priced.select("lang", "source", "term", p.alias("p"), q.alias("q"), "p0"), "shares")


def pair_values(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two groups of a language, source's shares against item's."""
    a, b = (groups.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "support", "p0")], *([F.col("kept")] if s == "a" else [])) for s in "ab")
    neither = F.when(F.col("kept") > 0, (F.col("kept") - F.col("support_a") - F.col("support_b")) * price(F.col("p0_a"), F.col("p0_b"))).otherwise(F.lit(0).cast("long"))
    both_zero = a.join(b, "lang").where("source_a <> source_b").select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), neither.alias("value"))

    def both_ways(joined: DataFrame, there: Column, back: Column) -> DataFrame:
        """The value of a against b, and of b against a."""
        summed = joined.groupBy("lang", "source_a", "source_b").agg(F.sum(there).alias("there"), F.sum(back).alias("back"))
        ways = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.col("there").alias("value")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"), F.col("back").alias("value")))
        return summed.select("lang", F.explode(ways).alias("x")).select("lang", "x.*")

    histogram = shares.groupBy("lang", F.col("source").alias("source_a"), F.col("p").alias("p_a")).count()
    histogram = histogram.withColumn("part", F.pmod(F.hash("source_a", "p_a"), F.lit(PARTS)))
    others = b.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = histogram.join(others, ["lang", "part"]).where("source_a <> source_b")
    one_sided = both_ways(met, F.col("count") * price(F.col("p_a"), F.col("p0_b")), F.col("count") * price(F.col("p0_b"), F.col("p_a")))

    left, right = (shares.select("lang", "term", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "p", "p0")]) for s in "ab")
    shared = left.join(right, ["lang", "term"]).where("source_a < source_b")

    def correction(x: str, y: str) -> Column:
        p, p0, q, q0 = (F.col(c) for c in (f"p_{x}", f"p0_{x}", f"p_{y}", f"p0_{y}"))
        return price(p, q) - price(p, q0) - price(p0, q) + price(p0, q0)

    overlaps = both_ways(shared, correction("a", "b"), correction("b", "a"))
    return both_zero.unionByName(one_sided).unionByName(overlaps).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair, each other source of the language; part term, the top terms that the source holds more of than its language."""
    counts = materialize(term_counts(docs, text_col, lang_col, source_col), "term_counts")
    groups, shares = group_shares(counts, min_documents)
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    pairs = pair_values(groups, shares).withColumn("rank", F.row_number().over(best))
    more = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
    terms = more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))


def op12_query(spark, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
terms AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
v AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM terms GROUP BY lang),
counts AS (
  SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN terms USING (lang, term) GROUP BY w.lang, w.source, w.term),
sums AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY lang, source),
groups AS (
  SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + v.v) AS p, 1 + (1000000000::HUGEINT * (t.n + 1)) // (v.total + v.v) AS q
  FROM groups g JOIN terms t ON g.lang = t.lang JOIN v ON v.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source),
sums_of_pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums_of_pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
top AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item ASC))::INTEGER AS rank FROM (FROM pairs UNION ALL FROM top))
WHERE part = 'pair' OR rank <= 200
"""
