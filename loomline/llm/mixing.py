"""Mixing sources to target weights, in DataFrame operations only.

Sizes are summed by source, each source gets a target share of the mix, and a
document of a source with repetition rate r is taken floor(r) times, and once
more with the probability of the fraction of r, by hash-seeded draws.

Draws of their own for each document would leave a source's sum to chance. So a
source's documents are counted in strata of nearly equal size, in order of size, and
a sequence with steps of the fraction, started at the source's hashed offset, says how
many of each stratum are taken: those with the smallest draws from a hash of doc_id
and the seed. Each document's probability is the fraction, no document gets more
than one extra copy, and a source's taken words differ from its target by about one
of its longest documents at most. The decision is a cut of the draws for each source
and stratum, so texts are never shuffled for it.

Targets: sources in order of code points, null last, weigh 5, 2, 1 repeating and
share mix_share of all sizes; a target stops at max_repeats times its source's
size, and the excess is shared by weight again until none is above. With sources
sorted by cap / weight this has a closed form: the capped ones are a prefix, and
the rest share what is left by weight.

Only per-source sums meet in one task, one row for each distinct source name: that
fits as long as sources are named collections or hosts, some tens of millions at most.
The cut of a stratum is found by counting its draws in 65,536 ranges and ordering one
of them, so a source or a size that holds a third of all rows is no task of its own.

Defined results: null and empty texts have size 0 and are never taken; a null
source is a source of its own; a source of size 0 has target 0; rows of one
doc_id and size draw alike; no documents give an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

WEIGHTS, MIX_SHARE, MAX_REPEATS, SEED = (5, 2, 1), 1.5, 2.0, 20240131
#: Up to so many strata the table of cuts is broadcast; beyond, it is joined by shuffle.
BROADCAST_STRATA = 200_000
#: Ranges of draws that are counted for each stratum.
RANGES = 1 << 16
#: Space and U+0009 to U+000D split words.
NOT_A_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_A_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, mix_share: float = MIX_SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size)."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    caps = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (place + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, rest, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    share = (F.lit(float(mix_share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest)
    # share: what a unit of weight gets if all sources before this one are capped
    free = caps.withColumn("share", share).withColumn("fits", F.col("share") * F.col("weight") < F.col("cap"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "share"))).over(every)["share"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(F.lit(0.0))
    return free.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def stratum(size: Column) -> Column:
    """A number that rises with size and tells sizes apart by their leading eight bits."""
    shift = F.greatest(F.length(F.bin(size)) - 8, F.lit(0))
    return (shift * 256 + F.call_function("shiftright", size, shift)).cast("long")


def drawn(text: Column) -> Column:
    """A number from 0 to 1 by a hash of the text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def keyed(source: Column) -> Column:
    """The source without nulls, so that joins need no care for them."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def measured(docs: DataFrame, text_col: str, id_col: str, source_col: str, seed: int, *more: str) -> DataFrame:
    """(doc_id, source, size, key, stratum, draw) for each row of docs, and the columns in more."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), *more)
    draw = drawn(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"/{seed}")))
    return rows.select("*", keyed(F.col("source")).alias("key"), stratum(F.col("size")).alias("stratum"), draw.alias("draw"))


def source_cuts(rows: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(key, stratum, source_size, target, rate, cut): documents with a draw up to cut get the extra copy; rows as of measured, written."""
    fraction, start = F.col("rate") - F.floor("rate"), drawn(F.concat(F.coalesce("source", F.lit("")), F.lit(f"/{seed}")))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("stratum").rowsBetween(Window.unboundedPreceding, 0))
    taken = F.floor(upto * fraction + start) - F.floor((upto - F.col("n")) * fraction + start)
    strata = rows.groupBy("key", "stratum").agg(F.count("*").alias("n")).join(targets.withColumn("key", keyed(F.col("source"))), "key")
    strata = materialize(strata.withColumn("taken", taken), "strata")
    some = strata.where("taken > 0 AND taken < n").select("key", "stratum", "taken")
    ranged = rows.select("key", "stratum", "draw", F.floor(F.col("draw") * RANGES).alias("range"))
    counted = ranged.groupBy("key", "stratum", "range").agg(F.count("*").alias("own")).join(some, ["key", "stratum"])
    before = F.sum("own").over(Window.partitionBy("key", "stratum").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")
    last = counted.withColumn("before", before).where("before < taken AND taken <= before + own").select("key", "stratum", "range", (F.col("taken") - F.col("before")).alias("nth"))
    place = F.row_number().over(Window.partitionBy("key", "stratum", "range").orderBy("draw"))
    cuts = ranged.join(last, ["key", "stratum", "range"]).withColumn("place", place).where("place = nth").select("key", "stratum", F.col("draw").alias("cut"))
    cut = F.when(F.col("taken") >= F.col("n"), F.lit(1.0)).otherwise(F.coalesce("cut", F.lit(-1.0)))
    return strata.join(cuts, ["key", "stratum"], "left").select("key", "stratum", "source_size", "target", "rate", cut.alias("cut"))


def with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows with the rates and cut of its source and stratum, by a broadcast only if there are few."""
    few = cuts.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    return rows.join(F.broadcast(cuts) if few else cuts, ["key", "stratum"], "left")


def copies(size: Column, rate: Column, draw: Column, cut: Column) -> Column:
    """floor(rate), and one more up to the cut; none of a text without words."""
    return F.when(size > 0, (F.floor(rate) + (draw <= cut).cast("long")).cast("long")).otherwise(F.lit(0).cast("long"))


def mix_plan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies) for each row of docs."""
    rows = materialize(measured(docs, text_col, id_col, source_col, seed), "sizes")
    cuts = materialize(source_cuts(rows, materialize(source_targets(rows), "targets"), seed), "cuts")
    n = copies(*map(F.col, ("size", "rate", "draw", "cut")))
    return with_cuts(rows, cuts).select("doc_id", "size", "source_size", "target", n.alias("copies"))


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs."""
    rows = materialize(measured(docs, text_col, id_col, source_col, seed), "sizes")
    cuts = materialize(source_cuts(rows, materialize(source_targets(rows), "targets"), seed), "cuts")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = measured(docs.select(row), f"row.{text_col}", f"row.{id_col}", f"row.{source_col}", seed, "row")
    n = copies(*map(F.col, ("size", "rate", "draw", "cut")))
    return with_cuts(found, cuts).select("row", F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select("row.*")


def op2_query(spark, sf_dir: str) -> DataFrame:
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP2_SQL = r"""
WITH d0 AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
d AS (
  SELECT *, greatest(length(bin(size)) - 8, 0) * 256 + (size >> greatest(length(bin(size)) - 8, 0)) AS stratum,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/20240131'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw FROM d0),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place,
         (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM s),
t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(share, place) FROM f WHERE share * weight < cap) * weight, cap)) AS target FROM f),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5(coalesce(source, '') || '/20240131'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS start FROM t),
n AS (
  SELECT source, stratum, count(*) AS own, sum(count(*)) OVER (PARTITION BY source ORDER BY stratum) AS upto FROM d GROUP BY source, stratum),
k AS (
  SELECT r.source, stratum, source_size, target, rate, floor(upto::DOUBLE * (rate - floor(rate)) + start) - floor((upto - own)::DOUBLE * (rate - floor(rate)) + start) AS extra
  FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source),
p AS (
  SELECT *, rank() OVER (PARTITION BY source, stratum ORDER BY draw) AS place FROM d)
SELECT p.doc_id, p.size, k.source_size, k.target,
       CASE WHEN p.size > 0 THEN p.size * (floor(rate)::BIGINT + (place <= extra)::BIGINT) ELSE 0 END AS taken
FROM p JOIN k ON p.source IS NOT DISTINCT FROM k.source AND p.stratum = k.stratum
"""
