"""Ranked lexical search by sort-based accumulation.

The queries' terms are dealt to blocks of bounded size, and each block is held against
all documents. One pass over the texts writes, for each document, its length and the
block's terms in it with their counts. These rows are then dealt by ranges of doc_id,
and a task turns them into arrays of (item, document, impact), one entry for
each item that has a matched term: item and document are packed into one key, keys
are radix sorted by digits of 16 bits, runs of equal keys are summed with reduceat,
and a heap for each item keeps its best. What comes out of all tasks is ranked by
item, first in parts.

All arithmetic behind the weights is in 64-bit integers, as the ranking defines it.
A block's terms, its weights and the heaps of its items are all that a task holds
beside one batch of documents.

Defined results: a null text has no terms, and neither counts as a document nor is
found; rows of one item_id, null included, are one item with the terms of all; each
row of a repeated doc_id is a document of its own; a null doc_id comes last among
equal scores; items without a match, empty queries and empty documents give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, small_batches
from .terms import WITH_DIGITS, terms_of

TOP = 50
#: What one block of queries holds at most, on average: (item, term) entries, and items.
BLOCK_ENTRIES, BLOCK_ITEMS = 200_000, 2_000
#: Entries that are sorted at once, unless one document has more.
SORTED_AT_ONCE = 1 << 21
#: Parts in which an item's rows are ranked before they meet.
PARTS = 32
NO_ID = 1 << 63


def radix_order(keys: np.ndarray) -> np.ndarray:
    """A stable order of unsigned keys, by digits of 16 bits from the lowest."""
    order, top = np.arange(len(keys)), int(keys.max()) if len(keys) else 0
    for shift in range(0, top.bit_length(), 16):
        digit = ((keys[order] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]  # numpy sorts 16-bit integers by radix
    return order


def query_terms(items: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(item_id, term), distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t, WITH_DIGITS))) for t in batch.column("text").to_pylist()]
            which = np.repeat(np.arange(len(found)), [len(f) for f in found])
            terms = pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(which)), terms], ["item_id", "term"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "item_id long, term string").distinct()


class Block:
    """Some items and their terms, by number."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        by_id = sorted({i for i, _ in rows}, key=lambda i: (i is None, i))
        self.ids = by_id
        item = {i: k for k, i in enumerate(by_id)}
        self.number: dict[bytes, int] = {}
        terms = [self.number.setdefault(t.encode(), len(self.number)) for _, t in rows]
        order = np.argsort(terms, kind="stable")
        self.items = np.array([item[i] for i, _ in rows], np.int64)[order]
        self.n_items = np.bincount(terms, minlength=len(self.number))
        self.start = np.cumsum(self.n_items) - self.n_items


def matches(docs: DataFrame, number: dict[bytes, int], text_col: str, id_col: str) -> DataFrame:
    """(doc_id, place, n, terms, counts) for each row of docs with a term: its terms that have a number, ascending, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, found = [], []
            for text in batch.column("text").to_pylist():
                terms = terms_of(text, WITH_DIGITS)
                lengths.append(len(terms))
                found.append(sorted((number[t], k) for t, k in Counter(terms).items() if t in number))
            lists = [pa.array([[x[k] for x in f] for f in found], kind) for k, kind in ((0, pa.list_(pa.int32())), (1, pa.list_(pa.int64())))]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(range(len(found)), pa.int32()), pa.array(lengths, pa.int64()), *lists], ["doc_id", "place", "n", "terms", "counts"])
            yield out.filter(pa.array([n > 0 for n in lengths], pa.bool_()))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, place int, n long, terms array<int>, counts array<long>")


def summed(block: Block, doc: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items, documents and sums of impacts, by item and document."""
    each = block.n_items[terms]
    entry = np.repeat(np.arange(len(terms)), each)
    item = block.items[np.arange(len(entry)) - np.repeat(np.cumsum(each) - each, each) + block.start[terms][entry]]
    width = np.uint64(int(doc[-1]) + 1 if len(doc) else 1)
    keys = item.astype(np.uint64) * width + doc[entry].astype(np.uint64)
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool))
    sums = np.add.reduceat(impacts[entry][order], first) if len(first) else np.zeros(0, np.int64)
    return (keys[first] // width).astype(np.int64), (keys[first] % width).astype(np.int64), sums


def best_scores(block: Block, weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    """A task's best (item_id, doc_id, score) of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int]]] = [[] for _ in block.ids]
        least = np.zeros(len(block.ids), np.int64)  # what a score must reach at least, above 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            lists = batch.column("terms")
            edges = lists.offsets.to_numpy()
            terms, counts = lists.values.to_numpy()[edges[0] : edges[-1]], batch.column("counts").values.to_numpy()
            counts = counts[batch.column("counts").offsets[0].as_py() :][: len(terms)]
            edges = edges - edges[0]
            doc = np.repeat(np.arange(len(ids)), np.diff(edges))
            m = 50 + (50 * batch.column("n").to_numpy() * n_docs) // n_terms
            impacts = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[doc]))
            entries = np.concatenate([[0], np.cumsum(block.n_items[terms])])[edges]
            start = 0
            while start < len(ids):
                end = max(start + 1, int(np.searchsorted(entries, entries[start] + SORTED_AT_ONCE, "right")) - 1)
                own = slice(edges[start], edges[end])
                item, at, score = summed(block, doc[own] - start, terms[own], impacts[own])
                good = np.flatnonzero((score > 0) & (score >= least[item]))
                for i, d, s in zip(item[good].tolist(), at[good].tolist(), score[good].tolist(), strict=True):
                    key, heap = ids[start + d], heaps[i]
                    row = (s, -NO_ID if key is None else -key)
                    if len(heap) < top:
                        heappush(heap, row)
                    else:
                        heappushpop(heap, row)
                    if len(heap) == top:
                        least[i] = heap[0][0]
                start = end
        rows = [(block.ids[i], None if d == -NO_ID else -d, s) for i, heap in enumerate(heaps) for s, d in heap]
        item_id, doc_id, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item_id, doc_id, score)], ["item_id", "doc_id", "score"])

    return run


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """rank within item_id, up to top; a part's best are taken first."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    part = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= top)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)


def _block_scores(docs: DataFrame, block: Block, text_col: str, id_col: str, top: int) -> DataFrame | None:
    found = materialize(matches(docs, block.number, text_col, id_col), "matches")
    n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    weights = np.zeros(len(block.number), np.int64)
    for term, df in found.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    partitions = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.where(F.size("terms") > 0).repartitionByRange(partitions, "doc_id", "place")
    return dealt.mapInArrow(best_scores(block, weights, n_docs, n_terms, top), "item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_id_col: str = "item_id", top: int = TOP, block_entries: int = BLOCK_ENTRIES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents of each item with a score above 0."""
    small_batches(docs.sparkSession)
    queries = materialize(query_terms(items, item_text_col, item_id_col), "queries")
    n_entries, n_items = queries.agg(F.count("*"), F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).first()
    n_blocks = max(1, -(-n_entries // block_entries), -(-n_items // block_items))
    scores = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for k in range(n_blocks if n_entries else 0):
        own = queries if n_blocks == 1 else queries.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
        rows = [(r.item_id, r.term) for r in own.toLocalIterator()]
        found = _block_scores(docs, Block(rows), text_col, id_col, top) if rows else None
        scores = scores if found is None else scores.unionByName(found)
    return _ranked(scores, top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_query(spark, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (
  SELECT doc, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
p AS (
  SELECT doc, doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY doc, doc_id, term),
l AS (
  SELECT doc, sum(tf)::BIGINT AS n FROM p GROUP BY doc),
c AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM l),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
df AS (
  SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
w AS (
  SELECT term, floor(1000::DOUBLE * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, c),
s AS (
  SELECT q.item_id, p.doc, p.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * l.n * c.docs) // c.terms))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN l USING (doc), c GROUP BY q.item_id, p.doc, p.doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
WHERE rank <= 50
"""
