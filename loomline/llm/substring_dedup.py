"""Substring dedup with repeated-phrase automata.

1. Candidates: every 50-word window is filed under the smallest hash among its
   20-word runs (its anchor), so equal windows share it. Anchors found in one
   document only are dropped by an aggregation.
2. Stretches: in the remaining documents, neighbouring windows with one anchor make
   a stretch of words. Equal stretches are aggregated before they move on, so copies
   are handled once; each keeps the smallest and largest doc_id that holds it.
3. Passages: stretches are dealt to shards by anchor. In a shard, windows are
   numbered exactly; those held by two documents or more are confirmed, and chains
   of them that always stand together, with one smallest doc_id, are the passages.
4. Automata: each shard compiles its passages into one Aho-Corasick automaton over
   word numbers, and every stretch of the shard is streamed through it. What it
   locates, with the passage's smallest doc_id, goes back to all documents that hold
   the stretch; a document with a larger doc_id loses the words of the occurrence.

Words are compared, not hashes: an anchor's collision only files more stretches
together, and stretches are told apart by a 128-bit BLAKE2 digest. An anchor with
more than HOT_ANCHOR different stretches is filed again by window: equal windows are
aggregated to one row with the smallest and largest doc_id, only those that recur are
read by the automata, and what these locate is joined back to the stretches. So no
shard holds more than HOT_ANCHOR stretches of one anchor.

Defined results: null and empty texts have no words and keep the empty string;
a null doc_id is compared with nothing; rows that share a doc_id are one document
and don't cut each other; an empty table gives an empty table. Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, small_batches
from .words import Shingles, as_long, run_numbers, sliding_min, words_of

WINDOW, RUN = 50, 20
#: Stretches of one automaton; windows of one stretch; different stretches from which an anchor is filed by window; words handed on at once.
SHARD, LONGEST, HOT_ANCHOR, WORDS_AT_ONCE = 4096, 256, 20_000, 1 << 19
#: Up to so many hot anchors are broadcast; beyond, they are joined by shuffle.
BROADCAST_ANCHORS = 100_000


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scan(window: int, run: int):
    """One row of figures for each document, and one for each distinct anchor in it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
            counts, digests, owners, runs = [], [], [], []
            for doc_id, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                counts.append(len(words))
                digests.append(_digest(words))
                if doc_id is not None and len(words) >= window:
                    least = np.unique(sliding_min(Shingles(words).hashes(run), window - run + 1))
                    owners.append(np.full(len(least), doc_id, np.int64))
                    runs.append(as_long(least))
            n, m = len(ids), sum(map(len, runs))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.concat_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *owners]))]),
                    "text_key": pa.concat_arrays([pa.array(keys, pa.int64()), pa.nulls(m, pa.int64())]),
                    "run": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *runs]))]),
                    "n_words": pa.concat_arrays([pa.array(counts, pa.int64()), pa.nulls(m, pa.int64())]),
                    "sha256": pa.concat_arrays([pa.array(digests, pa.string()), pa.nulls(m, pa.string())]),
                }
            )

    return scan


_STRETCH = pa.schema([("anchor", pa.int64()), ("stretch", pa.binary()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("words", pa.string())])


def _spans(values: np.ndarray, longest: int) -> Iterator[tuple[int, int]]:
    """First and last position of each run of equal values, in pieces of at most so many."""
    edges = np.flatnonzero(values[1:] != values[:-1]) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True):
        for at in range(lo, hi, longest):
            yield at, min(hi, at + longest) - 1


def _stretches(window: int, run: int):
    """The stretches of a document whose anchors recur."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))
            for doc_id, key, text, runs in zip(*columns, batch.column("runs"), strict=True):
                words = words_of(text)
                anchors = as_long(sliding_min(Shingles(words).hashes(run), window - run + 1))
                recurs = np.isin(anchors, runs.values.to_numpy())
                for lo, hi in _spans(anchors, LONGEST) if recurs.any() else ():
                    if recurs[lo]:
                        joined = b" ".join(words[lo : hi + window])
                        rows.append((int(anchors[lo]), hashlib.blake2b(joined, digest_size=16).digest(), doc_id, key, lo, joined.decode("utf-8", "surrogatepass")))
                        held += hi + window - lo
                if held > WORDS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _STRETCH.types, strict=True)], schema=_STRETCH)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _STRETCH.types, strict=True)], schema=_STRETCH)

    return scan


def passages(texts: list[np.ndarray], least: np.ndarray, most: np.ndarray, window: int) -> list[tuple[np.ndarray, int]]:
    """The confirmed passages of a shard, as word numbers with the smallest doc_id that holds them.

    texts come in order of least, so a window's first occurrence is in its smallest document.
    Windows are chained if each always comes right before the other.
    """
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    numbers = np.concatenate(texts)
    runs = run_numbers(numbers, window)
    place = np.arange(len(runs))
    stretch = np.searchsorted(ends, place, "right")
    whole = place + window <= ends[stretch]
    place, stretch = place[whole], stretch[whole]
    _, first, own = np.unique(runs[whole], return_index=True, return_inverse=True)
    n = len(first)
    owner, last = least[stretch[first]], np.full(n, np.iinfo(np.int64).min)
    np.maximum.at(last, own, most[stretch])
    edge = stretch[1:] != stretch[:-1]
    after = np.append(np.where(edge, -1, own[1:]), -1)
    before = np.concatenate([[-1], np.where(edge, -1, own[:-1])])
    only = []
    for beside in (after, before):
        lo, hi = np.full(n, n), np.full(n, -1)
        np.minimum.at(lo, own, beside)
        np.maximum.at(hi, own, beside)
        only.append(np.where(lo == hi, lo, -1))
    recurs = owner < last
    on = np.maximum(only[0], 0)
    linked = recurs & (only[0] >= 0) & (only[1][on] == np.arange(n)) & (owner[on] == owner) & recurs[on]
    led_to = np.zeros(n, bool)
    led_to[on[linked]] = True
    starts = np.sort(first[recurs & ~led_to])
    stops = np.flatnonzero(~linked[own])
    stops = stops[np.searchsorted(stops, starts)]
    return [(numbers[place[a] : place[b] + window], int(owner[own[a]])) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def locate(words: list[list[str]], least: np.ndarray, most: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(stretch, first word, last word, smallest doc_id) of every occurrence of a confirmed passage in the stretches of one shard."""
    known: dict[str, int] = {}
    texts = [np.fromiter((known.setdefault(w, len(known)) for w in s), np.int64, len(s)) for s in words]
    order = np.argsort(least, kind="stable")
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for passage, owner in passages([texts[i] for i in order], least[order], most[order], window):
        automaton.add_word(tuple(passage.tolist()), (len(passage), owner))
    if not len(automaton):
        return
    automaton.make_automaton()
    for i, text in enumerate(texts):
        for end, (length, owner) in automaton.iter(tuple(text.tolist())):
            yield i, end - length + 1, end, owner


_FOUND = pa.schema([("stretch", pa.binary()), ("first", pa.int64()), ("last", pa.int64()), ("owner", pa.int64())])


def _locate_shards(window: int):
    """Rows come sorted by anchor; a shard is as many whole anchors as fit."""

    def one(rows: pa.Table) -> pa.RecordBatch:
        names = rows.column("stretch").to_pylist()
        found = locate([w.split(" ") for w in rows.column("words").to_pylist()], rows.column("least").to_numpy(), rows.column("most").to_numpy(), window)
        hits = [(names[i], a, b, owner) for i, a, b, owner in found]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True) if hits else [[]] * 4, _FOUND.types, strict=True)], schema=_FOUND)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            while waiting.num_rows > SHARD:
                anchors = waiting.column("anchor").to_numpy()
                edges = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
                if not len(edges):
                    break
                cut = int(edges[max(0, np.searchsorted(edges, SHARD, "right") - 1)])
                yield one(waiting.slice(0, cut))
                waiting = waiting.slice(cut)
        if waiting is not None and waiting.num_rows:
            yield one(waiting)

    return scan


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, kept = [], []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts"), strict=True):
            words = words_of(text)
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, cuts.values.field("first").to_numpy(), 1)
            np.add.at(edges, cuts.values.field("last").to_numpy() + 1, -1)
            gone = np.cumsum(edges[:-1]) > 0
            removed.append(int(gone.sum()))
            kept.append(_digest([w for w, c in zip(words, gone.tolist(), strict=True) if not c]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "text_key", "n_removed", "kept"])


def _spread(distinct: DataFrame, window: int, hot_anchor: int) -> tuple[DataFrame, DataFrame | None]:
    """What the automata read: stretches of other than hot anchors, and each recurring window of the hot ones once, as a stretch of its own.

    Also (name, stretch, shift), where those windows stand; None without hot anchors. A window's words
    are fetched only if it recurs, so what is shuffled for the others is a digest and two ids.
    """
    hot = materialize(distinct.groupBy("anchor").count().where(F.col("count") > hot_anchor).select("anchor", F.lit(True).alias("hot")), "hot")
    few = hot.limit(BROADCAST_ANCHORS + 1).count()
    columns = ["anchor", "stretch", "words", "least", "most"]
    if not few:
        return distinct.select(*columns), None
    marked = distinct.join(F.broadcast(hot) if few <= BROADCAST_ANCHORS else hot, "anchor", "left")
    single = marked.where("hot").withColumn("all", F.split("words", " ")).select("stretch", "least", "most", "all", F.explode(F.sequence(F.lit(0), F.size("all") - window)).alias("shift"))
    name = F.unhex(F.md5(F.array_join(F.slice("all", F.col("shift") + 1, window), " ").cast("binary")))
    places = materialize(single.select(name.alias("name"), "stretch", "least", "most", F.col("shift").cast("long").alias("shift")), "windows")
    recurring = places.groupBy("name").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min(F.struct("stretch", "shift")).alias("at")).where("least < most")
    read = recurring.select("name", "least", "most", "at.*").join(distinct.select("stretch", F.split("words", " ").alias("all")), "stretch")
    read = read.select(F.xxhash64("name").alias("anchor"), F.col("name").alias("stretch"), F.array_join(F.slice("all", (F.col("shift") + 1).cast("int"), window), " ").alias("words"), "least", "most")
    return marked.where("hot is null").select(*columns).unionByName(read), places.select("name", "stretch", "shift")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs.

    A word goes if a window of that many words that covers it also starts in a document with a smaller doc_id.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    scanned = materialize(docs.mapInArrow(_scan(window, run), "doc_id long, text_key long, run long, n_words long, sha256 string"), "runs")
    figures, runs = scanned.where("run is null").drop("run"), scanned.where("run is not null").select("run", "doc_id")
    recurring = runs.groupBy("run").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("run")
    of_doc = runs.join(recurring, "run", "left_semi").groupBy("doc_id").agg(F.collect_set("run").alias("runs"))
    suspects = materialize(docs.join(of_doc, "doc_id"), "suspects")
    stretches = materialize(suspects.mapInArrow(_stretches(window, run), "anchor long, stretch binary, doc_id long, text_key long, start long, words string"), "stretches")
    distinct = stretches.groupBy("anchor", "stretch").agg(F.first("words").alias("words"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    read, places = _spread(materialize(distinct, "distinct"), window, hot_anchor)
    # a fixed number: automata cost more than their bytes suggest, so small partitions shouldn't be merged
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = read.repartition(partitions, "anchor").sortWithinPartitions("anchor")
    found = dealt.mapInArrow(_locate_shards(window), "stretch binary, first long, last long, owner long")
    if places is not None:
        found = materialize(found, "located")
        of_windows = places.join(found.withColumnRenamed("stretch", "name"), "name")
        found = found.unionByName(of_windows.select("stretch", *[(F.col(c) + F.col("shift")).alias(c) for c in ("first", "last")], "owner"))
    of_stretch = materialize(found.groupBy("stretch").agg(F.collect_list(F.struct("first", "last", "owner")).alias("found")), "found")
    hits = stretches.select("stretch", "doc_id", "text_key", "start").join(of_stretch, "stretch")
    hits = hits.withColumn("found", F.filter("found", lambda f: f["owner"] < F.col("doc_id"))).where(F.size("found") > 0)
    cuts = hits.select("doc_id", "text_key", F.transform("found", lambda f: F.struct((f["first"] + F.col("start")).alias("first"), (f["last"] + F.col("start")).alias("last"))).alias("cuts"))
    cuts = cuts.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    cut = suspects.join(cuts, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "cuts").mapInArrow(_cut, "doc_id long, text_key long, n_removed long, kept string")
    cut = cut.groupBy("doc_id", "text_key").agg(F.first("n_removed").alias("n_removed"), F.first("kept").alias("kept"))
    return figures.join(cut, ["doc_id", "text_key"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept", "sha256").alias("kept_sha256"))


def op1_query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d)),
firsts AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
cut AS (
  SELECT DISTINCT doc_id, i + k AS p FROM win JOIN firsts USING (h), generate_series(0, 49) AS g(k) WHERE least < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.p) FILTER (WHERE cut.p IS NULL) AS kept, count(cut.p) AS n_removed
  FROM word LEFT JOIN cut ON word.doc_id = cut.doc_id AND word.p = cut.p GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
