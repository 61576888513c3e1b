"""op1: automata over confirmed passages, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomline.llm import substring_dedup


def plain(rows, window):
    first = {}
    docs = [(d, (t or "").split()) for d, t in rows]
    for d, w in docs:
        for i in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def mosaic(seed):
    """Documents made of overlapping parts of a few passages, periodic stretches, nulls, repeated rows and repeated doc_ids."""
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(5, 40))] for _ in range(12)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(r.randint(0, 6)):
            p = r.choice(passages)
            at = r.randrange(len(p))
            w += p[at : at + r.randint(1, 40)] + ["x"] * r.randint(0, 1) + ["a"] * (r.randint(1, 30) if r.random() < 0.1 else 0)
        rows.append((d if r.random() < 0.95 else None, " ".join(w) if r.random() < 0.97 else None))
    return [*rows, *rows[:3], (5, rows[7][1])]


@pytest.mark.parametrize("hot_anchor", [20_000, 2])
def test_overlapping_passages_against_plain_windows(spark, hot_anchor):
    for seed in (0, 1):
        rows = mosaic(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("stretch", F.lit("clash")).withColumn("words", F.lit(1))
        got = substring_dedup.substring_dedup(docs, window=8, run=4, hot_anchor=hot_anchor)
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 8)


def test_the_automaton_decides(spark, monkeypatch):
    rows = [(1, " ".join("abcdefghij")), (2, "x " + " ".join("abcdefghij"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs, window=8, run=4).collect()} == {1: 0, 2: 10}
    monkeypatch.setattr(substring_dedup, "_locate_shards", lambda window: lambda batches: iter(()))
    assert {r.n_removed for r in substring_dedup.substring_dedup(docs, window=8, run=4).collect()} == {0}


def test_words_are_compared_not_hashed(spark):
    """Complementary Thue-Morse words collide in every polynomial hash modulo 2^64."""
    a, b = "a", "b"
    while len(a) < 2048:
        a, b = a + b, b + a
    tail = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{a} {tail}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 50}


def test_a_long_periodic_text_and_an_empty_table(spark):
    long = "lorem ipsum " * 20_000
    docs = spark.createDataFrame([(1, long), (2, "start " + long + " end")], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect()} == {1: (40_000, 0), 2: (40_002, 40_000)}
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def test_a_window_in_very_many_documents_is_read_once(spark):
    """5,000 documents hold one passage in surroundings of their own: what automata read has few rows of an anchor, and follows the recurring windows."""
    shared = " ".join(f"s{i}" for i in range(50))
    docs = spark.range(5_000).selectExpr("id AS doc_id", f"concat('a', id, ' b', id, ' {shared} c', id, ' d', id) AS text")
    seen = []
    spread = substring_dedup._spread

    def watched(distinct, window, hot_anchor):
        read, places = spread(distinct, window, hot_anchor)
        seen.append(read.groupBy("anchor").count().agg(F.max("count"), F.sum("count")).first())
        return read, places

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(substring_dedup, "_spread", watched)
        got = substring_dedup.substring_dedup(docs, hot_anchor=100)
        assert [(r.n_removed, r.n) for r in got.groupBy("n_removed").agg(F.count("*").alias("n")).orderBy("n_removed").collect()] == [(0, 1), (50, 4_999)]
    assert seen[0][0] <= 100 and seen[0][1] < 100
