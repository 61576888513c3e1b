"""Ranked search, source divergence and byte-level BPE against SQL, brute force and the reference library."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from loomline.llm import byte_bpe, lexical_search, source_divergence
from loomline.llm.terms import LETTERS, WITH_DIGITS, terms_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, term string"
LONG = " ".join(f"Word{i % 877} tail{i}x" for i in range(20_000))
ROWS = [
    (1, None, None, None, None, "a", "b"), (2, "", "en", "s", 0, None, None), (None, "Alpha beta GAMMA delta", "en", None, 7, "x", "y"), (3, "alpha beta beta 12 ÉCOLE école", "en", "s", 13, "x", "y"),
    (3, "alpha beta beta 12 ÉCOLE école", "en", "s", 13, "x", "y"), (4, "alpha beta gamma", "en", "t", 13, "x", "y"), (5, LONG, "en", "t", len(LONG), "x", "y"), (6, LONG, "fr", "t", len(LONG), "x", "y"), (7, "!!! ... 42", "de", "t", 3, "x", "y"),
    (8, "beta gamma alpha", "en", "u", 13, "x", "y"), (9, "gamma beta alpha", "en", "u", 13, "x", "y"), (10, "日本 alpha\x00beta 日本", "en", "", 13, "x", "y"),
]
ITEMS = [(1, "ALPHA beta nowhere"), (1, "gamma"), (None, "école 日本"), (2, None), (3, ""), (4, "word1 tail7x 12 beta"), (5, "unknownterm")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def by_sql(sql, columns):
    con = duckdb.connect()
    documents = pa.table({n: pa.array([r[i] for r in ROWS], pa.int64() if kind == "long" else pa.string()) for i, (n, kind) in enumerate(c.split() for c in DOCS.split(", "))})
    benchmark = pa.table({"item_id": pa.array([i for i, _ in ITEMS], pa.int64()), "text": pa.array([t for _, t in ITEMS], pa.string())})
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    return sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_terms():
    assert terms_of("Ab1-É2É x\x00Y", WITH_DIGITS) == ["ab1".encode(), "É2É".encode(), b"x", b"y"]
    assert terms_of("Ab1-É2É", LETTERS) == [b"ab", "É".encode(), "É".encode()] and terms_of(None, LETTERS) == []


@pytest.mark.parametrize("limits", [{}, {"block_entries": 3, "block_items": 1}])
def test_search_of_odd_rows_equals_sql_in_one_block_and_many(docs, items, limits):
    got = lexical_search.ranked_search(docs, items, **limits)
    assert rows_of(got) == by_sql(lexical_search.OP11_SQL, got.columns)


def test_search_of_nothing(docs, items):
    assert lexical_search.ranked_search(docs.limit(0), items).count() == 0
    assert lexical_search.ranked_search(docs, items.limit(0)).count() == 0
    assert lexical_search.ranked_search(docs.where("doc_id <= 2"), items).count() == 0


def test_search_keeps_ties_by_doc_id_across_batches_and_slices(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SORTED_AT_ONCE", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    docs = spark.range(4_000).selectExpr("4000 - id AS doc_id", "concat('same text ', if(id % 7 = 0, 'rare', 'often')) AS text").repartition(5)
    found = lexical_search.ranked_search(docs, spark.createDataFrame([(1, "same"), (2, "rare text")], "item_id long, text string")).collect()
    rare = sorted(4000 - i for i in range(4_000) if i % 7 == 0)
    assert [r.doc_id for r in sorted(found, key=lambda r: (r.item_id, r.rank)) if r.item_id == 2] == rare[:50]
    assert [r.doc_id for r in sorted(found, key=lambda r: (r.item_id, r.rank)) if r.item_id == 1] == []  # weight 0: in all documents


def test_radix_order_is_stable():
    keys = np.random.default_rng(1).integers(0, 1 << 40, 5_000).astype(np.uint64) >> np.uint64(22)
    assert lexical_search.radix_order(keys).tolist() == np.argsort(keys, kind="stable").tolist()
    assert lexical_search.radix_order(keys[:0]).tolist() == []


def test_divergence_of_odd_rows_equals_sql(docs):
    got = source_divergence.source_divergence(docs)
    assert rows_of(got) == by_sql(source_divergence.OP12_SQL, got.columns)
    assert source_divergence.source_divergence(docs.limit(0)).count() == 0


def test_divergence_of_long_counts_is_exact(spark):
    """Shares and prices at the ends of 64 bits."""
    rows = spark.sql("SELECT 90000000000000L AS n, 90000000000001L AS total, 1L AS kept UNION ALL SELECT 0L, 90000000000001L, 1L")
    got = rows.withColumn("p", source_divergence.share(*map(F.col, ("n", "total", "kept")))).collect()
    assert [r.p for r in got] == [1 + 10**9 * (r.n + 1) // (r.total + r.kept) for r in got]


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(byte_bpe.default_ranks(), byte_bpe.default_pattern())


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=codec.ranks, special_tokens={})


def hard_texts():
    rng = random.Random(7)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ab the ing  \n\t'sS123!", "".join(map(chr, [*range(0x300), *range(0x900, 0xA00), *range(0x3040, 0x30FF), *range(0x1F600, 0x1F650), 0x2028, 0x3000, 0x200B])), byte_bpe.unknown_characters()[::300] + "a1 !"]
    yield from ("".join(rng.choices(a, k=rng.randint(1, 80))) for a in alphabets for _ in range(400))
    yield from ("".join(rng.choices(alphabets[0], k=k)) for k in (511, 512, 513, 3_000, 20_000))
    yield from (x * 4_000 for x in ("a", " ", "ab", "1", "あ", "=-", " x", "\n ", "l'"))
    yield from ("", " ", "  ", "\n", " a", "a ", " a  b", "a\n\nb", "it's we'll I'M", "<|endoftext|>", "\x00\x1c \x1f a")


def test_ids_equal_the_library_and_round_trip(codec, library):
    texts = list(hard_texts())
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_every_character_is_classed_as_in_the_library(codec, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    texts = [f"{p}{c}{p}" for c in every for p in ("a", "1", " ")]
    assert all(a.tolist() == b for a, b in zip(codec.encode(texts), library.encode_ordinary_batch(texts, num_threads=4), strict=True))


def test_heap_and_rounds_agree(codec):
    rng = random.Random(2)
    pieces = ["".join(rng.choices("estring", k=rng.randint(2, 500))).encode() for _ in range(300)]
    assert [codec._heap(p) for p in pieces] == codec._merged(pieces)


def test_small_caches_change_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED", 10)
    texts = ["one two three four five", "two three six  seven", "one\ntwo eight nine ten eleven"] * 3
    fresh = byte_bpe.Codec(byte_bpe.default_ranks(), byte_bpe.default_pattern())
    for _ in range(3):
        assert [i.tolist() for i in fresh.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_digests_and_frames_of_odd_rows(docs, library):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.token_digests(docs).collect()}
    ids = [(r[0], library.encode_ordinary(r[1] or ""), r[1] or "") for r in ROWS]
    assert got == {(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in ids}
    frame = byte_bpe.encode_documents(docs.withColumnRenamed("term", "ids"), keep=("doc_id", "ids", "text"))
    back = byte_bpe.decode_documents(frame, keep=("doc_id", "text"))
    assert frame.columns == ["doc_id", "input_ids", "text", "n_tokens", "ids"] and back.columns == ["doc_id", "input_text", "text"]
    assert all((r.input_text or "") == r.text for r in back.collect())
    assert byte_bpe.token_digests(docs.limit(0)).count() == 0
