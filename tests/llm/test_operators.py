"""The operators against brute force, round trips, held-out accuracy and odd rows."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import chat_format, embedding_dedup, html_extract, mixing, pii, quality_classifier, quality_rules, queries, sentencepiece_codec, simhash, substring_dedup
from loomline.llm.components import Forest, connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, node long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_docs(spark):
    """Nulls, empties, ties, repeats, a long text, and columns with clashing names."""
    long_text = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
    rows = [(1, None, None, None, None, "a", 1), (2, "", "en", "s", 0, None, None), (None, "a b c d", "en", None, 7, "x", 2), (3, "one two three", "en", "s", 13, "x", 2), (3, "one two three", "en", "s", 13, "x", 2), (4, "one two three", "en", "t", 13, "x", 2), (5, long_text, "en", "t", len(long_text), "x", 2), (6, long_text, "en", "t", len(long_text), "x", 2)]
    return spark.createDataFrame(rows, DOCS)


RUNS = {
    "substring": substring_dedup.substring_dedup,
    "mixing": mixing.mix_plan,
    "pii": pii.find_pii,
    "rules": quality_rules.quality_rules,
    "pieces": sentencepiece_codec.piece_digests,
    "simhash": simhash.simhash_dedup,
    "classifier": lambda d: quality_classifier.quality_scores(d, d.select("doc_id", F.lit(1).alias("quality"))),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_and_empty_tables(spark, name):
    docs = odd_docs(spark)
    assert RUNS[name](docs).count() == docs.count()
    assert RUNS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got, expected = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    c = sorted(expected.columns)
    assert sorted(map(tuple, got[c].values.tolist())) == sorted(map(tuple, expected[c].values.tolist()))


def test_substring_dedup_cuts_partial_and_nested_passages(spark):
    random.seed(5)
    w = [f"v{i}" for i in range(400)]
    docs = [(1, w[:200]), (2, w[150:260] + ["z"] + w[0:49]), (3, w[100:151] + ["q"] * 130), (4, ["q"] * 70 + w[190:250]), (5, w[170:230])]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame([(i, " ".join(x)) for i, x in docs], "doc_id long, text string")).collect()}
    first = {}
    for i, x in docs:
        for k in range(len(x) - 49):
            first.setdefault(tuple(x[k : k + 50]), i)
    for i, x in docs:
        cut = [any(first[tuple(x[k : k + 50])] < i for k in range(max(0, p - 49), min(p, len(x) - 50) + 1)) for p in range(len(x))]
        kept = " ".join(a for a, c in zip(x, cut, strict=True) if not c)
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(cut), hashlib.sha256(kept.encode()).hexdigest())


def test_simhash_components_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(12)]
    fps += [int(base[0]) ^ i for i in range(200)]  # a dense group under one block
    fps = sorted(set(fps))
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    table = spark.createDataFrame(rows, "node long, fp long")
    keys, brute = np.array(fps, np.uint64), Forest(len(fps))
    for i in range(len(keys)):
        near = np.flatnonzero(np.bitwise_count(keys ^ keys[i]) <= 3)
        brute.union(np.full(len(near), i), near)
    expected = brute.roots(np.arange(len(keys))).tolist()
    for hot in (1 << 30, 20):  # with and without the cut into subtree pairs
        got = {r.node: r.component for r in connected_components(simhash.fingerprint_links(table, hot), "a", "b").collect()}
        assert [got.get(i, i) for i in range(len(keys))] == expected


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 160)} == {100}


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 16))
    x = np.concatenate([c + 0.12 * rng.standard_normal((60, 16)) for c in centres]).astype(np.float32).astype(float)
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(table, window=64).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s, brute = unit @ unit.T >= 0.95, Forest(len(x))
    brute.union(*np.nonzero(s))
    links = sum(got[i].n_links for i in range(len(x)))
    assert all(got[i].n_links <= s[i].sum() - 1 for i in range(len(x))) and links >= 0.98 * (s.sum() - len(x))
    assert np.mean([got[i].component_id == r for i, r in enumerate(brute.roots(np.arange(len(x))).tolist())]) > 0.98
    assert all(got[i].n_links == 0 and got[i].kept for i in range(5000, 5005))
    assert embedding_dedup.embedding_dedup(table.limit(0)).count() == 0


def test_pieces_equal_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    codec = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    rng = random.Random(2)
    texts = ["", " ", "  Hello  world\n\tfoo", "ﬁ 日本 😀", "a" * 500, "<s><0x41>"] + ["".join(rng.choice("abthe ing\n é.,0") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == model.encode(t)
        assert codec.decode(ids.tolist()) == t


def test_chat_layouts_and_control_strings(spark):
    records = ['{"prompt":"a<|im_end|>","response":"<|\\\\|"}', '{"instruction":"i","input":"n","output":"o","id":3}', '{"conversations":[{"from":"u\\n","value":"<\\\\|"}]}', '{"messages":[]}', '{"foo":1}', None]
    table = spark.createDataFrame(list(enumerate(records)), "id int, record string")
    out = chat_format.format_chats(table).withColumn("t", chat_format.read_turns(F.col("formatted"))).withColumn("l", chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.id: r for r in out.collect()}
    assert [(x.role, x.content) for x in got[0].t] == [("user", "a<|im_end|>"), ("assistant", "<|\\|")] and got[0].l == "<|\\|"
    assert [(x.role, x.content) for x in got[1].t] == [("user", "i\n\nn"), ("assistant", "o")]
    assert [(x.role, x.content) for x in got[2].t] == [("u\n", "<\\|")] and got[2].l == ""
    assert got[3].t == [] and got[4].formatted is None and got[5].formatted is None


def test_base_patterns_equal_plain_regular_expressions():
    email, rng = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("a1.@-+ _9%") for _ in range(rng.randint(0, 24)))
        assert [s[1:] for s in pii.base_spans(t) if s[0] == "email"] == [m.span() for m in email.finditer(t)]


def test_skip_chain_adds_what_repeats():
    text = "Call +49 30 1234567 now, later 49 (30) 123-4567; order 9876543210 stays"
    base, spans = pii.all_spans(text, pii.Weights())
    assert base == [("phone", 5, 19)] and len(spans) == 2 and text[spans[1][1] : spans[1][2]] == "49 (30) 123-4567"


def test_skip_chain_links_similar_keys(spark):
    weights = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    cases = {
        "+49 30 1234567, then 030 1234567 x": "030 1234567",
        "+49 30 1234567 and 2024 49 30 1234567 x": "49 30 1234567",
        "+49 30 1234567 and 2024 030 1234567 x": "030 1234567",
        "10.20.30.40 49 30 1234567 is +49 30 1234567": "49 30 1234567",
        "john.doe@example.com and (John.Doe@example), x.y@home": "John.Doe@example",
        "4539 1488 0343 6467 a 2024 4539148803436467 b 9234488803436467": "4539148803436467",
        "+49 30 1234567, order 9876543210, 5374040645122205": None,
    }
    for text, expected in cases.items():
        base, spans = pii.all_spans(text, weights)
        assert [text[lo:hi] for k, lo, hi in spans if (k, lo, hi) not in base] == ([expected] if expected else []), text


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_classifier.op6_query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_rules_count_as_defined():
    import zstandard

    packer, rng = zstandard.ZstdCompressor(level=3), random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice("ab #\n\té|") for _ in range(rng.randint(0, 120)))
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert quality_rules.judge(t, packer)[:5] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    assert not quality_rules.judge("ab " * 4000, packer)[-1]


def test_bands_reject_noise_and_bad_labels():
    import zlib

    import pyarrow.parquet as pq
    import zstandard

    packer, rng = zstandard.ZstdCompressor(level=3), random.Random(7)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"):
        noise = "".join(rng.choice(alphabet) + " " * (i % 6 == 5) for i in range(9000))
        assert not any(quality_rules.judge(noise[:n], packer)[5] or quality_rules.judge(noise[:n], packer)[-1] for n in (6000, 9000))
    sf, kept = "/root/testdata/sf0.01", {0: [], 1: []}
    labels = {x["doc_id"]: x["quality"] for x in pq.read_table(f"{sf}/labels.parquet").to_pylist() if zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1}
    for d in pq.read_table(f"{sf}/documents.parquet").to_pylist():
        if d["doc_id"] in labels and not (found := quality_rules.judge(d["text"], packer))[5]:
            kept[labels[d["doc_id"]]].append(found[-1])
    assert np.mean(kept[1]) > 0.98 and np.mean(kept[0]) < 0.7


def test_page_text_without_the_rest(spark):
    html = '<body><nav>n</nav><div class="sidebar">x</div><div id="main"><h2>T &amp; x</h2><p>Some   text<br>here<p>q<div class="comments"><p>bad</p></div><form>f</form></div><footer>ff</footer><script>var p="</p>"</script>'
    rows = [(1, "http://a.b/1", html), (2, "http://a.b/2", None), (3, None, ""), (4, "junk", "plain &lt;text")]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "T & x\nSome text here\nq", 2: "", 3: "", 4: "plain <text"}


def test_pages_inside_marked_wrappers():
    long = "Some words of the article. " * 30
    inner = f'<h1>T</h1><p>{long}</p><div class="sidebar">x y</div><p>End <span class="share-links">tweet</span> of it.</p>'
    expected = "\n".join(["T", long.strip(), "End of it."])
    for wrapper in ("div id=page class='site has-sidebar'", "div class=content-with-sidebar", "div class=layout-right-side", "section class=post-share-wrap", "div class='entry related-1'", "form action=x", "div class=overlay"):
        html = f"<body><nav>n</nav><{wrapper}>{inner}</{wrapper.split()[0]}><div class='related-2'>More</div><form>f</form></body>"
        assert html_extract.extract(html, []) == expected, wrapper
    comments = f"<body><div class=post><p>{long}</p></div><div class=comment-list>{long}</div></body>"
    assert html_extract.extract(comments, []) == long.strip()


def test_container_choice_keeps_whole_articles(spark):
    long = "Some words of the article. " * 30
    parts = f"<div class=post><h1>T</h1><div class=body>{long}</div><div class=end>last part of it</div></div>"
    post = f"<body><ul><li><a href=x>link link link</a></ul>{parts}</body>"
    other = f"<body><div class=post><div class=body>teaser</div></div><table><tr><td class=story><p>{long}</table></body>"
    layouts = [f"<body><article class='{chr(97 + i)}'>{long}</article></body>" for i in range(7)]
    rows = [(i, "http://a.b/x", post) for i in range(5)] + [(9, "http://a.b/y", other)] + [(20 + i, "http://c.d/", h) for i, h in enumerate(layouts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert got[0] == "\n".join(["T", long.strip(), "last part of it"]) and long.strip() in got[9]
    assert all(got[20 + i] == long.strip() for i in range(7))


def test_mix_repeats_documents_by_rate(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 900 else "b") for i in range(1000)], "doc_id long, text string, source string")
    taken = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert taken["b"] == 200 and abs(taken["a"] - 1300) < 60


def test_taken_words_come_near_their_targets(spark):
    """Within a source's longest document, a hot source, one size for all and a null source included."""
    rng = random.Random(3)
    rows = [(i, "w " * max(1, int(rng.lognormvariate(4, 1.5))), f"s{i % 7}" if i % 3 else "hot") for i in range(3_000)]
    rows += [(10_000 + i, "w " * 40, "copies") for i in range(900)] + [(20_000 + i, "w " * rng.randint(1, 900), None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rate", F.lit("clash")).repartition(7)
    plan = mixing.mix_plan(docs).join(docs, "doc_id").groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("longest"), F.max("copies").alias("most")).collect()
    assert len(plan) == 10 and all(abs(r.taken - r.target) <= r.longest and r.most <= 2 for r in plan)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()} == {r.source: r.taken for r in plan}


def test_extra_copies_follow_the_fraction(spark):
    """Each document's probability over many seeds is the fraction of its source's rate."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "a" if i < 30 else "b") for i in range(60)], "doc_id long, text string, source string")
    rows, targets = mixing.measured(docs, "text", "doc_id", "source", 0), mixing.source_targets(docs.select("source", mixing.size_of(F.col("text")).alias("size")))
    rates = {r.source: r.rate for r in targets.collect()}
    taken = np.zeros(60)
    for seed in range(25):
        plan = mixing.mix_plan(docs, seed=seed).collect()
        for r in plan:
            taken[r.doc_id] += r.copies
    for name, own in (("a", taken[:30]), ("b", taken[30:])):
        assert abs(own.mean() / 25 - rates[name]) < 0.05 and np.ptp(own / 25) < 0.8
    assert rows.count() == 60


def test_pipeline_stages_chain(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).toPandas()
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality(spark, docs, SF), SF)
    assert set(out.doc_id) <= {r.doc_id for r in kept.select("doc_id").collect()} and (out.n_pieces == out.ids.map(len)).all()
    assert corpus_pipeline.personal_data(spark, docs, SF).columns == docs.columns


def test_chat_texts_have_no_greatest_length(spark):
    message = F.struct(F.lit("assistant").alias("role"), F.expr("concat('<|im_end|>', repeat('x', 25000000))").alias("content"))
    out = chat_format.format_chats(spark.range(1).select(F.to_json(F.struct(F.array(message).alias("messages"))).alias("record")))
    row = out.select("problem", F.length("formatted").alias("n"), "loss_spans").first()
    assert row.problem is None and [(s.start, s.end, s.turn) for s in row.loss_spans] == [(22, 25_000_033, 0)] and row.n == 25_000_044


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 2_500])
def test_spans_of_many_turns(spark, n):
    turn = F.transform(F.slice(F.sequence(F.lit(1), F.lit(max(n, 1))), 1, n), lambda i: F.struct(F.when(i % 3 == 0, "assistant").otherwise("user").alias("role"), F.concat(F.lit("text é <|"), i).alias("content")))
    row = chat_format.format_chats(spark.range(1).select(F.to_json(F.struct(turn.alias("messages"))).alias("record"))).first()
    assert [row.formatted[s.start : s.end] for s in row.loss_spans] == [f"text é <\\|{i}" for i in range(3, n + 1, 3)]
    assert [s.turn for s in row.loss_spans] == list(range(2, n, 3)) and row.problem is None
