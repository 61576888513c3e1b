"""Search over postings: phrases, prefixes, folding, filters, limits and quotations by hand."""

from loomline.operators import postings

KINDS = "dedup_key string, tool string, session_id string, project string, timestamp timestamp_ntz, origin string, user_text string, assistant_text string"


def archive(spark, texts):
    """One turn a session from (user_text, assistant_text)."""
    return spark.createDataFrame([(f"k{i}", "t", f"s{i}", "/p/" if i % 2 else "/p", None, "full" if i else "prompt", u, a) for i, (u, a) in enumerate(texts)], KINDS)


def keys(spark, texts, query, **filters):
    turns = archive(spark, texts)
    return sorted(r.dedup_key for r in postings.matches(postings.build_index(turns), turns, query, **filters).collect())


def test_terms_phrases_prefixes_and_diacritics(spark):
    texts = [("Élan vital", None), ("vital elan", "data-set"), ("set data", "élans"), (None, None), ("", "a data set here")]
    assert keys(spark, texts, "ELAN") == ["k0", "k1", "k2"]
    assert keys(spark, texts, "élan vital") == ["k0", "k1"]
    assert keys(spark, texts, "data-set") == ["k1", "k4"]
    assert keys(spark, texts, 'data-se"') == ["k1", "k4"]
    assert keys(spark, texts, '"" -') == keys(spark, texts, "vita élan") == []
    assert keys(spark, texts, "e", project="/p") == ["k0", "k1", "k2"]
    assert keys(spark, texts, "e", project="/p/") == ["k1"]
    assert keys(spark, texts[:0], "e") == []


def test_limits_order_and_costs(spark):
    turns = archive(spark, [("word " * (i + 1), "") for i in range(60)])
    found = postings.matches(postings.build_index(turns), turns, "word")
    best = postings.best_sessions(found, 99)
    calls = spark.createDataFrame([("t", "s59", 2.0), ("t", "s59", 1.0)], "tool string, session_id string, cost double")
    rows = postings.with_costs(best, calls).orderBy("place").collect()
    assert len(rows) == 50 and {r.total for r in rows} == {60} and [r.place for r in rows] == list(range(1, 51))
    assert [r.best for r in rows] == sorted(r.best for r in rows)
    assert {r.session_id: r.cost for r in rows if r.cost} == ({"s59": 3.0} if "s59" in {r.session_id for r in rows} else {})
    assert postings.best_sessions(found).count() == 20


def test_quotes_mark_hits_and_prefer_the_user(spark):
    long = " ".join(f"w{i}" for i in range(40))
    turns = archive(spark, [(f"{long} déjà vu, {long}", "deja vu"), ("none", "So: deja vu!")])
    found = postings.matches(postings.build_index(turns), turns, "deja-vu")
    got = {r.dedup_key: (r.role, r.snippet) for r in postings.quotes(found, postings.best_sessions(found), turns).collect()}
    a, b = postings.HIT
    assert got["k0"] == ("user", f"…w35 w36 w37 w38 w39 {a}déjà{b} {a}vu{b}, w0 w1 w2 w3 w4 …")
    assert got["k1"] == ("assistant", f"So: {a}deja{b} {a}vu{b}!")
