"""Queries that SQL can't express, and the pipeline, against plain Python over a whole small table."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
import zstandard

import corpus_pipeline
from loomline.llm import embedding_dedup, pii, quality_classifier, quality_rules, sentencepiece_codec, simhash
from loomline.llm.components import Forest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return table("documents")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())


def plain_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """The smallest position that each fingerprint reaches."""
    keys, forest = np.array(fps, np.uint64), Forest(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(keys ^ keys[i]) <= 3)
        forest.union(np.full(len(near), i), near)
    return forest.roots(np.arange(len(fps))).tolist()


def plain_scores(docs):
    """Scores by a fit on all labelled rows in memory."""
    packer, x = zstandard.ZstdCompressor(level=1), {}
    for d in docs:
        x[d["doc_id"]] = np.array(quality_classifier.statistics(d["text"], packer))
    moments = {c: np.zeros((quality_classifier.N_STATISTICS + 1,) * 2) for c in (0, 1)}
    for label in table("labels"):
        i = label["doc_id"]
        if i in x and label["quality"] in moments and zlib.crc32(str(i).encode()) % 3 != 1:
            row = np.concatenate([[1.0], x[i]])
            moments[label["quality"]] += np.outer(row, row)
    found = quality_classifier.Discriminant(moments)
    return dict(zip(x, found.score(np.array(list(x.values()))).tolist(), strict=True))


def test_fingerprints_and_groups(spark, docs):
    docs = sorted(docs, key=lambda d: d["doc_id"])
    fps = [plain_fingerprint(d["text"]) for d in docs]
    expected = {d["doc_id"]: (f"{f:016x}", docs[r]["doc_id"]) for d, f, r in zip(docs, fps, plain_components(fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_query(spark, SF).collect()} == expected


def test_personal_data(spark, docs):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    plain = {"email": email, "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}

    def good(kind, s):
        d = [int(c) for c in s if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    got = {r.doc_id: r for r in pii.op5_query(spark, SF).collect()}
    for d in docs:
        base = [f"{k}:{m.start()}:{m.end()}" for k, p in plain.items() for m in p.finditer(d["text"] or "") if good(k, m.group())]
        r = got[d["doc_id"]]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in plain]
        assert set(base) <= set(r.spans.split(",")) or not base


def test_embedding_groups(spark):
    rows = sorted(table("embeddings"), key=lambda r: r["vec_id"])
    ids, x = [], []
    for r in rows:
        v = np.array([float("nan") if c is None else c for c in r["embedding"] or []], float)
        if len(v) and np.isfinite(v).all() and v.any():
            ids.append(r["vec_id"])
            x.append(v / np.linalg.norm(v))
    near = np.array(x) @ np.array(x).T >= 0.95
    forest = Forest(len(x))
    forest.union(*np.nonzero(near))
    expected = {r["vec_id"]: (0, r["vec_id"]) for r in rows}
    expected |= {i: (int(n) - 1, ids[r]) for i, n, r in zip(ids, near.sum(1), forest.roots(np.arange(len(x))).tolist(), strict=True)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.op4_query(spark, SF).collect()}
    assert got == expected


def test_quality_scores(spark, docs):
    expected = plain_scores(docs)
    got = {r.doc_id: r for r in quality_classifier.op6_query(spark, SF).collect()}
    for i, score in expected.items():
        assert abs(got[i].score - score) < 1e-6 and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == int(got[i].score >= 0.5)


def test_base_rules(spark, docs):
    got = {r.doc_id: r for r in quality_rules.op9_query(spark, SF).collect()}
    for d in docs:
        t = d["text"] or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen: dict = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        covered = {p for i, g in enumerate(grams) if seen[g] > 1 for p in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[d["doc_id"]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert r.kept == (not r.base_failed and plain_verdict(t.encode()))


def plain_limits(length):
    """The band at a length, between its neighbours by the logarithm; None below the first."""
    bands = quality_rules.BANDS
    if length < bands[0][0]:
        return None
    for (a, low, high), (b, next_low, next_high) in itertools.pairwise(bands):
        if a <= length <= b:
            part = (math.log(length) - math.log(a)) / (math.log(b) - math.log(a))
            return low + part * (next_low - low), high + part * (next_high - high)
    return bands[-1][1:]


def plain_verdict(raw):
    """Whether the whole and enough of its chunks of 4,096 bytes lie in the bands."""

    def fits(part):
        limits = plain_limits(len(part))
        return limits is None or limits[0] <= len(zstandard.compress(part, 3)) / len(part) <= limits[1]

    chunks = [c for i in range(0, len(raw), 4096) if len(c := raw[i : i + 4096]) >= 1000]
    return fits(raw) and (not chunks or sum(not fits(c) for c in chunks) / len(chunks) <= 0.25)


def test_bands_are_those_of_the_clean_documents(spark):
    """The table in the module, from sf0.1; its upper limits are wider, and the longest lengths are rare."""
    sf = SF.replace("0.001", "0.1")
    fitted = quality_rules.fit_bands(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    known = {length: (low, high) for length, low, high in quality_rules.BANDS}
    assert len(fitted) >= 12
    for length, low, high in fitted:
        assert abs(low - known[length][0]) < (0.003 if length <= 10_000 else 0.01) and -0.005 < known[length][1] - high < 0.03


def test_pieces(spark, docs, model):
    got = {r.doc_id: r for r in sentencepiece_codec.op7_query(spark, SF).collect()}
    for d in docs:
        ids = np.array(model.encode(d["text"] or ""), "<i4")
        assert got[d["doc_id"]].n_pieces == len(ids) and got[d["doc_id"]].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()


def plain_mix(docs):
    """Copies of each document, targets by repeated resharing."""
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs}
    sources = sorted({d["source"] for d in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d["doc_id"]] for d in docs if d["source"] == s) for s in sources}
    weight, target, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}, {}, set(sources)
    left = 1.5 * sum(total.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in full} or {s: share * weight[s] for s in open_}
        left, open_ = left - sum(2.0 * total[s] for s in full), open_ - full if full else set()
    def drawn(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52

    def stratum(n):
        shift = max(n.bit_length() - 8, 0)
        return shift * 256 + (n >> shift)

    out = {}
    for s in sources:
        rate, at = target[s] / total[s] if total[s] else 0.0, drawn(f"{s or ''}/20240131")
        own = sorted((stratum(size[d["doc_id"]]), drawn(f"{d['doc_id']}/20240131"), d["doc_id"]) for d in docs if d["source"] == s)
        done = 0
        for _, group in itertools.groupby(own, key=lambda x: x[0]):
            group = list(group)
            extra = math.floor((done + len(group)) * (rate - int(rate)) + at) - math.floor(done * (rate - int(rate)) + at)
            out |= {i: int(rate) + (k < extra) if size[i] else 0 for k, (_, _, i) in enumerate(group)}
            done += len(group)
    return out


def test_pipeline(spark, docs, model):
    scores = plain_scores(docs)
    kept = [d for d in docs if scores[d["doc_id"]] >= 0.5]
    kept.sort(key=lambda d: d["doc_id"])
    roots = plain_components([plain_fingerprint(d["text"]) for d in kept])
    kept = [d for i, (d, r) in enumerate(zip(kept, roots, strict=True)) if i == r]
    weights = pii.train(spark.createDataFrame([(d["doc_id"], d["text"]) for d in kept], "doc_id long, text string"))
    kept = [d | {"text": pii.redact(d["text"], pii.all_spans(d["text"], weights)[1])} for d in kept]
    copies = plain_mix(kept)
    expected = sorted((d["doc_id"], d["lang"], d["source"], model.encode(d["text"] or "")) for d in kept for _ in range(copies[d["doc_id"]]))
    got = sorted((r.doc_id, r.lang, r.source, list(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == expected
