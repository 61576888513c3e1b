"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from one pattern for each kind, leftmost and non-overlapping,
less the matches that fail their check. The field then labels every
number-like or address-like stretch of a document (a unit) with a kind or none.
Units next to each other share a chain potential; units with the same key, such as
the same digits written another way, share a skip potential however far apart
they are, through one hub for each key, so a key with many units stays linear.
Two more hubs join units with the same stem (the last LONG_STEM or STEM digits, or
what stands before the at sign less a +tag), with weights of their own. Runs of digits are cut at
base spans, and where some of their groups are a known number or its end.
Units under a base span are clamped to its kind. Loopy sum-product messages run
over units and hubs of every document, and a unit that base patterns missed becomes a
span of its most likely kind, if that isn't none. Base spans stay.

Weights are learned by pseudo-likelihood on the units of at most TRAIN_DOCUMENTS
documents, those with the smallest hash of doc_id, of at most TRAIN_UNITS units each.
Base spans are their labels, and whether a unit lies under one is a feature, its own
evidence. To learn what links are worth without it, each base unit is planted again
with its evidence masked: linked to itself by key and stems, by stems or by the short
stem alone, with its kind as label, and unlinked, with none as label.

Defined results: null and empty texts have no spans; a null doc_id is searched
like any other; repeated rows give equal rows; an empty table gives an empty
table. Only the named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, small_batches

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: What stands before and after an at sign, in an address and in any word. Matched from the sign outwards, so long words stay linear.
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
WORD_CHAR, WORD_REST = re.compile(r"[^\x20\x09-\x0D@]"), re.compile(r"[^\x20\x09-\x0D@]+")
#: Number-like stretches of seven digits or more.
NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
#: Digits at the end of a number that make its stems, and the least weights of the hubs of keys, long and short stems.
LONG_STEM, STEM, LEAST_SKIPS = 9, 7, (1.0, 1.0, 0.5)
#: Not part of an address at its ends.
EDGE = ".,;:()<>[]\"'"
TRAIN_DOCUMENTS, TRAIN_UNITS, STEPS, PENALTY, ROUNDS = 2_000, 50, 200, 1e-3, 10
N_FEATURES, EVIDENCE, AT_SIGN, N_LABELS = 11, 1, 7, 1 + len(KINDS)
_CLAMP = 50.0
Span = tuple[str, int, int]


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _passes(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))
    if kind == "card":
        d = _digits(s)
        return 16 <= len(d) <= 19 and luhn(d)
    return 8 <= len(_digits(s)) <= 15


def _around_at_signs(text: str, before: re.Pattern, after: re.Pattern) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of before+ @ after."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and before.match(text, start - 1):
            start -= 1
        tail = after.match(text, at + 1) if start < at else None
        if tail:
            done = tail.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind as listed, then by start; code points, end exclusive."""
    out: list[Span] = [("email", *span) for span in _around_at_signs(text, LOCAL, DOMAIN)]
    for kind, needs in (("ip", "."), ("card", ""), ("phone", "+")):
        if needs in text:
            out += [(kind, *m.span()) for m in PATTERNS[kind].finditer(text) if _passes(kind, m.group())]
    return out


def _split(text: str, start: int, end: int, known: set[str], tails: set[str]) -> list[tuple[int, int, str]]:
    """The units of a run of digits: groups that make a known number, else the end of one, and the stretches between them."""
    groups = [(start + m.start(), start + m.end()) for m in re.finditer("[0-9]+", text[start:end])]
    out, at, i = [], 0, 0

    def put(a: int, b: int, least: int = STEM) -> None:
        if a < b and len(d := _digits(text[groups[a][0] : groups[b - 1][1]])) >= least:
            out.append((groups[a][0], groups[b - 1][1], d.lstrip("0")))

    while i < len(groups):
        keys, d = [], ""
        for j in range(i, len(groups)):
            d += text[slice(*groups[j])]
            if len(d) > 24:
                break
            keys.append(d.lstrip("0"))
        n = next((n for n in range(len(keys), 0, -1) if keys[n - 1] in known), 0) or next((n for n in range(len(keys), 0, -1) if keys[n - 1] in tails), 0)
        if n:
            put(at, i)
            put(i, i + n, 1)
            at = i + n
        i += n or 1
    put(at, len(groups))
    return out


def units(text: str, base: list[Span] = ()) -> list[tuple[int, int, str]]:
    """Start, end and key of each unit. Keys: the digits without leading zeros, however written, or the lower-cased address."""
    around = list(_around_at_signs(text, WORD_CHAR, WORD_REST))
    inside = np.array([x for span in around for x in span])
    words = [(hi - len(raw.lstrip(EDGE)), lo + len(raw.rstrip(EDGE)), raw.strip(EDGE).lower()) for lo, hi in around for raw in (text[lo:hi],)]
    cuts = sorted({x for _, lo, hi in base for x in (lo, hi)})
    spans = sorted((lo, hi) for _, lo, hi in base)
    covered, free, reach, at = [], [], 0, 0
    for m in NUMBER.finditer(text):
        if np.searchsorted(inside, m.start(), "right") % 2:
            continue
        lo, hi = m.span()
        edges = [lo, *cuts[bisect_right(cuts, lo) : bisect_left(cuts, hi)], hi]
        for a, b in zip(edges, edges[1:]):
            while at < len(spans) and spans[at][0] <= a:
                reach, at = max(reach, spans[at][1]), at + 1
            (covered if a < reach else free).append((a, b))
    out = [(a, b, _digits(text[a:b]).lstrip("0")) for a, b in covered]
    out = [u for u in out if u[2]]
    known = {k for _, _, k in out if STEM <= len(k) <= 24}
    tails = {t for k in known for n in range(STEM, len(k)) if len(t := k[-n:].lstrip("0")) >= STEM}
    for a, b in free:
        out += _split(text, a, b, known, tails)
    return sorted(words + out)


def _stem(key: str, digits: int) -> str:
    """What a key shares with other ways to write it; numbers as long as a card's are never written in part."""
    if "@" in key:
        return key.split("@")[0].split("+")[0] + "@"
    return key[-digits:] if len(key) <= 15 else key


def _features(s: str, evidence: bool) -> list[float]:
    d = _digits(s)
    groups = s.split(".")
    return [1.0, evidence, len(d) < 8, 8 <= len(d) <= 12, 12 < len(d) <= 15, 16 <= len(d) <= 19, len(d) > 19, "@" in s, len(groups) == 4 and all(map(str.isdigit, groups)), any(c in s for c in " ()-"), luhn(d)]


def graph(text: str, base: list[Span]) -> tuple[list[tuple[int, int, str]], np.ndarray, np.ndarray, np.ndarray]:
    """Units, their features, base labels (0: none) and the numbers of its key and stems."""
    found = units(text, base)
    labels = np.zeros(len(found), np.int64)
    starts, ends = [lo for lo, _, _ in found], [hi for _, hi, _ in found]
    for kind, start, end in base:
        labels[bisect_right(ends, start) : bisect_left(starts, end)] = 1 + KINDS.index(kind)
    keys: dict[str, int] = {}
    names = [(k, f"l {_stem(k, LONG_STEM)}", f"s {_stem(k, STEM)}") for _, _, k in found]
    numbers = np.array([[keys.setdefault(name, len(keys)) for name in row] for row in names], np.int64).reshape(-1, 3)
    return found, np.array([_features(text[lo:hi], y > 0) for (lo, hi, _), y in zip(found, labels.tolist(), strict=True)], float).reshape(-1, N_FEATURES), labels, numbers


def _neighbours(labels: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each unit, the labels next to it in the chain, and whether its key, then each stem, has each label elsewhere."""
    one = np.eye(N_LABELS)[labels]
    chain = np.zeros_like(one)
    chain[1:] += one[:-1]
    chain[:-1] += one[1:]
    skips = []
    for hub in keys.T:
        per_hub = np.zeros((hub.max() + 1, N_LABELS))
        np.add.at(per_hub, hub, one)
        skips.append((per_hub[hub] - one > 0).astype(float))
    return chain, *skips


class Weights:
    """Of unit features by label, of the chain and of the skip potentials by key and by stems."""

    def __init__(self):
        self.unary, self.chain, self.skips = np.zeros((N_FEATURES, N_LABELS)), 0.0, list(LEAST_SKIPS)
        self.unary[0, 0] = 0.5  # where nothing else speaks, none

    def learn(self, x: np.ndarray, y: np.ndarray, chain: np.ndarray, *skips: np.ndarray) -> Weights:
        """Gradient ascent on the pseudo-likelihood; the skip weights stay at LEAST_SKIPS or more."""
        if not len(x):
            return self
        target = np.eye(N_LABELS)[y]
        for _ in range(STEPS):
            z = x @ self.unary + self.chain * chain + sum(v * skip for v, skip in zip(self.skips, skips, strict=True))
            p = np.exp(z - z.max(1, keepdims=True))
            gap = target - p / p.sum(1, keepdims=True)
            self.unary += 0.5 * (x.T @ gap / len(x) - PENALTY * self.unary)
            self.chain += 0.5 * ((gap * chain).sum() / len(x) - PENALTY * self.chain)
            self.skips = [max(least, v + 0.5 * ((gap * skip).sum() / len(x) - PENALTY * v)) for least, v, skip in zip(LEAST_SKIPS, self.skips, skips, strict=True)]
        return self


def _soft(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def beliefs(x: np.ndarray, clamped: np.ndarray, keys: np.ndarray, w: Weights, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of units after loopy sum-product over the chain and the hubs of keys and stems."""
    n, z, email = len(x), x @ w.unary, 1 + KINDS.index("email")
    address = x[:, AT_SIGN] > 0
    z[~address, email] = -_CLAMP  # only what has an at sign is an address, and nothing else
    z[np.ix_(address, [c for c in range(1, N_LABELS) if c != email])] = -_CLAMP
    own = np.log(_soft(z))
    own[clamped > 0] = 0
    own[clamped > 0, clamped[clamped > 0]] = _CLAMP
    chain, skips = np.exp(w.chain * np.eye(N_LABELS)), [np.exp(v * np.eye(N_LABELS)) for v in w.skips]
    right, left, *hubs = (np.zeros((n, N_LABELS)) for _ in range(2 + keys.shape[1]))
    for _ in range(rounds):
        new_hubs = []
        for i, (hub, skip) in enumerate(zip(keys.T, skips, strict=True)):
            up = np.log(_soft(own + right + left + sum(hubs) - hubs[i]) @ skip)
            sums = np.zeros((hub.max() + 1, N_LABELS))
            np.add.at(sums, hub, up)
            new_hubs.append(np.log(_soft(sums[hub] - up) @ skip))
        new_right, new_left = np.zeros_like(right), np.zeros_like(left)
        new_right[1:] = np.log(_soft(own + right + sum(hubs))[:-1] @ chain)
        new_left[:-1] = np.log(_soft(own + left + sum(hubs))[1:] @ chain)
        right, left, *hubs = (0.5 * a + 0.5 * b for a, b in zip((right, left, *hubs), (new_right, new_left, *new_hubs), strict=True))
    return _soft(own + right + left + sum(hubs))


def all_spans(text: str | None, w: Weights) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by kind as listed, then by start."""
    if not text or not re.search("[0-9@]", text):
        return [], []
    base = base_spans(text)
    found, x, labels, keys = graph(text, base)
    added: list[Span] = []
    if (labels == 0).any():
        likely = beliefs(x, labels, keys, w).argmax(1)
        added = [(KINDS[c - 1], lo, hi) for (lo, hi, _), c, old in zip(found, likely.tolist(), labels.tolist(), strict=True) if c and not old]
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _planted(x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and labels of masked repeats of the base units: linked by all hubs, by stems, by the short stem, and by none."""
    x, kinds = x[labels > 0].copy(), labels[labels > 0]
    x[:, EVIDENCE] = 0
    near, none = np.eye(N_LABELS)[kinds], np.zeros((len(x), N_LABELS))
    rows = [np.column_stack([x, none, *[near if linked else none for linked in hubs]]) for hubs in ((1, 1, 1), (0, 1, 1), (0, 0, 1), (0, 0, 0))]
    return np.concatenate(rows), np.concatenate([kinds, kinds, kinds, np.zeros_like(kinds)])


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if doc_id is None or not text or not re.search("[0-9@]", text):
                continue
            found, x, labels, keys = graph(text, base_spans(text))
            if 0 < len(found) <= TRAIN_UNITS:
                more, kinds = _planted(x, labels)
                rows.append((doc_id, [*labels.tolist(), *kinds.tolist()], np.concatenate([np.column_stack([x, *_neighbours(labels, keys)]), more]).ravel().tolist()))
        a, b, c = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.list_(pa.int64())), pa.array(c, pa.list_(pa.float64()))], ["doc_id", "labels", "x"])


def train(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Weights:
    """Weights from a bounded sample: at most so many documents, of at most TRAIN_UNITS units each."""
    found = materialize(docs.mapInArrow(_train_rows, "doc_id long, labels array<long>, x array<double>"), "units")
    # a share of the hashes that holds enough rows, so that tasks don't each send the driver a full sample
    slots = 1 << 20
    share = min(slots, 2 + int(1.5 * slots * documents / max(1, found.count())))
    rows = found.where(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < share).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(slots)), "doc_id").limit(documents).collect()
    if not rows:
        return Weights()
    x = np.concatenate([np.array(r.x).reshape(len(r.labels), -1) for r in rows])
    n = N_FEATURES
    return Weights().learn(x[:, :n], np.concatenate([r.labels for r in rows]), *np.split(x[:, n:], 1 + len(LEAST_SKIPS), axis=1))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) for each row of docs; both as kind:start:end, comma-joined."""
    docs = _narrow(docs, id_col, text_col)
    weights = train(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t, weights) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_written(b) for b, _ in found], pa.string()), pa.array([_written(s) for _, s in found], pa.string())], ["doc_id", "base", "spans"])

    return docs.mapInArrow(find, "doc_id long, base string, spans string")


def redact(text: str | None, spans: list[Span]) -> str | None:
    """Each stretch covered by spans replaced by the kind of the span that starts it."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with personal data replaced by its kind, and length_col, if there, brought up to date."""
    weights = train(_narrow(docs, id_col, text_col))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [redact(t, all_spans(t, weights)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text_col, pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(clean, docs.schema)
    return out.withColumn(length_col, F.length(text_col).cast(out.schema[length_col].dataType)) if length_col in docs.columns else out


def op5_query(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")
