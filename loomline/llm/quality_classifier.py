"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics. Class means and
covariances come from sums that Spark aggregates over all labelled rows meant for
training (those whose crc32(doc_id as text) mod 3 is not 1), so the fit needs no
sample. A class covariance is shrunk towards the pooled one and that towards its
diagonal; its Cholesky factor is inverted once and shipped with the scoring
tasks. The score is the logistic of the difference of the two log densities and
log priors.

Labels, lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts have the statistics of an empty text and a
score like any other; a null doc_id is scored, never learned from, and not held
out; repeated rows score alike; without training rows of both classes every score
is the smoothed share of label 1; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .storage import free_name, materialize, small_batches
from .words import Shingles

#: Shares of the pooled covariance in a class's, and of the diagonal in the pooled one.
TO_POOLED, TO_DIAGONAL = 0.1, 0.1
HELD_OUT, FOLDS, REPEAT_WINDOW = 1, 3, 8


def _byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER = _byte_set(bytes(range(65, 91))), _byte_set(bytes(range(97, 123)))
_DIGIT, _STOP, _LOUD = _byte_set(b"0123456789"), _byte_set(b".,;:"), _byte_set(b"!?")
_SPACE = _byte_set(b" \t\n\r\x0b\x0c")
_SYMBOL = _byte_set(bytes(range(33, 127))) & ~(_UPPER | _LOWER | _DIGIT | _STOP | _LOUD | _byte_set(b"'\"-()"))
N_STATISTICS = 14
#: Added to counts, so that a few words don't make an extreme share.
SMOOTH = 50


def statistics(text: str | None, packer: zstandard.ZstdCompressor) -> list[float]:
    """Transformed statistics of one text: logarithms of lengths, square roots of shares."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, codes = raw.split(), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, size, lines = len(words), len(raw) + SMOOTH, [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    h = Shingles(words).hashes(REPEAT_WINDOW)
    p = codes[codes > 0] / max(1, len(raw))
    share = lambda chars: math.sqrt(int(codes[chars].sum()) / size)
    letters = SMOOTH + int(codes[_UPPER | _LOWER].sum())
    return [
        math.log(n + SMOOTH),
        math.log((len(raw) - int(codes[_SPACE].sum()) + 5 * SMOOTH) / (n + SMOOTH)),
        share(_SYMBOL),
        share(_LOUD),
        share(_DIGIT),
        share(_STOP),
        math.sqrt(int(codes[_UPPER].sum()) / letters),
        math.log(len(counts) + SMOOTH) - math.log(n + SMOOTH),
        math.sqrt((len(h) - len(np.unique(h))) / (n + SMOOTH)),
        math.sqrt((len(lines) - len(set(lines))) / (len(lines) + 5)),
        math.sqrt(max(counts.values(), default=0) / (n + SMOOTH)),
        math.log(len(raw) / max(1, len(lines)) + SMOOTH),
        float(-(p * np.log(p)).sum()) if len(p) else 0.0,
        len(packer.compress(raw)) / (size + SMOOTH),
    ]


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        rows = [statistics(t, packer) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class in a task: 1, x and the products x x', summed."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, -1)
        x, y = np.column_stack([np.ones(len(x)), x]), batch.column("quality").to_numpy()
        for label in (0, 1):
            own = x[y == label]
            total[label] = total.get(label, 0) + own.T @ own
    for label, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, label, np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], ["quality", "place", "total"])


class Discriminant:
    """Means, inverse Cholesky factors, log determinants and priors of two classes."""

    def __init__(self, moments: dict[int, np.ndarray]):
        counts = {c: float(m[0, 0]) for c, m in moments.items()}
        d = N_STATISTICS
        self.share = (counts.get(1, 0.0) + 1) / (sum(counts.values()) + 2)
        self.classes = None
        if min(counts.get(0, 0), counts.get(1, 0)) < 2:
            return
        means = {c: moments[c][0, 1:] / counts[c] for c in (0, 1)}
        scatter = {c: moments[c][1:, 1:] - counts[c] * np.outer(means[c], means[c]) for c in (0, 1)}
        n = counts[0] + counts[1]
        pooled = (scatter[0] + scatter[1]) / n + 1e-6 * np.eye(d)
        pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled))
        self.classes = []
        for c in (0, 1):
            cov = (1 - TO_POOLED) * scatter[c] / counts[c] + TO_POOLED * pooled
            factor = np.linalg.cholesky(cov)
            self.classes.append((means[c], np.linalg.inv(factor).T, 2 * np.log(np.diag(factor)).sum(), math.log(counts[c] / n)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None or not len(x):
            return np.full(len(x), self.share)
        density = [prior - 0.5 * (det + (((x - mean) @ inverse) ** 2).sum(1)) for mean, inverse, det, prior in self.classes]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -700, 700)))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) for each row of docs."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_statistics_batches, "doc_id long, stats array<double>")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on all rows of stats with a label that are not held out; what is collected is two small matrices."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    rows = stats.join(known, "doc_id").where(~held_out()).select("quality", "stats")
    sums = rows.mapInArrow(_sums, "quality int, place int, total double").groupBy("quality", "place").agg(F.sum("total").alias("total")).collect()
    side = N_STATISTICS + 1
    moments: dict[int, np.ndarray] = {}
    for label, place, total in sums:
        moments.setdefault(label, np.zeros((side, side)))[divmod(place, side)] = total
    return Discriminant(moments)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    stats = materialize(document_statistics(docs), "statistics")
    model = fit(stats, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    scored = stats.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score of at least 0.5, with all their columns. Texts are measured once, in the scan that writes them with their statistics, and not shuffled."""
    small_batches(docs.sparkSession)
    name = free_name(docs, "stats")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = [statistics(t, packer) for t in batch.column("text").to_pylist()]
            yield batch.append_column(name, pa.array(rows, pa.list_(pa.float64())))

    measured = materialize(docs.mapInArrow(measure, StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))])), "measured")
    model = fit(measured.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("stats")), labels)

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(stats.tolist()).reshape(len(stats), -1)))

    return measured.where(score(F.col(name)) >= 0.5).drop(name)


def op6_query(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
