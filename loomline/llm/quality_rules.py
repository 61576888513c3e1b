"""Quality rules with compression bands.

A text's zstandard ratio (compressed over raw bytes) is held against a band whose
limits depend on length, for the whole document and for fixed chunks of bytes:
below it the text repeats itself, above it the text doesn't compress as language
does. Short texts compress little, so the bands open as length falls; a chunk too short
to judge counts neither way. Repeated windows are found by comparing words.

Defined results: null and empty texts have no words and fail the base rule; a
null doc_id is kept as it is; repeated rows are judged alike; an empty table
gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches
from .words import repeated_runs

LEVEL, REPEAT_WINDOW, MIN_WORDS, REPEAT_PERCENT = 3, 8, 20, 30
CHUNK_BYTES, CHUNK_LEAST = 4096, 1_000
#: Length in bytes, lowest and highest ratio kept there; in between by the logarithm of the length, no limit below the first.
#: Low: four deviations under the mean of prefixes of documents labelled 1 and not held out. High: six over it, or ordinary English prose's 95th percentile if higher.
BANDS = (
    (200, 0.575, 0.93), (300, 0.547, 0.85), (400, 0.54, 0.80), (600, 0.522, 0.72), (1_000, 0.486, 0.625), (1_500, 0.472, 0.59), (2_000, 0.463, 0.565),
    (3_000, 0.452, 0.535), (4_096, 0.442, 0.515), (6_000, 0.428, 0.49), (10_000, 0.413, 0.475), (20_000, 0.40, 0.45), (100_000, 0.37, 0.45),
)
#: A document goes if more than this share of its chunks of CHUNK_LEAST bytes or more is outside the bands.
CHUNK_SHARE = 0.25
_LENGTHS, _LOWS, _HIGHS = np.log([b[0] for b in BANDS]), [b[1] for b in BANDS], [b[2] for b in BANDS]
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, chunks_outside double, kept boolean"


def fit_bands(docs: DataFrame, labels: DataFrame, lengths: tuple[int, ...] = tuple(b[0] for b in BANDS), below: float = 4.0, above: float = 6.0) -> list[tuple[int, float, float]]:
    """Bands from the documents labelled 1 that are not held out: at each length the mean ratio of their prefixes less and plus so many deviations.

    BANDS are these at sf0.1, the upper ones widened by hand to ordinary English prose. Lengths that fewer than two documents
    reach are left out. Tasks hand on three sums for each length.
    """
    clean = labels.where((F.col("quality") == 1) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1)).select("doc_id").distinct()
    small_batches(docs.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, at = zstandard.ZstdCompressor(level=LEVEL), {n: np.zeros(3) for n in lengths}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                for n in lengths:
                    if len(raw) >= n:
                        r = _ratio(packer, raw[:n])
                        at[n] += (1, r, r * r)
        yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int64()), *[pa.array([x[i] for x in at.values()]) for i in range(3)]], ["length", "n", "sum", "squares"])

    rows = docs.join(clean, "doc_id", "left_semi").select("text").mapInArrow(sums, "length long, n double, sum double, squares double")
    bands = []
    for r in rows.groupBy("length").agg(*[F.sum(c).alias(c) for c in ("n", "sum", "squares")]).orderBy("length").collect():  # one row for each length
        if r.n >= 2:
            mean = r["sum"] / r.n
            deviation = max(0.0, r.squares / r.n - mean * mean) ** 0.5
            bands.append((r.length, mean - below * deviation, mean + above * deviation))
    return bands


def outside(length: int, ratio: float) -> bool:
    if length < BANDS[0][0]:
        return False
    at = np.log(length)
    return not np.interp(at, _LENGTHS, _LOWS) <= ratio <= np.interp(at, _LENGTHS, _HIGHS)


def _ratio(packer: zstandard.ZstdCompressor, raw: bytes) -> float:
    return len(packer.compress(raw)) / len(raw) if raw else 1.0


def judge(text: str | None, packer: zstandard.ZstdCompressor) -> tuple:
    """The values of COLUMNS for one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, codes = raw.split(), np.frombuffer(raw, np.uint8)
    n = len(words)
    spaces = (codes == 32) | (codes >= 9) & (codes <= 13)
    word_chars = int(((codes & 0xC0 != 0x80) & ~spaces).sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    often = repeated_runs(words, REPEAT_WINDOW)
    repeated = 0
    if often.any():
        edges = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(often)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + REPEAT_WINDOW, -1)
        repeated = int((np.cumsum(edges) > 0).sum())
    failed = n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n
    ratio = _ratio(packer, raw)
    chunks = [raw[i : i + CHUNK_BYTES] for i in range(0, len(raw), CHUNK_BYTES)]
    out = [outside(len(c), _ratio(packer, c)) for c in chunks if len(c) >= CHUNK_LEAST]
    share = sum(out) / len(out) if out else 0.0
    kept = not failed and not outside(len(raw), ratio) and share <= CHUNK_SHARE
    return n, word_chars, int(_SYMBOLS[codes].sum()), len(lines) - len(set(lines)), repeated, failed, ratio, share, kept


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    for batch in batches:
        rows = [judge(t, packer) for t in batch.column("text").to_pylist()]
        types = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]] for x in COLUMNS.split(", ")]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", *names])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COLUMNS for each row of docs."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_judge_batches, f"doc_id long, {COLUMNS}")


def op9_query(spark, sf_dir: str) -> DataFrame:
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunks_outside")
