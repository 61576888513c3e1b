"""An archive that grows by what comes in.

Rows are dealt to buckets by a hash of their key. A batch reads and merges only the
buckets of its keys, and writes those that it changes as new versions beside the old
ones; a line in the archive's log for each of them, written at the end as one file, makes
the batch visible as a whole. So the bytes written follow the batch, readers see whole batches,
a batch that is repeated after it was logged writes nothing, and nothing goes
because its source is missing. Old versions go with vacuum.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import canonical_key
from .archive import KEY, merge_calls
from .shared import written

#: Buckets of a new archive; a bucket should hold some hundred MB at the archive's expected size.
BUCKETS = 64
LOG = "bucket int, batch long, buckets int, n long"
# Fixed values of a past price correction: what a token and a search were charged, and the factors to what they cost.
REPAIRED_MODEL, CHARGED = "claude-opus-5", {"input_tokens": 3e-6, "output_tokens": 15e-6, "cache_write_tokens": 3.75e-6, "cache_read_tokens": 3e-7}
SEARCH_PRICE, FACTOR, FAST_FACTOR = 0.01, 5.0 / 3.0, 2.0


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def log(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest version of each bucket; a row with a null bucket for each batch, with how many buckets it wrote. None before the first batch."""
    if not _exists(spark, f"{folder}/log"):
        return None
    return spark.read.schema(LOG).parquet(f"{folder}/log").groupBy("bucket").agg(F.max("batch").alias("batch"), F.max("buckets").alias("buckets"))


def read(spark: SparkSession, folder: str, only: list[int] | None = None) -> DataFrame | None:
    """The archive as of its last batch, or those of its buckets; None before the first batch."""
    known = log(spark, folder)
    if known is None:
        return None
    # at most one path for each bucket
    live = {r.bucket: r.batch for r in known.where("bucket is not null").collect()}
    schema = spark.read.parquet(f"{folder}/schema").schema
    paths = [f"{folder}/rows/bucket={b}/batch={n}" for b, n in sorted(live.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(spark: SparkSession, folder: str, incoming: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame], DataFrame] = merge_calls, key: tuple[str, ...] = tuple(KEY), buckets: int = BUCKETS) -> dict[str, int]:
    """Merge incoming rows into the archive; merge takes the kept rows of their buckets and them. Counts: incoming and added rows, buckets and rows written.

    batch_ids rise; one that is in the log changes nothing. The number of buckets is that of the first batch.
    """
    counts = {"incoming": 0, "added": 0, "buckets_written": 0, "rows_written": 0}
    known = log(spark, folder)
    if known is not None:
        last = known.agg(F.max("batch"), F.max("buckets")).first()
        if last[0] is not None and last[0] >= batch_id:
            return counts
        buckets = last[1] or buckets
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")
    seen = Observation()
    fresh = written(incoming.observe(seen, F.count(F.lit(1)).alias("n")), "incoming")
    counts["incoming"] = seen.get["n"]
    touched = [r.bucket for r in fresh.select(bucket).distinct().collect()]
    if not touched:
        return counts
    old = read(spark, folder, touched)
    if old is None:
        old = spark.createDataFrame([], fresh.drop("merge_activity").schema)
        old.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{folder}/schema")
    merged = written(merge(old, fresh).select(old.columns), "merged")
    # order-free sums over all columns tell which buckets differ
    content = F.sum(F.xxhash64(F.to_json(F.struct(*old.columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)")).alias("content")
    sums = lambda rows, mark: rows.groupBy(bucket).agg(F.count(F.lit(1)).alias(f"n_{mark}"), content.alias(f"content_{mark}"))
    both = sums(merged, "new").join(sums(old, "old"), "bucket", "left").collect()  # a row for each bucket
    changed = {r.bucket: r.n_new for r in both if (r.n_new, r.content_new) != (r.n_old, r.content_old)}
    counts |= {"added": sum(r.n_new - (r.n_old or 0) for r in both), "buckets_written": len(changed), "rows_written": sum(changed.values())}
    if changed:
        out = merged.withColumns({"bucket": bucket, "batch": F.lit(batch_id).cast("long")}).where(F.col("bucket").isin(list(changed)))
        # what a failed try of this batch left is replaced; a bucket may be several files, so that large ones aren't one task
        out = out.repartition(max(1, min(len(changed), 200)) * 2, "bucket", F.pmod(F.xxhash64(*key) / buckets, F.lit(2)).cast("int"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{folder}/rows")
    lines = [(b, batch_id, buckets, n) for b, n in sorted(changed.items())] + [(None, batch_id, buckets, len(changed))]
    spark.createDataFrame(lines, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    return counts


def vacuum(spark: SparkSession, folder: str) -> int:
    """Remove versions that are no longer read; how many. Not while a reader of an older version runs."""
    known, removed = log(spark, folder), 0
    live = {(r.bucket, r.batch) for r in known.where("bucket is not null").collect()} if known is not None else set()
    if not live:
        return 0
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    number = lambda status: int(status.getPath().getName().split("=")[1])
    for bucket in (x for x in system.listStatus(place) if x.isDirectory()):
        for version in system.listStatus(bucket.getPath()):
            if (number(bucket), number(version)) not in live:
                removed += bool(system.delete(version.getPath(), True))
    return removed


def fingerprints(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, fingerprint) of each file by its length and time of change; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.concat_ws(":", F.lit("file"), "path", "length", F.unix_micros("modificationTime")).alias("fingerprint"))


def sync(spark: SparkSession, sources: str, folder: str, parse: Callable[[DataFrame], DataFrame], read_lines: Callable[[SparkSession, list[str]], DataFrame], pattern: str = "*.jsonl", buckets: int = BUCKETS) -> dict[str, int]:
    """Parse the sources whose fingerprint is new or has changed and merge their calls; fingerprints are kept after the calls.

    A source that is missing leaves its rows and its fingerprint as they are (O18). Counts of the run.
    """
    now = fingerprints(spark, sources, pattern)
    kept = read(spark, f"{folder}/sources")
    changed = written(now if kept is None else now.join(kept, ["path", "fingerprint"], "left_anti"), "changed")
    paths = [r.path for r in changed.select("path").collect()]  # of changed files only
    counts = {"sources_seen": now.count(), "sources_parsed": len(paths), "calls_inserted": 0}
    if not paths:
        return counts
    batch = max((r.batch for name in ("calls", "sources") if (known := log(spark, f"{folder}/{name}")) is not None for r in known.collect()), default=-1) + 1
    calls = parse(read_lines(spark, paths))
    counts["calls_inserted"] = upsert(spark, f"{folder}/calls", calls.withColumn("seq", F.col("line")), batch, merge_calls, buckets=buckets)["added"]
    newest = lambda old, new: old.join(new, "path", "left_anti").unionByName(new)
    upsert(spark, f"{folder}/sources", changed, batch, newest, key=("path",), buckets=buckets)
    return counts


def reset(spark: SparkSession, folder: str) -> None:
    """Drop calls, state and fingerprints."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def repaired_cost(searches: str | None = "web_searches") -> Column:
    """The cost of a call of REPAIRED_MODEL that was charged at its fallback's prices; others keep theirs.

    A row at or over the corrected floor is right already, so a second pass changes nothing.
    """
    model, cost = F.col("model"), F.col("cost")
    factor = F.when(F.col("speed") == "fast", F.lit(FAST_FACTOR)).otherwise(F.lit(1.0))
    search = (F.coalesce(F.col(searches), F.lit(0)) if searches else F.lit(0)) * F.lit(SEARCH_PRICE)
    charged = reduce(Column.__add__, [F.coalesce(F.col(c), F.lit(0)) * F.lit(price) for c, price in CHARGED.items()])
    floor = factor * (charged * F.lit(FACTOR) + search)
    return F.when((canonical_key(model) == REPAIRED_MODEL) & (cost < floor), factor * ((cost - search) * F.lit(FACTOR) + search)).otherwise(cost)


def repair(spark: SparkSession, folder: str, batch_id: int, buckets: int = BUCKETS) -> dict[str, int]:
    """The repair pass over an archive; only buckets with such rows are written."""
    calls = read(spark, folder)
    if calls is None:
        return {"incoming": 0, "added": 0, "buckets_written": 0, "rows_written": 0}
    right = repaired_cost("web_search_requests" if "web_search_requests" in calls.columns else None)
    wrong = calls.withColumn("_right", right).where("_right <> cost").withColumn("cost", F.col("_right")).drop("_right")
    newer = lambda old, new: old.join(new, KEY, "left_anti").unionByName(new)
    return upsert(spark, folder, wrong, batch_id, newer, buckets=buckets)
