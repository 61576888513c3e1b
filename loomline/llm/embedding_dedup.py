"""Embedding near-dedup by sorted projection passes.

Equal vectors become one class. In each pass a class gets a concatenation of
random hyperplane hashes, all classes are ordered by it, and each is compared with
its next `window` neighbours. A run of classes that share the first bits of the
hash and is longer than the window is compared in full, as pairs of chunks, so a
dense group loses no link to the window's bound. Verified pairs, those with cosine
of at least the threshold in double precision, are united across passes.

Every class carries its place in all passes, so a pass counts a pair only if no
earlier pass compared it: links are summed without listing pairs. Tasks hand on
sums and a spanning forest. The number of passes follows from the number of
classes and a target recall at the threshold, where hashes agree least.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are their own component; vectors of different
lengths don't link; copies link with each other; a null vec_id gets no component
and isn't compared; a vec_id with several vectors is one node for components, and
each of its rows counts the links of that row's vector; an empty table gives an
empty table. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected_components
from .storage import materialize, small_batches

THRESHOLD, WINDOW, RECALL, BITS, SEED = 0.95, 512, 0.999, 48, 20240131
LEAST_PASSES, CHUNK_WINDOWS = 8, 4


def prefix_bits(classes: int, window: int = WINDOW) -> int:
    """So many leading bits that a run of evenly spread classes is no longer than the window."""
    return min(BITS, max(1, math.ceil(math.log2(max(2, classes / window)))))


def passes_for(classes: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has shared the leading bits in some pass with probability recall.

    Such a pair is always compared, however dense its run is; windows only add to that.
    """
    agree = 1 - math.acos(threshold) / math.pi
    meets = agree ** prefix_bits(classes, window)
    return max(LEAST_PASSES, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def _unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors padded to one length, and their own lengths."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), int(lengths.max(initial=1))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    out /= np.abs(out).max(1, keepdims=True, initial=1e-300)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300), lengths


def _hashes(passes: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, lengths = _unit_rows(batch.column("vec"))
            keys = np.zeros((len(x), passes), np.int64)
            for d in np.unique(lengths).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).standard_normal((d, passes * BITS))
                own = lengths == d
                bits = (x[own, :d] @ planes[d] >= 0).reshape(-1, passes, BITS)
                keys[own] = bits @ weights
            offsets = np.arange(0, keys.size + 1, passes)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel()))], ["node", "keys"])

    return scan


def _compare(threshold: float, window: int):
    def compare(key: tuple, table: pa.Table) -> pa.Table:
        this, first, second = (k.as_py() for k in key)
        table = table.combine_chunks()
        n, passes = table.num_rows, len(table.column("ranks")[0])
        ranks = table.column("ranks").chunk(0).flatten().to_numpy().reshape(n, passes)
        order = np.argsort(ranks[:, this], kind="stable")
        ranks, rank = ranks[order], ranks[order, this]
        prefixes = table.column("prefixes").chunk(0).flatten().to_numpy().reshape(n, passes)[order]
        x, lengths = _unit_rows(table.column("vec").chunk(0))
        x, lengths = x[order], lengths[order]
        node, copies = table.column("node").to_numpy()[order], table.column("copies").to_numpy()[order]
        chunk = rank // (CHUNK_WINDOWS * window)
        prefix = prefixes[:, this]
        run_end = np.searchsorted(prefix, prefix, "right")  # equal prefixes stand together, in order
        links, forest = np.zeros(n, np.int64), Forest(n)
        left = int(np.searchsorted(chunk, first, "right"))
        for at in range(0, left, window):
            to = min(left, at + window)
            end = max(int(np.searchsorted(rank, rank[to - 1] + window, "right")), int(run_end[to - 1]))
            begin = at if first == second else left
            a, b = np.nonzero(x[at:to] @ x[begin:end].T >= threshold)
            a, b = a + at, b + begin
            near = np.abs(rank[a] - rank[b]) <= window
            here = (near | (prefix[a] == prefix[b]) & (chunk[b] == first)) if first == second else ~near & (prefix[a] == prefix[b])
            met = ((np.abs(ranks[a, :this] - ranks[b, :this]) <= window) | (prefixes[a, :this] == prefixes[b, :this])).any(1) if this else False
            fresh = (a < b) & here & (lengths[a] == lengths[b]) & ~np.asarray(met)
            a, b = a[fresh], b[fresh]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            forest.union(a, b)
        linked = np.flatnonzero(links)
        return pa.table({"node": node[linked], "links": links[linked], "root": node[forest.roots(linked)]})

    return compare


def _ranked(classes: DataFrame, passes: int, window: int, bits: int, n: int) -> DataFrame:
    """(node, ranks, prefixes): each class's place and leading hash bits in every pass."""
    keys = classes.select("node", "vec").mapInArrow(_hashes(passes), "node long, keys array<long>")
    rows = keys.select("node", F.posexplode("keys").alias("pass", "key")).repartitionByRange("pass", "key", "node").sortWithinPartitions("pass", "key", "node")
    rows = materialize(rows.select("node", "pass", "key", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "order")
    # a row for each range partition: where its first row stands
    sizes = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts = dict(zip(sorted(sizes), accumulate([sizes[p] for p in sorted(sizes)], initial=0)))
    offsets = F.broadcast(rows.sparkSession.createDataFrame(list(starts.items()), "part int, start long"))
    rank = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1) - F.col("pass") * F.lit(n)
    placed = rows.join(offsets, "part").select("node", F.struct("pass", rank.alias("rank"), F.shiftright("key", BITS - bits).alias("prefix")).alias("at"))
    ordered = placed.groupBy("node").agg(F.sort_array(F.collect_list("at")).alias("at"))
    return ordered.select("node", F.col("at.rank").alias("ranks"), F.col("at.prefix").alias("prefixes"))


def class_links(classes: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """(node, links, root) from rows of distinct (node, vec, copies): sums of copies linked with, and a spanning link, by task."""
    n = classes.count()
    passes, bits, size = passes_for(n, threshold, window), prefix_bits(n, window), CHUNK_WINDOWS * window
    rows = materialize(classes.join(_ranked(classes, passes, window, bits, n), "node"), "ranked")
    each = rows.select("node", F.posexplode(F.arrays_zip("ranks", "prefixes")).alias("pass", "at")).select("node", "pass", "at.*").withColumnsRenamed({"ranks": "rank", "prefixes": "prefix"})
    runs = each.groupBy("pass", "prefix").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).where((F.col("hi") - F.col("lo") > window) & (F.floor(F.col("hi") / size) > F.floor(F.col("lo") / size)))
    chunk = F.floor(F.col("rank") / size)
    own = F.array(F.struct(chunk.alias("first"), chunk.alias("second")))
    halo = F.when((chunk > 0) & (F.col("rank") % size < window), F.array(F.struct((chunk - 1).alias("first"), (chunk - 1).alias("second"))))
    later = F.transform(F.sequence(chunk, F.floor(F.col("hi") / size)), lambda c: F.struct(chunk.alias("first"), c.alias("second")))
    sooner = F.transform(F.sequence(F.floor(F.col("lo") / size), chunk), lambda c: F.struct(c.alias("first"), chunk.alias("second")))
    far = F.when(F.col("hi").isNotNull(), F.filter(F.concat(later, sooner), lambda p: p["first"] < p["second"]))
    none = F.array().cast("array<struct<first:bigint,second:bigint>>")
    tasks = F.explode(F.concat(own, F.coalesce(halo, none), F.coalesce(far, none))).alias("task")
    dealt = each.join(runs, ["pass", "prefix"], "left").select("node", "pass", tasks).select("node", "pass", "task.first", "task.second")
    groups = dealt.join(rows, "node").groupBy("pass", "first", "second")
    return groups.applyInArrow(_compare(threshold, window), "node long, links long, root long")


def embedding_dedup(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of table."""
    small_batches(table.sparkSession)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    usable = rows.where(F.col("vec_id").isNotNull() & finite)
    # a written table: a class's number stays the same however often it is read
    classes = usable.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("copies"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = materialize(class_links(classes.select("node", "vec", "copies"), threshold, window), "links")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    # a vec_id with several vectors ties their classes together
    several = usable.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1")
    several = materialize(usable.join(several, "vec_id", "left_semi").join(classes, "vec").select("vec_id", "node"), "several")
    ties = several.join(several.groupBy("vec_id").agg(F.min("node").alias("root")), "vec_id").select("node", "root")
    groups = materialize(connected_components(found.select("node", "root").unionByName(ties), "node", "root"), "groups")
    least = classes.join(groups, "node").groupBy("component").agg(F.min("least").alias("group"))
    groups = groups.join(least, "component").select("node", "group")
    known = classes.join(sums, "node", "left").join(groups, "node", "left").select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("group", "least").alias("group"))
    own = rows.where(F.col("vec_id").isNotNull() & finite).join(known, "vec", "left").select("vec_id", "links", "group")
    rest = rows.where(~(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))).select("vec_id", F.lit(None).cast("long").alias("links"), F.lit(None).cast("long").alias("group"))
    return own.unionByName(rest).select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("group", "vec_id").alias("component_id"), F.coalesce(F.coalesce("group", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


def op4_query(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
