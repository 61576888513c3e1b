"""SimHash near-dedup by a binary trie self-join.

Fingerprints within three differing bits agree in at least one of any four disjoint
parts of their bits. Each distinct fingerprint is therefore filed under its four
16-bit parts, with the part rotated to the top, and what is filed together forms one
binary trie below it. The self-join walks pairs of nodes of that trie together from
the pair (root, root): at each bit a pair has up to four pairs of children, those
with unlike bits add one error, and a pair over the budget is pruned with all below
it. Where more than HOT_GROUP fingerprints share a part, the bits below it are cut
into four parts again, as often as counts ask for; as fingerprints are distinct, five
levels always suffice, so no task holds more than a bounded part of any group.

Tasks union what they link and hand on a spanning forest, never all pairs; the
components come from alternating star contraction. Exact: no link is lost.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; fewer words than a shingle: the whole sequence is the one shingle.
Rows with a null doc_id keep their fingerprint and get a null component. Repeated
doc_ids are linked as one document with several fingerprints. An empty table
gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected_components
from .storage import materialize, small_batches

SEED, SHINGLE, BUDGET = 42, 3, 3
#: One more part than errors, so that one part agrees.
PARTS = BUDGET + 1
#: Distinct fingerprints in one group from which it is cut further; keys that a task walks at once; hot groups that are broadcast at most.
HOT_GROUP, KEYS_AT_ONCE, BROADCAST_GROUPS = 20_000, 1 << 17, 100_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_HASHED_AT_ONCE = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of word shingles: a bit is set if it is set in over half the shingles' XXH64."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    ends = (ends[-n:] - 1).tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _HASHED_AT_ONCE):
        h = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _HASHED_AT_ONCE], ends[at : at + _HASHED_AT_ONCE], strict=True)]
        bits = np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])


class _Trie:
    """Binary tries over keys sorted by group; a node is a range of positions with one prefix."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.forest = Forest(len(keys))
        self._zeros: dict[int, np.ndarray] = {}

    def zeros_before(self, bit: int) -> np.ndarray:
        if bit not in self._zeros:
            clear = ((self.keys >> np.uint64(63 - bit)) & np.uint64(1)) == 0
            self._zeros[bit] = np.concatenate([[0], np.cumsum(clear)])
        return self._zeros[bit]

    def walk(self, pairs: np.ndarray, depth: int, most: int = 1 << 18) -> None:
        """pairs: rows lo_a, hi_a, lo_b, hi_b, errors of node pairs at one depth. Links all keys within the budget."""
        waiting = [(pairs, depth)]
        while waiting:
            pairs, depth = waiting.pop()
            if len(pairs) > most:  # depth first, so that memory stays bounded
                waiting += [(pairs[: len(pairs) // 2], depth), (pairs[len(pairs) // 2 :], depth)]
                continue
            lo_a, hi_a, lo_b, hi_b, errors = pairs.T
            single = (hi_a - lo_a == 1) & (hi_b - lo_b == 1)
            if single.any():
                a, b = lo_a[single], lo_b[single]
                near = np.bitwise_count(self.keys[a] ^ self.keys[b]) <= BUDGET
                self.forest.union(a[near], b[near])
                pairs = pairs[~single]
                lo_a, hi_a, lo_b, hi_b, errors = pairs.T
            if not len(pairs):
                continue
            if depth >= 64 - BUDGET:  # what is left can't exceed the budget for some pairs: all of them are linked
                whole = errors + (64 - depth) <= BUDGET
                for la, ha, lb, hb, _ in pairs[whole]:
                    both = np.concatenate([np.arange(la, ha), np.arange(lb, hb)])
                    self.forest.union(np.full(len(both), both[0]), both)
                pairs = pairs[~whole]
                if not len(pairs):
                    continue
                lo_a, hi_a, lo_b, hi_b, errors = pairs.T
            zeros = self.zeros_before(depth)
            mid_a, mid_b = lo_a + zeros[hi_a] - zeros[lo_a], lo_b + zeros[hi_b] - zeros[lo_b]
            own = lo_a == lo_b
            below = [
                np.stack([lo_a, mid_a, lo_b, mid_b, errors], 1),
                np.stack([mid_a, hi_a, mid_b, hi_b, errors], 1),
                np.stack([lo_a, mid_a, mid_b, hi_b, errors + 1], 1),
                np.stack([mid_a, hi_a, lo_b, mid_b, errors + 1], 1)[~own],
            ]
            below = np.concatenate(below)
            kept = (below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= BUDGET)
            kept &= ~((below[:, 0] == below[:, 2]) & (below[:, 1] - below[:, 0] == 1))  # a key with itself
            if kept.any():
                waiting.append((below[kept], depth + 1))


def _links(table: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the node each is linked with, over all groups of the table at once; rows of a group stand together and share depth bits."""
    key, path = table.column("key").to_numpy().view(np.uint64), table.column("path").to_numpy()
    order = np.lexsort([key, path])
    key, path, node = key[order], path[order], table.column("node").to_numpy()[order]
    top = key >> np.uint64(64 - depth)
    edges = np.flatnonzero((path[1:] != path[:-1]) | (top[1:] != top[:-1])) + 1
    lo, hi = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    trie = _Trie(key)
    trie.walk(np.stack([lo, hi, lo, hi, np.zeros_like(lo)], 1), depth)
    roots = trie.forest.roots(np.arange(len(key)))
    linked = np.flatnonzero(roots != np.arange(len(key)))
    return node[linked], node[roots[linked]]


def _join_groups(depth: int):
    """Rows come sorted by path and top; whole groups are walked together, a bounded number of keys at once."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            held += batch.num_rows
            if held < KEYS_AT_ONCE:
                continue
            table = pa.Table.from_batches(waiting)
            top, path = table.column("top").to_numpy(), table.column("path").to_numpy()
            last = np.flatnonzero((top[1:] != top[:-1]) | (path[1:] != path[:-1]))
            if len(last):
                cut = int(last[-1]) + 1
                a, b = _links(table.slice(0, cut), depth)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                table = table.slice(cut)
            waiting, held = table.to_batches(), table.num_rows
        if held:
            a, b = _links(pa.Table.from_batches(waiting), depth)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return join


def _cut(rows: DataFrame, depth: int) -> DataFrame:
    """Each (node, key, path) row once for each part of the bits below depth, with the part rotated up behind the shared bits; top: path's shared bits."""
    rest = 64 - depth
    bits = rest // PARTS
    low = F.lit(-1 if rest == 64 else (1 << rest) - 1).cast("long")
    made = []
    for i in range(PARTS):
        below = F.col("key").bitwiseAND(low)
        turned = F.shiftleft(below, i * bits).bitwiseOR(F.shiftrightunsigned(below, rest - i * bits)) if i else below
        key = F.col("key").bitwiseAND(F.bitwise_not(low)).bitwiseOR(turned.bitwiseAND(low))
        made.append(F.struct(key.alias("key"), (F.col("path") * PARTS + i).alias("path"), F.shiftrightunsigned(key, rest - bits).alias("top")))
    return rows.select("node", F.explode(F.array(*made)).alias("x")).select("node", "x.*")


def fingerprint_links(fps: DataFrame, hot_group: int = HOT_GROUP) -> DataFrame:
    """(a, b) links that span the classes of (node, fp) rows with distinct fp within the budget."""
    # a fixed number: the walk costs far more than its few bytes suggest, so small partitions shouldn't be merged
    partitions = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, depth, found = fps.select("node", F.col("fp").alias("key"), F.lit(0).alias("path")), 0, None
    while True:
        rows, depth = _cut(rows, depth), depth + (64 - depth) // PARTS
        hot = None
        if 64 - depth >= PARTS and 1 << (64 - depth) > hot_group:  # else so many distinct fingerprints can't share the bits
            hot = materialize(rows.groupBy("path", "top").count().where(F.col("count") > hot_group).select("path", "top"), "hot")
            few = hot.limit(BROADCAST_GROUPS + 1).count()
            hot = (F.broadcast(hot) if few <= BROADCAST_GROUPS else hot) if few else None
        cold = rows if hot is None else rows.join(hot, ["path", "top"], "left_anti")
        links = cold.select("node", "key", "path", "top").repartition(partitions, "path", "top").sortWithinPartitions("path", "top").mapInArrow(_join_groups(depth), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if hot is None:
            return found
        rows = materialize(rows.join(hot, ["path", "top"], "left_semi").select("node", "key", "path"), "dense")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed 64-bit integer."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_group: int = HOT_GROUP) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the smallest doc_id reachable by links."""
    return simhash_groups(materialize(fingerprints(docs, id_col, text_col), "fingerprints"), hot_group)


def simhash_groups(fps: DataFrame, hot_group: int = HOT_GROUP) -> DataFrame:
    """(doc_id, fp, component_id) for each row of (doc_id, fp)."""
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    known = nodes.where("node is not null")
    links = fingerprint_links(known, hot_group)
    # a doc_id on several rows ties their fingerprints together
    own = fps.where("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("fp").alias("n")).where("n > 1")
    ties = fps.join(own, "doc_id", "left_semi").join(known, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    groups = connected_components(links.unionByName(ties), "a", "b")
    labels = known.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(labels, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, once for each text; rows with a null doc_id stay."""
    fps = materialize(fingerprints(docs), "fingerprints")
    groups = simhash_groups(fps)
    dropped = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti")
    repeated = materialize(fps.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    rows = kept.join(repeated, "doc_id", "left_semi")
    return kept.join(repeated, "doc_id", "left_anti").unionByName(rows.dropDuplicates(["doc_id", "text"]))


def op10_query(spark, sf_dir: str) -> DataFrame:
    found = simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
