"""Connected components of a link table, by alternating star contraction.

Large star: each node sends its larger neighbours to the smallest node it sees.
Small star: each node sends its smaller neighbours, and itself, there too.
What is left at the end is one star for each component around its smallest node.
Every step is an aggregation and a join, so hubs are combined before the shuffle
and large ones are split by adaptive execution.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node with a link to another; component is the smallest node reachable.

    Links to itself, repeated links and null ends are ignored; no links give an empty table.
    """
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` <> `{b}`").distinct()
    links = materialize(links, "links")
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        links = materialize(_small_star(_large_star(links)), "stars")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


class Forest:
    """Union-find over positions 0..n-1 inside one task."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = self.parent[up]

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] with b[i] for all i; the smallest position becomes the root."""
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
