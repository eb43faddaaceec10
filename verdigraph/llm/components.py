"""Connected components of links, by alternating large and small stars; nothing is gathered on the driver.

A large star hangs every larger neighbour of a node on the smallest node it sees, a small star does so with the smaller ones. When a
round changes nothing, every node hangs on the smallest of its component. A node with very many links is no burden: its minimum is
pre-aggregated and sent to its links. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stored


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long, in any order, repeats and loops allowed). Returns node, component: the nodes that aren't the smallest of
    their component."""
    down = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        now = down.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == seen or not now["n"]:
            return down.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
        both = down.union(down.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = hot_join(both.where("b > a"), least, "a", 2 * now["n"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = hot_join(large, least, "a", now["n"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each of n nodes' component under the links a-b, in memory, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
