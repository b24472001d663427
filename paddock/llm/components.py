"""Distributed union-find: connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def stars(links: DataFrame) -> bool:
    """Whether every node has one link to a lesser node, which has none itself: all is contracted, and no round more is needed to see it."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    by = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("low"))
    return by.where("up > 1 or up > 0 and low = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any orderable type -> (node, component), component the smallest node reachable.

    Loops, repeated and reversed edges are harmless; nodes without edges don't appear; an empty table
    gives an empty result. Every round is a written table, so a lost executor costs one round at most.
    A node with very many links is a join key on one side only, which adaptive execution splits.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not stars(links):
        # large star: neighbours above a node move to the least node around it
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: the node and its neighbours below it move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "links")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class LocalSets:
    """Union-find over 0..n-1 inside one task."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return int(x)

    def roots(self) -> np.ndarray:
        while True:
            over = self.up[self.up]
            if (over == self.up).all():
                return self.up
            self.up = over

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def join_all(self, x: int, others: np.ndarray) -> None:
        """Join x with every other; those already with it cost one comparison of an array."""
        for y in np.unique(self.up[others[self.up[others] != self.up[x]]]).tolist():
            self.join(x, y)
