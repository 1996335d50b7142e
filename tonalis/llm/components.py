"""Connected components of a graph in a DataFrame of edges, by alternating star operations.

Large-star links each node's larger neighbours to its smallest neighbour, small-star its
smaller ones; both keep components and flatten them to stars (Kiveris and others, 2014).
Nothing is gathered on the driver but two sums per round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


SALTS = 16


def _spread(edges: DataFrame, least: DataFrame, how: str) -> DataFrame:
    """``edges`` joined to ``least`` by u; the edges of a hub are dealt to SALTS keys."""
    copies = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(copies, ["u", "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for each node with an edge.

    Loops and nulls are left out; repeated edges count once.  Ends when a round changes nothing.
    Nodes that are their own smallest neighbour, such as the hubs of stars, need no lookup; the
    others' edges are salted.  The tables of past rounds are deleted.
    """
    pair = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    stars = materialize(pair, "edges")
    before = None
    for _ in range(rounds):
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lower = stars.groupBy("u").agg(F.min("v").alias("m"))  # u > v in every row: nodes with a smaller neighbour
        large = _spread(both.where("v > u"), lower, "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        small = _spread(large, least.where("_n > 1").drop("_n"), "inner").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        past, stars = stars, materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(past)
        n, h = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, h) == before:
            break
        before = (n, h)
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct().toDF("node", "component"))


class Union:
    """Component labels (smallest index) of a small local graph, fed with arrays of edges."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> bool:
        """Join the components of i and j, pair by pair; True if any were apart."""
        label, changed = self.label, False
        while len(i):
            x, y = label[i], label[j]
            apart = x != y
            if not apart.any():
                break
            changed = True
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while True:
                nxt = label[label]
                if np.array_equal(nxt, label):
                    break
                label[:] = nxt
        return changed
