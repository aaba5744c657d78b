"""Connected components by alternating stars (Kiveris et al. 2014), on Spark joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.llm.common import saved

MAX_ROUNDS = 100
#: Links that a file of a round's table holds, so that few links don't make a file for each partition.
FILE_LINKS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of edges (a, b); root is the smallest node reachable.

    Each round hangs neighbours on the smallest node seen, so paths shorten by halves. The rows
    of a round are written to the shared folder. A node with very many links is a hot join key;
    both sides of that join are plain shuffles, which adaptive execution splits. (Dealing the
    minima out by an expression of the node, not the node itself, is what makes it shuffle them:
    it cannot split what an aggregate has dealt out.) A round has no more links than the one
    before, so its number of files follows from them.
    Self-links and repeated links add nothing; no edges give no rows.
    """
    now = saved(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    seen = _digest(now)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            break
        files = -(-seen[0] // FILE_LINKS)
        now = saved(_small_star(_large_star(now)).coalesce(files), "edges")
        before, seen = seen, _digest(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(now.select("b", "b").distinct())


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def _anew(node: str) -> Column:
    return F.col(node).bitwiseXOR(F.lit(0).cast("long")).alias(node)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(_anew("u"), "m")
    return (
        both.join(lowest, "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("a"), F.least("m", "u").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = (
        edges.join(lowest.select(_anew("a"), "m"), "a")
        .filter(F.col("b") != F.col("m"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    )
    return hung.union(lowest.select("a", "m")).distinct()


def merge_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Join the sets of u[i] and v[i] in label, where label[x] is the smallest member's index."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = label[label]
            if np.array_equal(above, label):
                break
            label[:] = above
