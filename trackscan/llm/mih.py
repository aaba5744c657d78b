"""Exact nearest binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments, and each shard of the codes has an index from every segment's
values to the codes that have them. A query looks up the values within radius 0 of its own in each
segment, then within 1, and so on. When segments 0..j have been searched to radius s and the others
to s - 1, every code within Hamming distance SEGMENTS * s + j has been seen; the search ends when
that covers the k-th verified distance.

Codes are sharded, queries are a stated set in blocks; a task searches one block in one shard, and
tasks return k codes for each of their queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackscan.llm.common import saved, ship

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
SHARD_CODES, BLOCK_QUERIES = 1 << 20, 1024


def sign_codes(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows (id, code): a bit for each of 64 components, set where it is above 0.

    Rows without an id, and vectors that are null, of another length, or hold null or NaN, have no
    code and are left out.
    """
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x))
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        F.lit(0).cast("long"),
        lambda code, i: code.bitwiseOR(
            F.when(F.get(column, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i))
            .otherwise(F.lit(0).cast("long"))
        ),
    )
    usable = F.col(id_column).isNotNull() & (F.size(column) == BITS) & whole
    return rows.filter(usable).select(F.col(id_column).cast("long").alias("id"), bits.alias("code"))


class Index:
    """The codes of one shard by the values of every segment."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.orders, self.starts = codes, [], []
        for j in range(SEGMENTS):
            values = self._segment(codes, j)
            self.orders.append(np.argsort(values, kind="stable"))
            counts = np.bincount(values, minlength=1 << WIDTH)
            self.starts.append(np.concatenate(([0], np.cumsum(counts))))
        weights = np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint32))
        self.masks = [np.flatnonzero(weights == s) for s in range(WIDTH + 1)]
        self.seen = np.full(len(codes), -1)

    @staticmethod
    def _segment(codes, j: int):
        shift = np.uint64(BITS - WIDTH * (j + 1))
        return ((codes >> shift) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)

    def search(self, query: np.uint64, k: int, stamp: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, distances) of all codes up to the k-th distance; stamp differs by call."""
        found, apart = [], []
        by_distance = np.zeros(BITS + 1, np.int64)
        for step in range(SEGMENTS * (WIDTH + 1)):
            s, j = divmod(step, SEGMENTS)
            values = int(self._segment(query, j)) ^ self.masks[s]
            first = self.starts[j][values]
            n = self.starts[j][values + 1] - first
            first, n = first[n > 0], n[n > 0]
            if len(n):
                skip = np.repeat(np.cumsum(n) - n, n)
                at = self.orders[j][np.repeat(first, n) + np.arange(n.sum()) - skip]
                at = at[self.seen[at] != stamp]
                self.seen[at] = stamp
                d = np.bitwise_count(self.codes[at] ^ query).astype(np.int64)
                found.append(at)
                apart.append(d)
                by_distance += np.bincount(d, minlength=BITS + 1)
            if by_distance[: step + 1].sum() >= k:  # all codes within distance step are known
                break
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, d = np.concatenate(found), np.concatenate(apart)
        upto = np.searchsorted(np.cumsum(by_distance), k)
        return at[d <= upto], d[d <= upto]


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Rows (query_id, rank, id, distance): the k nearest other rows of each query, ties by id.

    codes and queries have (id, code). A query's own id is never its neighbour. Equal codes are
    searched once: a code stands for its k + 1 smallest ids, as no more can be asked for. Fewer
    than k other rows give fewer results. Repeated rows of an id count once.
    """
    spark = codes.sparkSession
    ship(spark)
    codes, queries = codes.distinct(), queries.distinct()
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    known = saved(
        codes.withColumn("place", place)
        .filter(F.col("place") <= k + 1)
        .groupBy("code")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .withColumn("first", F.get("ids", F.lit(0))),
        "codes",
    )
    asked = saved(queries.select("code").distinct(), "queries")
    shards = max(1, -(-known.count() // SHARD_CODES))
    n = asked.count()
    # as many blocks as keep the tasks full, and blocks no larger than BLOCK_QUERIES
    blocks = max(1, -(-n // BLOCK_QUERIES), min(n, spark.sparkContext.defaultParallelism // shards))
    left = known.select("code", "first").select(
        "*",
        F.pmod(F.xxhash64("code"), F.lit(shards)).alias("shard"),
        F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"),
    )
    right = asked.select(
        "code",
        F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block"),
        F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"),
    )

    def run(rows: pa.Table, some: pa.Table) -> pa.Table:
        own = rows["code"].to_numpy().view(np.uint64)
        first = rows["first"].to_numpy()
        index, out = Index(own), []
        for stamp, query in enumerate(some["code"].to_numpy().view(np.uint64)):
            at, d = index.search(query, k + 1, stamp)
            best = np.lexsort((first[at], d))[: k + 1]
            at, d = at[best], d[best]
            out.append(np.stack([np.full(len(at), query).view(np.int64), own[at].view(np.int64), first[at], d]))
        cells = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
        return pa.table([pa.array(c) for c in cells], ["query", "code", "first", "distance"])

    found = (
        left.groupBy("shard", "block")
        .cogroup(right.groupBy("shard", "block"))
        .applyInArrow(run, "query long, code long, first long, distance long")
    )
    by_code = Window.partitionBy("query").orderBy("distance", "first")
    best = found.withColumn("n", F.row_number().over(by_code)).filter(F.col("n") <= k + 1)
    near = best.join(known.select("code", "ids"), "code").select(
        "query", "distance", F.explode("ids").alias("id")
    )
    by_id = Window.partitionBy("query_id", "query").orderBy("distance", "id")
    return (
        queries.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
        .join(near, "query")
        .filter(F.col("id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(by_id))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("long").alias("rank"), "id", "distance")
    )
