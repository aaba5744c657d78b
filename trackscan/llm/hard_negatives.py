"""Hard negatives by Four-Russians scoring: exact integer scores from lookups and shifts alone.

A vector's integer components are kept as bit planes, eight dimensions to a byte. An anchor has,
for each group of eight dimensions, a table of the sums of all 256 subsets of its components
there. A plane of a candidate is scored by looking its bytes up in these tables; planes are put
together from the sign plane down by doubling and adding. That gives the whole inner product.

Candidates are cut into shards, anchors into blocks, and a task scores one block in one shard. It
returns a few rows for each anchor, so no scores of pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackscan.llm.common import saved, ship

SCALE, GROUP = 256, 8
POSITIVES, NEGATIVES = 5, 5
LEAST_PERCENT, MOST_PERCENT = 80, 100
#: Candidates of a shard and anchors of a block; the smaller, the more copies of the other.
SHARD_ROWS, LEAST_SHARD, BLOCK_ANCHORS = 1 << 18, 1 << 11, 4096
#: Scored together: this many candidates with this many anchors.
TILE_ROWS, TILE_ANCHORS = 1024, 128
#: A score and a place in the shard share a sortable 64-bit key.
PLACE_BITS = 20
MOST_SCORE = 1 << (62 - PLACE_BITS)
_NONE = np.iinfo(np.int64).min


def usable(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, label, x): the rows that take part, each once, with whole-number components.

    A row without an id, a label or a vector, or with a null or non-finite component, takes no
    part. x holds floor(256 * component) as doubles.
    """
    big = F.lit(float("inf"))
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != big))
    return (
        rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
        .filter(whole)
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("label").cast("long").alias("label"),
            F.transform("embedding", lambda v: F.floor(SCALE * v.cast("double")).cast("double")).alias("x"),
        )
        .distinct()
    )


def bits_of(rows: DataFrame) -> tuple[int, int]:
    """(dimensions, planes) that hold every vector of usable(); the last plane is the sign."""
    most = F.aggregate("x", F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v)))
    row = rows.agg(F.max(F.size("x")), F.max(most)).first()
    dims, largest = int(row[0] or 0), float(row[1] or 0.0)
    if dims * largest * largest >= MOST_SCORE:
        raise ValueError(f"components up to {largest / SCALE:g} give scores beyond {MOST_SCORE}")
    return dims, int(largest).bit_length() + 1


def planes(x: np.ndarray, n_planes: int) -> np.ndarray:
    """Packed bit planes of integer vectors: uint8 of shape (rows, planes, groups of dimensions)."""
    rows, dims = x.shape
    padded = np.zeros((rows, -(-dims // GROUP) * GROUP), np.int64)
    padded[:, :dims] = x
    bits = (padded[:, None, :] >> np.arange(n_planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def packed(rows: DataFrame, dims: int, n_planes: int) -> DataFrame:
    """Rows (vec_id, label, bits) of usable(); vectors with fewer dimensions end in zeros."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, dims), np.int64)
            for i, v in enumerate(batch.column(2)):
                own = v.values.to_numpy()
                x[i, : len(own)] = own
            found = planes(x, n_planes)
            bits = pa.array([p.tobytes() for p in found], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), bits], ["vec_id", "label", "bits"])

    return rows.mapInArrow(run, "vec_id long, label long, bits binary")


def unpacked(bits: np.ndarray) -> np.ndarray:
    """The integer vectors of planes()."""
    n_planes = bits.shape[1]
    values = np.unpackbits(bits, axis=2, bitorder="little").astype(np.int64)
    weights = 1 << np.arange(n_planes, dtype=np.int64)
    weights[-1] *= -1
    return np.einsum("rpd,p->rd", values, weights)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): the sum of an anchor's components over every subset of a group."""
    n, dims = anchors.shape
    tables = np.zeros((dims // GROUP, 1 << GROUP, n), np.int64)
    for j in range(GROUP):
        tables[:, 1 << j : 2 << j] = tables[:, : 1 << j] + anchors[:, j::GROUP].T[:, None, :]
    most = np.abs(tables).max(initial=0)
    return tables.astype(np.int32) if most * len(tables) < 1 << 31 else tables


def scores(tables: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(candidates, anchors): inner products, by lookups of the candidates' bytes."""
    n, n_planes, groups = bits.shape
    total = np.zeros((n, tables.shape[2]), np.int64)
    for plane in range(n_planes - 1, -1, -1):
        part = np.zeros((n, tables.shape[2]), tables.dtype)
        for group in range(groups):
            part += tables[group].take(bits[:, plane, group], axis=0)
        total = total * 2 + part if plane < n_planes - 1 else -part.astype(np.int64)
    return total


def _bits(rows: pa.Table, n_planes: int, groups: int) -> np.ndarray:
    data = b"".join(x.as_py() for x in rows["bits"])
    return np.frombuffer(data, np.uint8).reshape(rows.num_rows, n_planes, groups)


def _keys(score: np.ndarray, good: np.ndarray, first: int) -> np.ndarray:
    """Sortable keys: the higher the score and, of equal ones, the earlier the place, the larger."""
    place = (1 << PLACE_BITS) - 1 - (first + np.arange(len(score)))
    return np.where(good, (score << PLACE_BITS) + place[:, None], _NONE)


def _more(best: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """best, the len(best) largest keys of each column so far, with those of keys."""
    if not (keys > best.min(axis=0)).any():
        return best
    both = np.concatenate([best, keys])
    return np.partition(both, len(both) - len(best), axis=0)[-len(best) :]


def _in_shards(
    candidates: DataFrame, anchors: DataFrame, choose: Callable, schema: str
) -> DataFrame:
    """choose(candidates, anchors) for every shard of candidates and block of anchors."""
    spark = candidates.sparkSession
    n, asked = candidates.count(), anchors.count()
    wanted = min(2 * spark.sparkContext.defaultParallelism, -(-n // LEAST_SHARD))
    shards = max(1, -(-n // SHARD_ROWS), wanted)
    blocks = max(1, -(-asked // BLOCK_ANCHORS))

    def dealt(key: list[str], n: int, name: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(n)).alias(name)

    def copied(n: int, name: str) -> Column:
        return F.explode(F.expr(f"sequence(0L, {n - 1}L)")).alias(name)

    left = candidates.select("*", dealt(["vec_id", "label", "bits"], shards, "shard"), copied(blocks, "block"))
    right = anchors.select("*", dealt(["anchor"], blocks, "block"), copied(shards, "shard"))
    groups = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    return groups.applyInArrow(choose, schema)


def mined(rows: DataFrame) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows has vec_id, label and embedding; labels are used as they are. Anchors are the rows whose
    vec_id is divisible by 100. A score is the inner product of two rows' whole-number components;
    higher ones come first, and of equal ones the smaller vec_id. An anchor's positives are its
    first POSITIVES rows of its label with another vec_id. For each positive, its negatives are
    the first NEGATIVES rows of another label whose score is between LEAST_PERCENT and
    MOST_PERCENT per cent of the positive's. An anchor without positives, or a positive without
    such rows, gives no rows.

    See usable() for the rows that take part. Rows that are equal in id, label and whole-number
    components count once; rows of one vec_id that differ are rows of their own, also as anchors. Vectors of different lengths are compared
    as if the shorter ended in zeros. Other columns are ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    whole = saved(usable(rows), "usable")
    dims, n_planes = bits_of(whole)
    groups = -(-dims // GROUP)
    candidates = saved(packed(whole, dims, n_planes), "planes")
    anchors = candidates.filter(F.col("vec_id") % 100 == 0).select(
        F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), "bits",
    )
    anchors = anchors.withColumn("anchor", F.xxhash64("anchor_id", "anchor_label", "bits"))

    def tiles(some: pa.Table, asked: pa.Table):
        """The shard by vec_id, and per tile of anchors its first place and scores by candidate tile."""
        order = np.argsort(some["vec_id"].to_numpy(), kind="stable")
        some = some.take(pa.array(order))
        bits = _bits(some, n_planes, groups)
        vectors = unpacked(_bits(asked, n_planes, groups))

        def of(first: int, last: int):
            tables = subset_sums(vectors[first:last])
            for a in range(0, len(bits), TILE_ROWS):
                yield a, scores(tables, bits[a : a + TILE_ROWS])

        return some["vec_id"].to_numpy(), some["label"].to_numpy(), of

    def positives(some: pa.Table, asked: pa.Table) -> pa.Table:
        own, out = _columns(asked, "anchor", "anchor_id", "anchor_label"), []
        if some.num_rows and asked.num_rows:
            ids, labels, of = tiles(some, asked)
            for a in range(0, asked.num_rows, TILE_ANCHORS):
                anchor, anchor_id, label = (c[a : a + TILE_ANCHORS] for c in own)
                best = np.full((POSITIVES, len(anchor)), _NONE)
                for at, score in of(a, a + TILE_ANCHORS):
                    same = labels[at : at + TILE_ROWS, None] == label
                    same &= ids[at : at + TILE_ROWS, None] != anchor_id
                    best = _more(best, _keys(score, same, at))
                row, col = np.nonzero(best != _NONE)
                score, id_ = _of_keys(best[row, col], ids)
                out.append(np.stack([anchor[col], anchor_id[col], id_, score]))
        return _table(out, ["anchor", "anchor_id", "positive_id", "positive_score"])

    by_anchor = Window.partitionBy("anchor", "anchor_id").orderBy(
        F.col("positive_score").desc(), "positive_id"
    )
    found = _in_shards(
        candidates, anchors, positives, "anchor long, anchor_id long, positive_id long, positive_score long"
    )
    first = saved(
        found.withColumn("n", F.row_number().over(by_anchor)).filter(F.col("n") <= POSITIVES), "positives"
    )
    limits = first.groupBy("anchor", "anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "positive_id", "positive_score"))).alias("positives")
    )

    def negatives(some: pa.Table, asked: pa.Table) -> pa.Table:
        own, out = _columns(asked, "anchor", "anchor_id", "anchor_label"), []
        if some.num_rows and asked.num_rows:
            ids, labels, of = tiles(some, asked)
            limit = np.full((POSITIVES, asked.num_rows), -1)  # below every score of a positive that counts
            known = asked["positives"].to_pylist()
            for i, some_positives in enumerate(known):
                for j, p in enumerate(some_positives):
                    limit[j, i] = p["positive_score"]
            for a in range(0, asked.num_rows, TILE_ANCHORS):
                anchor, anchor_id, label = (c[a : a + TILE_ANCHORS] for c in own)
                top = limit[:, a : a + TILE_ANCHORS]
                best = [np.full((NEGATIVES, len(anchor)), _NONE) for _ in top]
                for at, score in of(a, a + TILE_ANCHORS):
                    other = labels[at : at + TILE_ROWS, None] != label
                    other &= score >= 0  # a negative positive_score has no range
                    for j, most in enumerate(top):
                        near = other & (100 * score <= MOST_PERCENT * most)
                        near &= 100 * score >= LEAST_PERCENT * most
                        best[j] = _more(best[j], _keys(score, near, at))
                for j in range(POSITIVES):
                    row, col = np.nonzero(best[j] != _NONE)
                    score, id_ = _of_keys(best[j][row, col], ids)
                    out.append(np.stack([anchor[col], anchor_id[col], np.full(len(col), j + 1), id_, score]))
        return _table(out, ["anchor", "anchor_id", "n", "negative_id", "negative_score"])

    near = _in_shards(
        candidates,
        saved(anchors.join(limits, ["anchor", "anchor_id"]), "limits"),
        negatives,
        "anchor long, anchor_id long, n long, negative_id long, negative_score long",
    )
    by_positive = Window.partitionBy("anchor", "anchor_id", "n").orderBy(
        F.col("negative_score").desc(), "negative_id"
    )
    chosen = near.withColumn("rank", F.row_number().over(by_positive)).filter(F.col("rank") <= NEGATIVES)
    positive = first.withColumn("n", F.col("n").cast("long"))
    return chosen.join(positive, ["anchor", "anchor_id", "n"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows[name].to_numpy() for name in names]


def _of_keys(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of sortable keys."""
    low = (1 << PLACE_BITS) - 1
    return keys >> PLACE_BITS, ids[low - (keys & low)]


def _table(parts: list[np.ndarray], names: list[str]) -> pa.Table:
    cells = np.concatenate(parts, axis=1) if parts else np.zeros((len(names), 0), np.int64)
    return pa.table([pa.array(c) for c in cells], names)
