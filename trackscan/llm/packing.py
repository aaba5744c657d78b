"""Pack documents' tokens into sequences by patterns of lengths, fitted to the length histogram.

The histogram of lengths has at most ``size`` rows whatever the input, so the plan is made on the
driver: patterns of one to three lengths that fill a sequence exactly, repeat counts by
non-negative least squares, rounding, and best fit for what is left. The plan says which sequence
the n-th piece of a length goes to; pieces get their numbers on Spark.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackscan.llm.common import saved, ship
from trackscan.llm.tokens import encoder, grouped

SIZE, END_ID, TEXTS_AT_ONCE = 2048, 0, 64
#: Patterns that enter the fit, gradient steps, and how often what is left is fitted again.
PATTERNS, STEPS, FITS = 60_000, 200, 3
#: Pieces of one length that one window numbers.
NUMBERED_AT_ONCE = 2_000


def pieces(
    docs: DataFrame,
    vocabulary: str,
    size: int = SIZE,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): each document's ids in pieces.

    A null text counts as empty; every document ends with end_id, so each has a piece. Only
    documents of more than size ids are cut. Repeated rows are documents of their own.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).many
        end = np.array([end_id], "<u4").tobytes()
        for batch in grouped(batches):
            found = encode(batch.column(1))
            keys = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                rows = []
                some = slice(at, at + TEXTS_AT_ONCE)
                for key, ids in zip(keys[some], found[some], strict=True):
                    ids += end
                    for k, first in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[first : first + 4 * size]
                        rows.append((key, k, first // 4, len(own) // 4, zlib.crc32(own), own))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                wanted = 5 + keep_ids
                yield pa.record_batch(arrays[:wanted], names[:wanted])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, schema + ", ids binary" * keep_ids)


def patterns(counts: np.ndarray, limit: int = PATTERNS) -> np.ndarray:
    """Rows of three lengths (0 for none) of pieces that there are, each adding up to the size.

    All pairs, and triples whose second length is taken at a stride that keeps to the limit.
    """
    size = len(counts) - 1
    there = np.flatnonzero(counts > 0)
    there = there[there > 0]
    single = there[there == size]
    found = [np.stack([single, 0 * single, 0 * single], axis=1)]
    large = there[(2 * there >= size) & (there < size)]
    pair = large[counts[size - large] > 0]
    found.append(np.stack([pair, size - pair, 0 * pair], axis=1))
    stride = max(1, int(np.ceil(len(there) ** 2 / 6 / limit)))
    for a in there[3 * there >= size]:
        b = there[(there <= a) & (2 * there >= size - a) & (there < size - a)]
        b = b[(b + a) % stride == 0]
        b = b[counts[size - a - b] > 0]
        found.append(np.stack([np.full(len(b), a), b, size - a - b], axis=1))
    return np.concatenate(found)


def fit(counts: np.ndarray, rows: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that bring their lengths' sums near to counts.

    Non-negative least squares by accelerated projected gradient. Long pieces weigh more, since
    what is left of them is harder to place.
    """
    size = len(counts) - 1
    weight = (0.1 + np.arange(size + 1) / size) * (np.arange(size + 1) > 0)
    used = rows > 0
    uses = np.bincount(rows.ravel(), minlength=size + 1)
    # a pattern's step follows how many others draw on its lengths
    step = 1 / np.maximum((weight[rows] * uses[rows] * used).sum(axis=1), 1e-9)
    x = np.zeros(len(rows))
    y, t = x, 1.0
    for _ in range(steps):
        made = np.bincount(rows.ravel(), np.repeat(y, 3), minlength=size + 1)
        slope = ((weight * (made - counts))[rows] * used).sum(axis=1)
        after = np.maximum(0, y - step * slope)
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x


def rounded(x: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeat counts, never more than there are pieces for; and the counts left over.

    Fractions are carried on to the next pattern, so that many small counts keep their sum.
    """
    whole = np.diff(np.floor(np.concatenate(([0], np.cumsum(x))) + 1e-9)).astype(np.int64)
    left, taken = counts.astype(np.int64).copy(), np.zeros(len(x), np.int64)
    for i in np.flatnonzero(whole):
        need = [v for v in rows[i].tolist() if v]
        most = min(left[v] // need.count(v) for v in need)
        taken[i] = min(whole[i], most)
        for v in need:
            left[v] -= taken[i]
    return taken, left


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, sequences) by best fit decreasing, on counts instead of single pieces."""
    size = len(counts) - 1
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(size, 0, -1):
        n = int(counts[length])
        r = length
        while n and r <= size:
            if not room.get(r):
                r += 1
                continue
            own, have = room[r].pop()
            put = min(n, have)
            room[r - length].append(((*own, length), put))
            if have > put:
                room[r].append((own, have - put))
            n -= put
            r = max(length, r - length) if r - length >= length else r
        each = size // length
        for k, bins in ((each, n // each), (n % each, 1)):
            if k and bins:
                room[size - k * length].append(((length,) * k, bins))
    return [x for found in room.values() for x in found]


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, sequences) for all pieces; counts[n] pieces have length n."""
    left, found = counts.astype(np.int64).copy(), []
    size = len(counts) - 1
    found.append(((size,), int(left[size])))
    left[size] = 0
    for _ in range(FITS):
        rows = patterns(left)
        if not len(rows):
            break
        taken, left = rounded(fit(left, rows), rows, left)
        for i in np.flatnonzero(taken):
            found.append((tuple(v for v in rows[i].tolist() if v), int(taken[i])))
    return [x for x in found + best_fit(left) if x[1]]


def slots(found: list[tuple[tuple[int, ...], int]], size: int = SIZE) -> np.ndarray:
    """Rows (length, first number, sequence, offset): where runs of a length's pieces go."""
    given, base, out = [0] * (size + 1), 0, []
    for lengths, n in found:
        offset = 0
        for v in lengths:
            out.append((v, given[v], base, offset))
            given[v] += n
            offset += v
        base += n
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """rows with sequence_id and offset added, all sequences filled without gaps from offset 0.

    rows: what pieces() returned, from a table (they are read twice). The same rows get the same
    places in every run. The plan has a few entries for each pattern, and so no more than the
    size gives rise to; it goes to the tasks with the function.
    """
    ship(rows.sparkSession)
    histogram = rows.groupBy("length").count().collect()  # at most size rows
    counts = np.zeros(size + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["count"]
    where = slots(plan(counts), size)
    keys = (where[:, 0] << 44) + where[:, 1]
    buckets = int(max(1, -(-counts.max() // NUMBERED_AT_ONCE)))
    tie = F.xxhash64("doc_id", "start", "ids_crc32")
    spread = rows.withColumn("tie", tie).withColumn("bucket", F.pmod("tie", F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket")
    bases = (
        spread.groupBy("length", "bucket")
        .count()
        .withColumn("base", F.sum("count").over(before) - F.col("count"))
        .drop("count")
    )
    within = Window.partitionBy("length", "bucket").orderBy("tie", "doc_id", "start", "ids_crc32")
    numbered = spread.join(bases, ["length", "bucket"]).select(
        *rows.columns, (F.col("base") + F.row_number().over(within) - 1).alias("number")
    )
    names = [*rows.columns, "sequence_id", "offset"]
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(i).to_numpy() for i in (at, batch.num_columns - 1))
            i = np.searchsorted(keys, (length << 44) + number, side="right") - 1
            placed = [where[i, 2] + number - where[i, 1], where[i, 3]]
            yield pa.record_batch([*batch.columns[:-1], *map(pa.array, placed)], names)

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return numbered.mapInArrow(run, schema + ", sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """The pieces of docs with their places; other columns of docs are ignored."""
    return pack(saved(pieces(docs, vocabulary, size, keep_ids=keep_ids), "pieces"), size)


def sequences(rows: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids, lengths) from packed pieces with their ids; ids as u32 bytes."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda found, x: F.concat(found, x["ids"]))
    return (
        rows.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            joined.alias("ids"),
            F.transform("parts", lambda x: x["length"]).alias("lengths"),
        )
    )
