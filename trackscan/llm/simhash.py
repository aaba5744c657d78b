"""SimHash near-duplicates: a binary-trie self-join within a Hamming budget.

The trie join walks pairs of trie nodes together, one bit a step, adds up the bits in which their
paths differ, and drops a pair of nodes as soon as the budget is exceeded. To spread it over
executors the 64 bits are cut into budget + k blocks. Two fingerprints within the budget agree on
k whole blocks at least, so in the trie that has these k blocks first they share a node at their
depth: each such node of the tries of all choices of k blocks is one unit of work. k grows with the
number of fingerprints, so that a node holds few of them by chance, and every k finds every link.
A node with more than ``cap`` fingerprints, as a dense group has, is cut into chunks whose pairs
are joined separately. Every unit returns a forest that joins what
its links join, rather than all pairs, so a dense group of n fingerprints costs n rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackscan.llm.common import free_name, mapped, quoted, saved, ship, with_columns
from trackscan.llm.graph import components, merge_labels

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Fingerprints of one trie node that are joined as one unit.
CAP = 1024
#: Fingerprints that a node holds by chance, beyond which it is found by one more block.
BY_CHANCE = 1024
#: Rows of sorted units that are walked together, and pairs verified at a time.
BATCH_ROWS, BATCH_PAIRS, LEAF_PAIRS = 100_000, 1_000_000, 64
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles; 0 without words."""
    words = (text or "").encode().lower().split()
    if len(words) < shingle_words:
        words = [b" ".join(words)] if words else []
        shingles: Iterator[bytes] = iter(words)
        n = len(words)
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
        n = len(words) - shingle_words + 1
    if not n:
        return 0
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    counts = np.empty((8, 8), np.int64)  # by byte of the hash, and bit of the byte
    starts = np.arange(0, n, 255)  # a lane of eight bits counts to 255
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, starts)
        counts[:, bit] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts.ravel() * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    keep: Sequence[str] = ("doc_id",),
    name: str = "fp",
) -> DataFrame:
    """Rows (*keep, name) for every row of docs; the last holds the 64 bits as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(
                (fingerprint(t.as_py(), shingle_words) for t in batch.column(0)),
                np.uint64,
                batch.num_rows,
            )
            yield pa.record_batch(
                [*batch.columns[1:], pa.array(fps.view(np.int64))], [*keep, name]
            )

    kept = [quoted(c) for c in keep]
    text = F.col("text").cast("string").alias(free_name(list(keep), "read"))
    schema = with_columns(docs.select(*kept), f"{name} long")
    return mapped(docs.select(text, *kept), run, schema)


#: (first bit, width) from the highest bit on.
Block = tuple[int, int]


def blocks(n: int) -> list[Block]:
    """n blocks over the 64 bits."""
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def choices(max_bits: int, count: int) -> list[tuple[Block, ...]]:
    """The least choices of k of max_bits + k blocks whose nodes hold few of count by chance."""
    for k in range(1, 65 - max_bits):
        found = list(combinations(blocks(max_bits + k), k))
        if count >> min(sum(w for _, w in c) for c in found) <= BY_CHANCE:
            break
    return found


def links(
    fps: DataFrame, max_bits: int = MAX_BITS, cap: int = CAP, count: int | None = None
) -> DataFrame:
    """Rows (a, b) whose components are those of all links of at most max_bits bits.

    A row joins a fingerprint with one that it reaches by links in the same unit. fps has one
    column fp of distinct non-null longs, and count rows; it is counted if that isn't given.
    """
    ship(fps.sparkSession)
    chosen = choices(max_bits, fps.count() if count is None else count)
    starts = [own[0][0] for own in chosen]

    def bits(a: int, w: int) -> Column:
        return F.shiftrightunsigned("fp", 64 - a - w).bitwiseAND(F.lit((1 << w) - 1))

    def value(own: tuple[Block, ...]) -> Column:
        joined = (F.shiftleft(bits(*x), sum(w for _, w in own[i + 1 :])) for i, x in enumerate(own))
        return reduce(Column.bitwiseOR, joined)

    keyed = fps.select(
        "fp", F.posexplode(F.array(*map(value, chosen))).alias("block", "value")
    )
    large = (
        keyed.groupBy("block", "value")
        .count()
        .filter(F.col("count") > cap)
        .select(
            "block",
            # dealt anew, so that adaptive execution can split a hot node (see graph.components)
            F.col("value").bitwiseXOR(F.lit(0).cast("long")).alias("value"),
            F.ceil(F.col("count") / cap).cast("int").alias("chunks"),
        )
    )
    chunks = F.coalesce("chunks", F.lit(1))
    units = (
        keyed.join(large, ["block", "value"], "left")
        .withColumn("own", F.pmod(F.xxhash64("fp"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select(
            "block",
            "value",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).alias("right"),
            "fp",
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0
        for batch in batches:
            held.append(_columns(batch))
            count += batch.num_rows
            if count >= BATCH_ROWS:
                rows = np.concatenate(held, axis=1)
                last = np.flatnonzero((rows[:4] != rows[:4, -1:]).any(axis=0))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last unit may go on
                held, count = [rows[:, cut:]], rows.shape[1] - cut
                if cut:
                    yield _found(rows[:, :cut], starts, max_bits)
        if count:
            yield _found(np.concatenate(held, axis=1), starts, max_bits)

    key = ["block", "value", "i", "j"]
    return units.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(i).cast(pa.int64()).to_numpy() if i != 4 else batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)])


def _found(rows: np.ndarray, starts: list[int], max_bits: int) -> pa.RecordBatch:
    a, b = walk(rows, starts, max_bits)
    return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])


def walk(
    rows: np.ndarray, starts: list[int], max_bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of fingerprints, of the links in every unit of rows.

    rows: block, value, i, j, right, fp; units are the runs of equal (block, value, i, j). A unit
    with i = j joins its fingerprints with one another, any other joins its left with its right.
    starts: by block, the bit that is first in its trie.
    """
    block, fp = rows[0], rows[5].view(np.uint64)
    start = np.array(starts, np.uint64)[block]
    turned = (fp << start) | (fp >> ((np.uint64(64) - start) & np.uint64(63)))
    turned = np.where(start == 0, fp, turned)
    new = np.concatenate(([True], (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)))
    unit = np.cumsum(new) - 1
    order = np.lexsort((turned, rows[4], unit))
    key, fp, side, unit = turned[order], fp[order], rows[4][order], unit[order]
    lo = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    hi = np.append(lo[1:], len(unit))
    left = hi - np.add.reduceat(side, lo)
    own = (rows[2] == rows[3])[order][lo]
    al, ah = lo, np.where(own, hi, left)
    bl, bh = np.where(own, lo, left), hi
    used = np.zeros(len(lo), np.int64)
    label = np.arange(len(key))

    for depth in range(65):
        keep = (ah > al) & (bh > bl) & (used <= max_bits) & ~((al == bl) & (ah - al < 2))
        al, ah, bl, bh, used = al[keep], ah[keep], bl[keep], bh[keep], used[keep]
        leaf = ((ah - al) * (bh - bl) <= LEAF_PAIRS) | (depth == 64)
        _verify(key, label, al[leaf], ah[leaf], bl[leaf], bh[leaf], max_bits)
        al, ah, bl, bh, used = al[~leaf], ah[~leaf], bl[~leaf], bh[~leaf], used[~leaf]
        if not len(al):
            break
        zero = (key >> np.uint64(63 - depth)) & np.uint64(1) == 0
        zeros = np.concatenate(([0], np.cumsum(zero)))
        am, bm = al + zeros[ah] - zeros[al], bl + zeros[bh] - zeros[bl]
        two = al != bl  # for a node with itself, (1, 0) is (0, 1) again
        al, ah, bl, bh, used = (
            np.concatenate(x)
            for x in (
                (al, am, al, am[two]),
                (am, ah, am, ah[two]),
                (bl, bm, bm, bl[two]),
                (bm, bh, bh, bm[two]),
                (used, used, used + 1, used[two] + 1),
            )
        )
    linked = np.flatnonzero(label != np.arange(len(label)))
    pairs = np.unique(np.stack([fp[linked], fp[label[linked]]]), axis=1)
    return pairs[0].view(np.int64), pairs[1].view(np.int64)


def _verify(key, label, al, ah, bl, bh, max_bits: int) -> None:
    """Compare all pairs of small nodes by their whole fingerprints and join the labels of links."""
    width = bh - bl
    sizes = (ah - al) * width
    done = np.concatenate(([0], np.cumsum(sizes)))
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(done, done[first] + BATCH_PAIRS)) - 1)
        n = sizes[first:last]
        at = np.arange(n.sum()) - np.repeat(done[first:last] - done[first], n)
        w = np.repeat(width[first:last], n)
        u = np.repeat(al[first:last], n) + at // w
        v = np.repeat(bl[first:last], n) + at % w
        near = np.bitwise_count(key[u] ^ key[v]) <= max_bits
        near &= u != v
        merge_labels(label, u[near], v[near])
        first = last


def near_duplicates(
    docs: DataFrame, max_bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of docs.

    Null and empty texts have fingerprint zero and are linked like any other; repeated doc_ids
    keep their rows. component_id is the smallest doc_id reachable by links; a row without a
    doc_id gets a component too, which is null if no member has an id. Other columns are ignored.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = saved(fingerprints(ids, shingle_words), "fingerprints")
    rooted = _rooted(own, max_bits)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _rooted(own: DataFrame, max_bits: int) -> DataFrame:
    """Rows (fp, first, root): each fingerprint with its smallest doc_id and its component."""
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(nodes.select("fp"), max_bits))
    return nodes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )


def representatives(
    docs: DataFrame, max_bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """One row of docs for each group of near duplicates: that with the smallest doc_id.

    Of rows with that doc_id the one with the smallest fingerprint and then text stays; a group
    without ids keeps one row too. The columns are those of docs.
    """
    columns = docs.columns
    fp, key, place = (free_name(columns, n) for n in ("fp", "key", "place"))
    own = saved(fingerprints(docs, shingle_words, columns, fp), "fingerprints")
    ids = own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"))
    first = F.struct(F.col("first").isNull(), "first", "fp")
    chosen = (
        _rooted(ids, max_bits)
        .groupBy("root")
        .agg(F.min(first).alias("first"))
        .select(
            F.coalesce(F.col("first.first").cast("string"), F.lit("")).alias(key),
            F.col("first.fp").alias(fp),
        )
    )
    doc_id = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    number = F.row_number().over(Window.partitionBy(key, fp).orderBy("text"))
    return (
        own.withColumn(key, doc_id)
        .join(chosen, [key, fp], "left_semi")
        .withColumn(place, number)
        .filter(F.col(place) == 1)
        .select(*map(quoted, columns))
    )
