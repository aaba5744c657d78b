"""Embedding near-duplicates: exact pairs over a cosine threshold by cover trees.

A cover tree nests balls of halving radii. Two trees are walked together from their roots: a pair
of nodes is dropped when their centres are farther apart than the threshold and both covering
radii, and taken as a whole, without listing its pairs, when all their points must be near.

The tree's upper levels come from a bounded sample, each level keeping the centres of the one above.
Of these levels that one becomes the table's cells which leaves the least work on a part of the
sample that has no centres.
Every vector goes to its nearest centre; those within the level's radius are its inner cell, and
what lies farther out is an outer one, so that a stray vector doesn't widen a cluster's ball. Cells
are cut into chunks of bounded size, and a vector is sent only to chunks of cells whose distances
from their centre, and its own, leave room for something near it. Each pair of chunks is one task.
Equal vectors are one node with a count. A task returns counts of links and a spanning forest of
them, not pairs. In data without clusters, at a distance where balls say little, one cell with all
pairs of its chunks remains; this is the price of an exact answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackscan.llm.common import saved, ship
from trackscan.llm.graph import components, merge_labels

COSINE = 0.95
#: Distinct vectors that the upper levels are built from, and vectors of a chunk.
SAMPLE, CHUNK = 16_384, 8_192
#: What a pair of chunks costs beside its comparisons, in comparisons.
TASK = 500_000
LEAF, BLOCK = 16, 512
#: Vectors that are held against all centres at once, and copies that are sent out at once.
ROWS, COPIES = 128, 16_384
#: Bounds of rounding: of distances in double precision, and of cosines in single precision. Single
#: precision only rules pairs out or in when even its bound does; the rest is decided in double.
MARGIN, ROUGH = 1e-6, 2e-5
#: Balls of a smaller radius are leaves, as single precision doesn't tell their points apart.
LEAST_RADIUS = 0.01


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares keep their range."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def net(x: np.ndarray, radius: float) -> np.ndarray:
    """The centre of each point: centres are points about more than radius apart, in order, the
    first point among them; every point is about within radius of its own."""
    rough = x.astype(np.float32)
    least_cos = np.float32(1 - radius * radius / 2)
    centre = np.full(len(x), -1)
    left = np.arange(len(x))
    while len(left):
        batch = left[: BLOCK // 2]
        cos = rough[batch] @ rough[left].T
        chosen: list[int] = []
        free = np.ones(len(batch), bool)
        near = cos[:, : len(batch)] >= least_cos
        for i in range(len(batch)):
            if free[i]:
                chosen.append(i)
                free &= ~near[i]
        own = np.array(chosen)
        cos = cos[own]
        best = cos.argmax(axis=0)
        within = cos[best, np.arange(len(left))] >= least_cos
        best[own], within[own] = np.arange(len(own)), True
        centre[left[within]] = batch[own[best[within]]]
        left = left[~within]
    return centre


def to_centre(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Distance of each point to its centre, in double precision; 0 for centres."""
    return np.sqrt(((x - x[centre]) ** 2).sum(axis=1))


class CoverTree:
    """Nodes in arrays: points of node i are order[lo[i]:hi[i]], its centre the first of them.

    A ball wider than reach with only a few points decides nothing that its points don't decide
    as well, so they become nodes themselves.
    """

    def __init__(self, x: np.ndarray, reach: float) -> None:
        self.order = np.arange(len(x))
        lo, hi, radius = [0], [len(x)], [2.0]
        rho = [float(distances(x[:1], x).max())] if len(x) else [0.0]
        kid, kids = [0], [0]
        i = 0
        while i < len(lo):
            a, b = lo[i], hi[i]
            if b - a > (LEAF if rho[i] <= reach else 1) and rho[i] > LEAST_RADIUS:
                r = radius[i] / 2
                while r >= rho[i]:
                    r /= 2
                own = self.order[a:b]
                centre = net(x[own], r)
                size = np.bincount(centre, minlength=b - a)[centre]
                apart = to_centre(x[own], centre)
                widest = np.zeros(b - a)
                np.maximum.at(widest, centre, apart)
                alone = (size <= LEAF) & (widest[centre] > reach)
                centre[alone], apart[alone] = np.flatnonzero(alone), 0.0
                # a centre stands first among its points
                at = np.lexsort((np.arange(b - a) != centre, centre))
                self.order[a:b], centre, apart = own[at], centre[at], apart[at]
                first = np.flatnonzero(np.concatenate(([True], centre[1:] != centre[:-1])))
                kid[i], kids[i] = len(lo), len(first)
                lo += (a + first).tolist()
                hi += (a + np.append(first[1:], b - a)).tolist()
                rho += np.maximum.reduceat(apart, first).tolist()
                radius += [r] * len(first)
                kid += [0] * len(first)
                kids += [0] * len(first)
            i += 1
        self.x = x[self.order]
        self.rough = self.x.astype(np.float32)
        self.lo, self.hi, self.rho = np.array(lo), np.array(hi), np.array(rho)
        self.kid, self.kids = np.array(kid), np.array(kids)
        self.size = self.hi - self.lo

    def below(self, i: int) -> np.ndarray:
        return np.arange(self.kid[i], self.kid[i] + self.kids[i]) if self.kids[i] else np.array([i])


class Links:
    """Counts of links by point, and the sets that they join; points of both trees in one row."""

    def __init__(self, left: CoverTree, right: CoverTree, weights: list[np.ndarray]) -> None:
        self.trees = (left, right)
        self.base = (0, 0 if left is right else len(left.order))
        self.weight = weights[0] if left is right else np.concatenate(weights)
        # positions follow the trees' own orders
        self.point = np.concatenate([t.order + b for t, b in zip(self.trees[: 1 + (left is not right)], self.base, strict=False)])
        self.weight = self.weight[self.point]
        self.count = np.zeros(len(self.weight), np.int64)
        self.label = np.arange(len(self.weight))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Single links between positions a of the left and b of the right tree."""
        a, b = a + self.base[0], b + self.base[1]
        np.add.at(self.count, a, self.weight[b])
        np.add.at(self.count, b, self.weight[a])
        merge_labels(self.label, a, b)

    def all_between(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        i, j = slice(a[0] + self.base[0], a[1] + self.base[0]), slice(b[0] + self.base[1], b[1] + self.base[1])
        self.count[i] += self.weight[j].sum()
        self.count[j] += self.weight[i].sum()
        own = np.concatenate([np.arange(i.start, i.stop), np.arange(j.start, j.stop)])
        merge_labels(self.label, own, np.full(len(own), i.start))

    def all_within(self, a: tuple[int, int]) -> None:
        i = slice(*a)
        self.count[i] += self.weight[i].sum() - self.weight[i]
        own = np.arange(*a)
        merge_labels(self.label, own, np.full(len(own), a[0]))


def walk(left: CoverTree, right: CoverTree, weights: list[np.ndarray], cosine: float) -> Links:
    """All links between two trees, or within one if they are the same."""
    reach = float(np.sqrt(2 - 2 * cosine))
    links = Links(left, right, weights)
    same = left is right

    def check(p: np.ndarray, q: np.ndarray) -> None:
        """Links among pairs of single points, by cosines in double precision."""
        a, b = left.lo[p], right.lo[q]
        near = np.einsum("ij,ij->i", left.x[a], right.x[b]) >= cosine
        links.pairs(a[near], b[near])

    todo = [(0, 0)] if len(left.order) and len(right.order) else []
    while todo:
        a, b = todo.pop()
        own = same and a == b
        span_a, span_b = (left.lo[a], left.hi[a]), (right.lo[b], right.hi[b])
        if own and 2 * left.rho[a] <= reach - MARGIN:
            links.all_within(span_a)
            continue
        if not left.kids[a] and not right.kids[b]:
            for at in range(span_a[0], span_a[1], BLOCK):
                some = left.x[at : min(at + BLOCK, span_a[1])]
                i, j = np.nonzero(some @ right.x[slice(*span_b)].T >= cosine)
                i, j = i + at, j + span_b[0]
                if own:
                    i, j = i[i < j], j[i < j]
                links.pairs(i, j)
            continue
        rows, columns = left.below(a), right.below(b)
        if own:
            todo += [(int(k), int(k)) for k in rows if left.size[k] > 1]
        for at in range(0, len(rows), BLOCK):
            some = rows[at : at + BLOCK]
            cos = left.rough[left.lo[some]] @ right.rough[right.lo[columns]].T
            p1, q1 = left.size[some] == 1, right.size[columns] == 1
            i, j = np.nonzero(cos >= np.float32(cosine - ROUGH))
            keep = p1[i] & q1[j] & (some[i] < columns[j] if own else True)
            check(some[i[keep]], columns[j[keep]])
            # pairs with a ball: all columns for the balls among the rows, the balls for the others
            for u, v in ((~p1, np.ones(len(columns), bool)), (p1, ~q1)):
                p, q = np.flatnonzero(u), np.flatnonzero(v)
                bound = left.rho[some[p]][:, None] + right.rho[columns[q]][None]
                square = 2 - 2 * cos[np.ix_(p, q)].astype(np.float64)
                i, j = np.nonzero(square - 2 * ROUGH <= (reach + bound + MARGIN) ** 2)
                highest = np.sqrt(np.maximum(square[i, j] + 2 * ROUGH, 0)) + bound[i, j]
                p, q = some[p[i]], columns[q[j]]
                if own:
                    highest, p, q = highest[p < q], p[p < q], q[p < q]
                inside = highest <= reach - MARGIN
                for x, y in zip(p[inside].tolist(), q[inside].tolist(), strict=True):
                    links.all_between((left.lo[x], left.hi[x]), (right.lo[y], right.hi[y]))
                todo += zip(p[~inside].tolist(), q[~inside].tolist(), strict=True)
    return links


class Cells:
    """Inner and outer cells of some centres: cell 2 * c within the radius of centre c, 2 * c + 1
    beyond it. lo and hi bound the distances of a cell's vectors from its centre."""

    def __init__(self, centres: np.ndarray, radius: float) -> None:
        self.centres, self.radius = centres, radius
        self.lo = np.full(2 * len(centres), np.inf)
        self.hi = np.full(2 * len(centres), -np.inf)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells, distances from their centres, distances from all centres) of some vectors."""
        far = distances(x, self.centres)
        nearest = far.argmin(axis=1)
        own = far[np.arange(len(far)), nearest]
        return 2 * nearest + (own > self.radius), own, far

    def may_meet(self, far: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cell) wherever a cell may hold something within reach of a vector."""
        twice = np.repeat(far, 2, axis=1)
        slack = reach + MARGIN
        return np.nonzero((twice >= self.lo - slack) & (twice <= self.hi + slack))


def upper_level(sample: np.ndarray, rows: int, reach: float, chunk: int = CHUNK) -> Cells:
    """The level that leaves the least work for so many rows; ties to the coarsest.

    Centres are of the first seven eighths of the sample. The work is judged on the rest, as vectors
    that are centres themselves would make every fine level look good, and with the widest bounds
    that cells can have: few vectors in a cell would make them look narrow.
    """
    part = -(-7 * len(sample) // 8)
    sample, judged = sample[:part], sample[part:]
    best, least = Cells(sample[:1], 2.0), np.inf
    order, radius, scale = np.arange(part), 2.0, rows / max(len(judged), 1)
    blocks = [judged[at : at + ROWS] for at in range(0, len(judged), ROWS)]
    while blocks and radius > reach / 4:
        # the centres of the level above come first, so that they are centres again
        first = np.unique(net(sample[order], radius))
        order = np.concatenate([order[first], np.delete(order, first)])
        cells = Cells(sample[order[: len(first)]], radius)
        own, far = (np.concatenate(v) for v in zip(*[cells.place(x)[:2] for x in blocks], strict=True))
        size = np.bincount(own, minlength=len(cells.lo))
        inner = np.flatnonzero(size)[np.flatnonzero(size) % 2 == 0]
        outer = np.flatnonzero(size)[np.flatnonzero(size) % 2 == 1]
        cells.lo[inner], cells.hi[inner] = 0.0, radius
        cells.lo[outer], cells.hi[outer] = radius, far.max()
        chunks = np.ceil(size * scale / chunk)
        used = np.cumsum(size > 0) - 1
        met = np.zeros((used[-1] + 1, used[-1] + 1), bool)
        compared = 0.0
        for at, x in enumerate(blocks):
            i, c = cells.may_meet(distances(x, cells.centres), reach)
            compared += size[c].sum()
            met[used[own[at * ROWS + i]], used[c]] = True
        # most cells of a fine level have none of the judged vectors; their share of pairs is taken
        # for that of all cells
        cells_in_all = len(first) * len(met) / max(len(inner), 1)
        tasks = met.mean() * max(cells_in_all, chunks.sum()) ** 2
        work = compared * scale * scale / 2 + TASK * float(tasks) / 2
        if work < 0.9 * least:
            best, least = cells, work
        radius /= 2
    return Cells(best.centres, best.radius)


def near_duplicates(
    rows: DataFrame,
    cosine: float = COSINE,
    dimensions: int | None = None,
    chunk: int = CHUNK,
    id_column: str = "vec_id",
    column: str = "embedding",
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row.

    n_links counts the other vectors at a cosine of at least the threshold; component_id is the
    smallest vec_id reachable by links, itself included. Vectors that are null, zero, not of
    ``dimensions`` components (unless given, the commonest number in the table, the larger of two),
    or that hold null or non-finite components link with nothing. So do rows without an id; their component_id and kept are null. Rows that repeat an id are
    vectors of their own that share it. Other columns are ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    vectors = rows.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("embedding")
    )
    if dimensions is None:
        sizes = vectors.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("size")).count()
        top = sizes.orderBy(F.desc("count"), F.desc("size")).first()
        dimensions = top["size"] if top else 1
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = (
        F.col("vec_id").isNotNull()
        & (F.size("embedding") == dimensions)
        & finite
        & F.exists("embedding", lambda x: x != 0)
    )
    usable = F.coalesce(usable, F.lit(False))
    classes = saved(
        vectors.filter(usable).groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")),
        "vectors",
    )
    drawn = classes.orderBy(F.xxhash64(F.lit(5), "embedding"), "first").limit(SAMPLE)
    sample = np.array([r[0] for r in drawn.select("embedding").collect()], np.float64)
    sample = sample.reshape(-1, dimensions)
    reach = float(np.sqrt(2 - 2 * cosine))
    cells = upper_level(unit(sample) if len(sample) else sample, classes.count(), reach, chunk)
    # written, so that a vector's cell is decided once
    classes = saved(_placed(classes, cells), "nodes")
    found = saved(_links(classes, cells, cosine, chunk), "links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b"))
    by_node = (
        classes.join(counts, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    smallest = by_node.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = by_node.join(smallest, "root").select(
        "embedding",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        "component_id",
    )
    linked = vectors.filter(usable).join(by_class, "embedding")
    alone = vectors.filter(~usable).select(
        "embedding", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.select(alone.columns).union(alone).select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")
    )


def _matrix(column: pa.Array, cells: Cells) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return unit(flat.reshape(-1, cells.centres.shape[1]))


def _blocks(batches):
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _placed(classes: DataFrame, cells: Cells) -> DataFrame:
    """Classes of equal vectors, with a number, their cell and the distance from its centre."""

    def place(batches):
        for batch in _blocks(batches):
            cell, own, _ = cells.place(_matrix(batch.column(2), cells))
            yield pa.record_batch(
                [*batch.columns, pa.array(cell), pa.array(own)],
                [*batch.schema.names, "cell", "far"],
            )

    nodes = classes.select(F.monotonically_increasing_id().alias("node"), "n", "embedding", "first")
    kind = classes.schema["embedding"].dataType.simpleString()
    return nodes.mapInArrow(
        place, f"node long, n long, embedding {kind}, first long, cell long, far double"
    )


def _links(classes: DataFrame, cells: Cells, cosine: float, chunk: int) -> DataFrame:
    """Rows (a, b, links): b null for a count of node a's links, else a link of the forest."""
    reach = float(np.sqrt(2 - 2 * cosine))
    kind = classes.schema["embedding"].dataType.simpleString()
    node = f"node long, n long, embedding {kind}"
    placed = classes.select("node", "n", "embedding", "cell", "far")
    # two rows at most for each vector of the sample
    sizes = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")
    )
    chunks = np.zeros(len(cells.lo), np.int64)
    for r in sizes.collect():
        chunks[r["cell"]] = -(-r["n"] // chunk)
        cells.lo[r["cell"]], cells.hi[r["cell"]] = r["lo"], r["hi"]
    base = np.concatenate(([0], np.cumsum(chunks)))[:-1]

    def deal(batches):
        """A copy of each vector for every pair of chunks that it takes part in."""
        for batch in _blocks(batches):
            keys = batch.column(0).to_numpy()
            cell = batch.column(3).to_numpy()
            hashed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own = base[cell] + (hashed % chunks[cell].astype(np.uint64)).astype(np.int64)
            row, met = cells.may_meet(distances(_matrix(batch.column(2), cells), cells.centres), reach)
            n = chunks[met]
            row = np.repeat(row, n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            other = np.repeat(base[met], n) + nth
            mine = own[row]
            for at in range(0, len(row), COPIES):
                some = slice(at, at + COPIES)
                taken = batch.take(pa.array(row[some]))
                yield pa.record_batch(
                    [
                        *taken.columns[:3],
                        pa.array(np.minimum(mine[some], other[some])),
                        pa.array(np.maximum(mine[some], other[some])),
                        pa.array(mine[some] > other[some]),
                    ],
                    ["node", "n", "embedding", "i", "j", "right"],
                )

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        keys, weight = table["node"].to_numpy(), table["n"].to_numpy()
        x = _matrix(table["embedding"].chunk(0), cells)
        right = table["right"].to_numpy()
        if i == j:
            tree = CoverTree(x, reach)
            links, keys = walk(tree, tree, [weight], cosine), keys
        else:
            first, second = np.flatnonzero(~right), np.flatnonzero(right)
            both = (CoverTree(x[first], reach), CoverTree(x[second], reach))
            links = walk(*both, [weight[first], weight[second]], cosine)
            keys = np.concatenate([keys[first], keys[second]])
        keys = keys[links.point]
        own = np.flatnonzero(links.count)
        tied = np.flatnonzero(links.label != np.arange(len(keys)))
        none = pa.nulls(len(own), pa.int64())
        return pa.table(
            {
                "a": pa.concat_arrays([pa.array(keys[own]), pa.array(keys[tied])]),
                "b": pa.concat_arrays([none, pa.array(keys[links.label[tied]])]),
                "links": np.concatenate([links.count[own], np.zeros(len(tied), np.int64)]),
            }
        )

    dealt = placed.mapInArrow(deal, node + ", i long, j long, right boolean")
    return dealt.groupBy("i", "j").applyInArrow(join, "a long, b long, links long")
