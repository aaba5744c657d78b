import duckdb
import numpy as np
import pytest

from trackscan.llm import cover_tree, graph, mih

ROWS = "vec_id long, embedding array<float>, node string, n string, label int"


def vectors(n=300, dims=64, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims))
    x[n // 2 :] = x[: n - n // 2] + r.normal(size=(n - n // 2, dims)) * r.uniform(0, 0.5, (n - n // 2, 1))
    x[:20] = x[0]  # equal vectors, and scaled ones
    x[20:30] = x[0] * np.arange(1, 11)[:, None]
    x[60:120] = x[50] + r.normal(size=(60, dims)) * 0.05
    return x.astype(np.float32)


def awkward():
    nan, inf = float("nan"), float("inf")
    return [
        (1001, None), (1002, [0.0] * 64), (1003, [nan] + [1.0] * 63), (1004, [inf] * 64),
        (1005, [None] + [1.0] * 63), (1006, []), (1007, [1.0] * 5), (None, [1.0] * 64),
        (None, None), (1008, [3e38] * 64), (1009, [1e-40] * 64), (1008, [3e38] * 64),
    ]


def table(spark, rows):
    return spark.createDataFrame([(k, v, "x", "y", 1) for k, v in rows], ROWS)


@pytest.mark.parametrize("chunk", [50, 8192])
def test_cover_tree_links(spark, chunk):
    x = vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + awkward()
    found = cover_tree.near_duplicates(table(spark, rows), chunk=chunk).collect()
    assert len(found) == len(rows)
    u = cover_tree.unit(np.concatenate([x, np.full((3, 64), 1, np.float32)]))
    ids = [*range(len(x)), 1008, 1009, 1008]
    a, b = np.nonzero(u @ u.T >= 0.95)
    a, b = a[a != b], b[a != b]
    counts = np.bincount(a, minlength=len(u))
    label = graph.merge_labels(np.arange(len(u)), a, b)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found if r.vec_id in ids)
    want = [(k, c, min(i for i, m in zip(ids, label, strict=True) if m == g)) for k, c, g in zip(ids, counts, label, strict=True)]
    assert got == sorted((k, c, g, k == g) for k, c, g in want)
    for r in found:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, None)
        elif r.vec_id not in ids:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert cover_tree.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize(("clusters", "sample"), [(64, 2048), (512, 4096)])
def test_clusters_have_cells_of_their_own(spark, clusters, sample):
    r = np.random.default_rng(clusters)
    middles = cover_tree.unit(r.normal(size=(clusters, 64)))
    x = np.repeat(middles, 4096 // clusters, axis=0)
    x = cover_tree.unit(x + r.normal(size=x.shape) * r.uniform(0, 0.03, (len(x), 1)))
    x = np.concatenate([x, cover_tree.unit(r.normal(size=(60, 64)))])  # and some strays
    drawn = x[r.permutation(len(x))[:sample]]
    cells = cover_tree.upper_level(drawn, 10_000_000, 0.3162)
    assert 0.9 * clusters <= len(cells.centres) <= clusters + 60
    # what a vector is compared with: about its own cluster, and the strays
    own, far, all_far = cells.place(x)
    np.minimum.at(cells.lo, own, far)
    np.maximum.at(cells.hi, own, far)
    row, met = cells.may_meet(all_far, 0.3162)
    size = np.bincount(own, minlength=len(cells.lo))
    assert size[met].sum() <= 2 * len(x) * len(x) / clusters + 60 * len(x)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = {v.vec_id: v for v in cover_tree.near_duplicates(table(spark, rows), chunk=300).collect()}
    u = cover_tree.unit(x.astype(np.float32))
    near = u @ u.T >= 0.95
    assert [found[i].n_links for i in range(len(x))] == (near.sum(axis=1) - 1).tolist()
    a, b = np.nonzero(near)
    label = graph.merge_labels(np.arange(len(x)), a, b)
    first = {g: int(np.flatnonzero(label == g)[0]) for g in set(label.tolist())}
    assert [found[i].component_id for i in range(len(x))] == [first[g] for g in label.tolist()]


def test_work_grows_with_the_rows_of_4096_clusters():
    r = np.random.default_rng(9)
    middles = cover_tree.unit(r.normal(size=(4096, 64)))
    x = cover_tree.unit(np.repeat(middles, 12, axis=0) + r.normal(size=(4096 * 12, 64)) * 0.02)
    x = x[r.permutation(len(x))]
    cells = cover_tree.upper_level(x[: cover_tree.SAMPLE], 100_000_000, 0.3162)
    places = [cells.place(x[at : at + 512]) for at in range(0, 8192, 512)]
    own = np.concatenate([p[0] for p in places])
    np.minimum.at(cells.lo, own, np.concatenate([p[1] for p in places]))
    np.maximum.at(cells.hi, own, np.concatenate([p[1] for p in places]))
    sent = np.concatenate([cells.may_meet(p[2], 0.3162)[0] for p in places])
    size = np.bincount(own, minlength=len(cells.lo))
    met = sum(size[cells.may_meet(p[2], 0.3162)[1]].sum() for p in places)
    assert len(cells.centres) > 3800 and (own % 2).mean() < 0.06
    assert met <= 0.01 * 8192 * 8192 and len(sent) <= 1.1 * 8192
    # without clusters there is one cell, until so many rows that even a small share of pairs pays
    free = cover_tree.unit(r.normal(size=(cover_tree.SAMPLE, 64)))
    assert [len(cover_tree.upper_level(free, n, 0.3162).centres) for n in (10**4, 10**6)] == [1, 1]
    cells = cover_tree.upper_level(free, 10**8, 0.3162)
    more = cover_tree.unit(r.normal(size=(1024, 64)))
    own, far, all_far = cells.place(more)
    cells.lo[0::2], cells.hi[0::2], cells.lo[1::2], cells.hi[1::2] = 0, cells.radius, cells.radius, 2
    size = np.bincount(own, minlength=len(cells.lo))
    assert size[cells.may_meet(all_far, 0.3162)[1]].sum() <= 0.9 * len(more) ** 2


def test_other_lengths(spark):
    rows = [(i, [1.0, float(i % 2), 0.0]) for i in range(6)] + [(9, [1.0, 0.0]), (10, [1.0, 0.0])]
    found = {r.vec_id: r.n_links for r in cover_tree.near_duplicates(table(spark, rows)).collect()}
    assert found == {**dict.fromkeys(range(6), 2), 9: 0, 10: 0}


def test_trees_cover_and_count():
    r = np.random.default_rng(6)
    tight = vectors(300, seed=5)[200] + r.normal(size=(200, 64)) * np.repeat([1e-9, 1e-5, 1e-3, 0.02], 50)[:, None]
    x = cover_tree.unit(np.concatenate([vectors(900, seed=4).astype(float), tight]))
    tree = cover_tree.CoverTree(x, 0.3162)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    for i in range(len(tree.lo)):
        own = tree.x[tree.lo[i] : tree.hi[i]]
        assert cover_tree.distances(own[:1], own).max() <= tree.rho[i] + 1e-7
    weight = np.arange(1, len(x) + 1)
    links = cover_tree.walk(tree, tree, [weight], 0.95)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    count = np.zeros(len(x), np.int64)
    count[links.point] = links.count
    assert (count == near @ weight).all()


def test_top_k(spark):
    r = np.random.default_rng(2)
    codes = r.integers(0, 1 << 63, 400, dtype=np.int64)
    codes[100:200] = codes[0]  # one code that many have
    codes[200:300] = codes[1] ^ (1 << r.integers(0, 63, 100))
    rows = [(i, int(c)) for i, c in enumerate(codes)] + [(5, int(codes[5]))]
    known = spark.createDataFrame(rows, "id long, code long")
    asked = known.filter("id % 7 = 0")
    found = mih.top_k(known, asked, 10).collect()
    got = {}
    for q in found:
        got.setdefault(q.query_id, []).append((q.rank, q.distance, q.id))
    for i in range(0, 400, 7):
        near = sorted((int(codes[i] ^ c).bit_count(), j) for j, c in enumerate(codes) if j != i)
        assert sorted(got[i]) == [(n + 1, *x) for n, x in enumerate(near[:10])]
    few = known.filter("id IN (7, 8)")
    assert [(x.query_id, x.id) for x in mih.top_k(few, few.filter("id = 7"), 10).collect()] == [(7, 8)]
    assert mih.top_k(known.limit(0), asked.limit(0), 10).count() == 0


def test_top_k_by_sql(spark):
    from trackscan.llm import queries

    rows = [(i, v.tolist()) for i, v in enumerate(vectors(350))]
    codes = mih.sign_codes(table(spark, rows + awkward()))
    assert codes.count() == len(rows) + 5  # zeros, infinite and extreme components have signs
    codes = mih.sign_codes(table(spark, rows))
    got = mih.top_k(codes, codes.filter("id % 100 = 0"), 10).toPandas()
    embeddings = table(spark, rows).toPandas()  # noqa: F841
    want = duckdb.sql(queries.OP2_SQL).df()
    key = ["query_id", "rank"]
    assert got.sort_values(key).values.tolist() == want[got.columns].sort_values(key).values.tolist()
