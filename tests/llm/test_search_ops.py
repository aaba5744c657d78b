"""Lexical search, hard negatives and toxicity against plain versions."""

import math
import random
import re
from collections import Counter

import cases
import numpy as np
import pytest

from trackscan.llm import hard_negatives, lexical, toxicity

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    known = [(i, Counter(plain_terms(t))) for i, t in docs if plain_terms(t)]
    total = sum(sum(c.values()) for _, c in known)
    df = Counter(t for _, c in known for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, count in known:
            m = 75 + (25 * sum(count.values()) * len(known)) // total
            score = 0
            for t in plain_terms(text):
                if t in count:
                    w = math.floor(1000 * math.log((2 * len(known) + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * count[t]) // (1000 * count[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, n + 1, x[3], -x[0]) for n, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("part", [40, 1 << 18])
def test_lexical_search(spark, monkeypatch, part):
    monkeypatch.setattr(lexical, "PART_POSTINGS", part)
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "ß", "naïve", "日本"]
    docs = [(i, " ".join(r.choices(words, k=r.choice((3, 9, 9, 30, 200))))) for i in range(80)]
    docs += [(i, docs[0][1]) for i in (500, 501, 502)]  # ties
    docs += [(r[0], r[1]) for r in cases.rows()] + [(None, docs[3][1]), (7, "W1-W1_w2\x00w2"), (9, "!!")]
    items = [(i, " ".join(r.choices(words, k=4))) for i in range(12)]
    items += [(1, "w1 w1 w1 W2"), (2, ""), (3, None), (4, "unknown words"), (None, "É w5"), (5, docs[4][1] * 20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    index = lexical.build(frame.selectExpr("*", "1 AS m", "'x' AS docs", "2 AS terms"))
    for k in (1, 5, 200):
        found = [tuple(x) for x in lexical.search(index, asked, k).collect()]
        assert order(found) == order(plain_search(docs, items, k))


def test_lexical_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 8)
    docs = [(i, f"a{i % 3} b{i % 5} c{i}") for i in range(30)]
    items = [(i, f"a{i % 3} b{i % 2} c{i} x") for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = lexical.search(lexical.build(frame), asked, 4).collect()
    assert order(map(tuple, found)) == order(plain_search(docs, items, 4))
    none = lexical.build(frame.limit(0))
    assert (none.docs, none.length) == (0, 0) and lexical.search(none, asked).count() == 0
    assert lexical.search(lexical.build(frame), asked.limit(0)).count() == 0


def test_lexical_tasks_hold_few_rows_and_one_worker(spark, monkeypatch):
    made, saved = [], lexical.saved

    def seen(df, name):
        rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        steps = df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
        made.append((name.rsplit("/", 1)[-1].rsplit("-", 1)[0] if "/" in name else name, rows, steps, df))
        return saved(df, name)

    monkeypatch.setattr(lexical, "saved", seen)
    monkeypatch.setattr(lexical, "BATCH_TEXTS", 2, raising=False)
    docs = [(i, f"a{i % 3} b{i % 5} c{i}") for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"a{i % 3} c{i}") for i in range(20)], "item_id long, text string")
    found = lexical.search(lexical.build(frame), asked, 4).collect()
    assert order(map(tuple, found)) == order(plain_search(docs, [(i, f"a{i % 3} c{i}") for i in range(20)], 4))
    by_text = {name: (rows, steps) for name, rows, steps, _ in made if name in ("forward", "strata", "query-terms")}
    assert by_text == dict.fromkeys(("forward", "strata", "query-terms"), (2, 1))
    assert [df.rdd.getNumPartitions() for name, *_, df in made if name == "weights"] == [1]


def test_stratum_bounds_prune():
    ids, n = list(range(50)), [10] * 25 + [400] * 25
    words = [b"hit" if i in (3, 30) else b"other" for i in ids]
    tfs = [np.array([5 if i == 3 else 1]) for i in ids]
    part = lexical.strata(ids, n, words, tfs, 50, sum(n))
    assert part.num_rows == 2
    some = lexical.Strata(part, lexical.pa.array([b"hit"]))
    codes, weights = np.array([0]), np.array([1000])
    assert (some.bounds(codes, weights) > 0).all()
    best = some.search(codes, weights, 1, lexical.Best.none())
    assert best.ids.to_pylist() == [3]
    far = lexical.Best(np.array([10**12]), np.array([0]), lexical.pa.array([0]))
    some.run_key = None  # a visit would read it
    assert some.search(codes, weights, 1, far) is far


def plain_mined(rows):
    known = {}
    for i, v, label in rows:
        if i is None or v is None or label is None:
            continue
        if any(x is None or not math.isfinite(x) for x in v):
            continue
        known[i, label, tuple(math.floor(256 * x) for x in v)] = 1

    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    out = []
    for a, label, v in known:
        if a % 100:
            continue
        near = sorted((-score(v, w), i, m) for i, m, w in known if i != a)
        for s, p, _ in [x for x in near if x[2] == label][:5]:
            hard = [x for x in near if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(hard)]
    return out


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_SHARD", 64)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 16)
    r = np.random.default_rng(3)
    base = r.normal(size=(6, 19))
    rows = []
    for i in range(700):
        v = base[i % 6] + 0.4 * r.normal(size=19)
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(0, 3))))
    same = rows[100][1]
    rows += [(1000 + i, same, i % 2) for i in range(40)]  # ties
    rows += [(1100, same[:9], 1), (1200, [], 0), (1300, None, 1), (1400, same, None), (None, same, 0)]
    rows += [(1500, [*same[:-1], None], 0), (1600, [*same[:-1], float("nan")], 0), (1700, [*same[:-1], float("inf")], 0)]
    rows += [rows[200], rows[200], (300, same, 2), (1800, [-x for x in same], 7), (1900, [0.0] * 19, 0)]
    schema = "vec_id long, embedding array<float>, label int"
    frame = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS bits", "2 AS n", "'a' AS shard")
    found = [tuple(x) for x in hard_negatives.mined(frame.repartition(3)).collect()]
    want = plain_mined([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], m) for i, v, m in rows])
    assert len(want) > 100 and sorted(found) == sorted(want)
    assert hard_negatives.mined(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mined(spark.createDataFrame([(0, [1e9], 1)], schema)).count()


def test_bit_planes():
    r = np.random.default_rng(1)
    x, a = r.integers(-700, 700, (50, 21)), r.integers(-700, 700, (7, 21))
    bits = hard_negatives.planes(x, 11)
    assert (hard_negatives.unpacked(bits)[:, :21] == x).all()
    tables = hard_negatives.subset_sums(np.pad(a, ((0, 0), (0, 3))))
    assert (hard_negatives.scores(tables, bits) == x @ a.T).all()


def toxic_rows(n, seed):
    """Documents in which one sentence of a toxic one holds a bad stem with any ending."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        lines = [cases.prose(seed * n + 31 * i + j, r.randint(4, 12)) for j in range(r.randint(1, 25))]
        bad = None
        if r.random() < 0.3:
            at = r.randrange(len(lines))
            word = r.choice(("vorg", "Zwux", "qop")) + "".join(r.choices("aeinr", k=r.randint(0, 4)))
            lines[at] = bad = f"{lines[at]} {word} x"
        out.append((i, ". ".join(lines) + ".", bad))
    return out


def test_toxicity(spark):
    rows = toxic_rows(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(b is not None)) for i, _, b in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    found = toxicity.scored(docs, model).withColumn("held_out", toxicity.is_held_out()).collect()
    assert len(found) == 900
    truth = {i: b for i, _, b in rows}
    held = [r for r in found if r.held_out]
    right = [r.predicted == (truth[r.doc_id] is not None) for r in held]
    assert len(held) > 150 and sum(right) / len(right) > 0.95
    hits = [(r, r.text[s.start : s.end]) for r in held if truth[r.doc_id] for s in r.offending]
    assert sum(truth[r.doc_id] in text for r, text in hits) / len(hits) > 0.95
    for r in found:  # the score is the noisy-or of the sentences'
        spans = list(toxicity.sentences(r.text))
        assert "".join(r.text[a:b] for a, b in spans) == r.text
        clean = 1 - model.leak
        for a, b in spans:
            z = {f for w in toxicity.WORDS.findall(r.text[a:b].lower()) for f in toxicity.features(w)} & set(model.weights)
            if z:
                clean *= 1 - 1 / (1 + math.exp(-(model.offset + sum(model.weights[f] for f in z))))
        assert r.score == pytest.approx(1 - clean, abs=1e-6)


def test_toxicity_of_awkward_rows(spark):
    rows = toxic_rows(300, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    some = [(i, None, int(b is not None)) for i, _, b in rows] + [(None, 1, 1), (1, 1, None), (9999, 1, 1)]
    schema = "doc_id long, quality int, toxic int"
    model = toxicity.fit(docs, spark.createDataFrame(some, schema))
    awkward = cases.docs(spark).withColumn("a`b", toxicity.F.lit(1)).withColumn("offending", toxicity.F.lit(2))
    found = toxicity.scored(awkward, model).collect()
    assert len(found) == len(cases.rows())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    empty = [r.score for r in found if not (r.text or "").strip()]
    assert empty == pytest.approx([model.leak] * len(empty))
    assert toxicity.scored(cases.docs(spark, empty=True), model).count() == 0
    for share, labels in ((0.5, []), (2 / 3, [(1, 1, 1)]), (1 / 3, [(1, 1, 0)])):
        one = toxicity.fit(docs, spark.createDataFrame(labels, schema))
        assert [r.score for r in toxicity.scored(docs.limit(3), one).collect()] == pytest.approx([share] * 3)
    long = "x" * 2_000_000 + " vorgan. " + "word " * 400_000
    score, spans = toxicity.Scorer(model)(long)
    assert score > 0.3 and len(spans) == 1
