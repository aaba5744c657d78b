"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Only documents are labelled. A sentence has a logistic score over its words' features; a document's
score is the noisy-or of its sentences' and of a small leak, and the weights are trained through it
on the documents' labels. Afterwards the sentences with high scores are the offending ones.

Features are whole words and their character n-grams with word borders. Which ones are used is
decided by how their counts differ between documents of the two labels. A sentence without any of
them says nothing, so that a long clean document isn't suspected for its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.llm.common import mapped, saved, ship, with_columns

#: Labelled rows of either label that are learned from, chosen by a hash of their id.
TRAIN_ROWS = 6_000
#: Features of the model; a feature is looked at from this many training documents on.
FEATURES, LEAST_DOCS = 4_096, 3
#: Of a feature's log-odds, to be used: standard errors above zero. What stands in a larger share of
#: the clean documents says little of any one sentence.
LEAST_Z, MOST_CLEAN = 3.0, 0.05
GRAMS = (3, 4, 5, 6)
#: Longer words count as a whole in training, without their n-grams; scoring reads them all.
MOST_WORD = 64
THRESHOLD = 0.3
SHRINK, STEPS, RATE, LEAK = 1e-4, 400, 0.1, 1e-3
#: Distinct features that a task counts before it hands their counts on.
HELD_FEATURES = 300_000

WORDS = re.compile(r"\w+")
#: A sentence ends behind a mark that is followed by white space, or with its line.
ENDS = re.compile(r"[.!?](?=\s)|[。！？]|\n")


@dataclass(frozen=True)
class Model:
    """Plain values: the same on every executor. constant is set if there was nothing to learn."""

    weights: dict[str, float]
    offset: float
    leak: float
    constant: float | None = None


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every sentence, with the white space around it; none is empty."""
    past = 0
    for m in ENDS.finditer(text):
        yield past, m.end()
        past = m.end()
    if past < len(text):
        yield past, len(text)


def features(word: str) -> set[str]:
    """The word itself, and its character n-grams with borders."""
    marked = f"<{word}>"
    found = {marked}
    for n in GRAMS if len(word) <= MOST_WORD else ():
        found.update(marked[i : i + n] for i in range(len(marked) - n + 1))
    return found


def is_held_out() -> Column:
    """Of the column doc_id; a row without one is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """Rows (doc_id, text, toxic, weight): at most train_rows labelled ids of either label, none held out.

    weight makes up for the share of a label's rows that were chosen. A doc_id with several labels
    counts with its highest.
    """
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .filter(~is_held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    known = saved(known.withColumn("place", F.xxhash64("doc_id")), "labels")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = [
        known.filter(F.col("toxic") == t)
        .orderBy("place", "doc_id")
        .limit(train_rows)
        .withColumn("weight", F.lit(max(1.0, sizes.get(t, 0) / train_rows)))
        for t in (0, 1)
    ]
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # at most 2 * train_rows ids are broadcast; of rows that repeat an id the first text counts
    picked = F.broadcast(chosen[0].union(chosen[1]))
    rows = texts.filter("text IS NOT NULL").join(picked, "doc_id")
    one = rows.groupBy("doc_id", "toxic", "weight").agg(F.min("text").alias("text"))
    return saved(one, "labelled")


def chosen_features(sample: DataFrame, n: int = FEATURES) -> list[str]:
    """The features whose share of toxic documents is the most surely above that of clean ones."""
    ship(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(*batch.columns, strict=True):
                words = set(WORDS.findall(text.as_py().lower()))
                counts[toxic.as_py()].update(set().union(*map(features, words)))
                if len(counts[0]) + len(counts[1]) > HELD_FEATURES:
                    yield from out(counts)
        yield from out(counts)

    def out(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        for toxic, some in enumerate(counts):
            yield pa.record_batch(
                [
                    pa.array(list(some), pa.string()),
                    pa.array([toxic] * len(some), pa.int32()),
                    pa.array(list(some.values()), pa.int64()),
                ],
                ["feature", "toxic", "n"],
            )
            some.clear()

    found = sample.select("toxic", "text").mapInArrow(run, "feature string, toxic int, n long")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    a, b = F.col("bad") + 0.5, F.col("good") + 0.5
    c, d = bad - F.col("bad") + 0.5, good - F.col("good") + 0.5
    error = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    best = (
        found.groupBy("feature")
        .agg(
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
            F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"),
        )
        .filter(F.col("bad") + F.col("good") >= LEAST_DOCS)
        .withColumn("z", (F.log(a / c) - F.log(b / d)) / error)
        .filter((F.col("z") > LEAST_Z) & (F.col("good") <= MOST_CLEAN * good))
        .orderBy(F.col("z").desc(), "feature")
        .limit(n)
    )
    return [r["feature"] for r in best.select("feature").collect()]


class Instances:
    """Sentences of a text as sets of known features, which one automaton finds in one pass."""

    def __init__(self, known: dict[str, int]) -> None:
        self.automaton = ahocorasick.Automaton()
        for feature, i in known.items():
            self.automaton.add_word(feature, i)
        self.automaton.make_automaton()

    def _found(self, text: str) -> frozenset[int]:
        # a feature has "<" or ">" at its borders only, so none lies across two words
        marked = "<" + "><".join(WORDS.findall(text.lower())) + ">"
        return frozenset(i for _, i in self.automaton.iter(marked))

    def of_text(self, text: str) -> Iterator[tuple[int, int, frozenset[int]]]:
        """(start, end, features) of the sentences that have a known one."""
        for a, b in sentences(text):
            found = self._found(text[a:b])
            if found:
                yield a, b, found


def bags(sample: DataFrame, known: list[str]) -> DataFrame:
    """Rows (toxic, weight, sentences): a document's distinct sets of known features."""
    index = {f: i for i, f in enumerate(known)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Instances(index)
        for batch in batches:
            found = [
                sorted({tuple(sorted(fs)) for _, _, fs in reader.of_text(t.as_py())})
                for t in batch.column(2)
            ]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.list_(pa.int32())))],
                ["toxic", "weight", "sentences"],
            )

    return sample.select("toxic", "weight", "text").mapInArrow(
        run, "toxic int, weight double, sentences array<array<int>>"
    )


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def trained(rows: list[tuple[int, float, list[list[int]]]], n: int) -> tuple[np.ndarray, float, float]:
    """(weights, offset, leak) that make the documents' labels likeliest, by Adam steps.

    rows: (toxic, weight, sets of features). A document is clean if its leak and all its sentences
    are, so log(1 - p) adds up over its sentences. SHRINK pulls the weights to zero, evenly.
    """
    y = np.array([r[0] for r in rows], float)
    share = np.array([r[1] for r in rows], float)
    share /= share.sum()
    doc = np.array([i for i, r in enumerate(rows) for _ in r[2]], np.int64)
    sets = [s for r in rows for s in r[2]]
    sentence = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    feature = np.array([f for s in sets for f in s], np.int64)
    w = np.zeros(n + 2)  # features, offset, logit of the leak
    w[n], w[n + 1] = -1.0, np.log(LEAK / (1 - LEAK))
    mean, square = np.zeros(n + 2), np.zeros(n + 2)
    for step in range(1, STEPS + 1):
        z = w[n] + np.bincount(sentence, w[feature], len(sets))
        leak = _sigmoid(w[n + 1])
        clean = np.log1p(-leak) - np.bincount(doc, np.logaddexp(0, z), len(rows))  # log(1 - p)
        clean = np.minimum(clean, -1e-12)
        p = -np.expm1(clean)
        by_clean = share * np.where(y == 1, (1 - p) / p, -1.0)  # of the loss, by log(1 - p)
        by_z = -by_clean[doc] * _sigmoid(z)
        g = np.empty(n + 2)
        g[:n] = np.bincount(feature, by_z[sentence], n) + SHRINK * np.sign(w[:n])
        g[n], g[n + 1] = by_z.sum(), -by_clean.sum() * leak
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        fast, spread = mean / (1 - 0.9**step), square / (1 - 0.999**step)
        w = w - RATE * fast / (np.sqrt(spread) + 1e-8)
        w[n + 1] = min(w[n + 1], np.log(THRESHOLD / 2))  # the leak alone must not decide
    return w[:n], float(w[n]), float(_sigmoid(w[n + 1]))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most train_rows labelled documents of either label, none of them held out.

    Rows without an id, a label or a text are left out. With rows of one label only, or none, or
    if no feature tells them apart, every score is the smoothed share of label 1.
    """
    sample = training_rows(docs, labels, train_rows)
    known = chosen_features(sample)
    rows = sample.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()
    n = {r["toxic"]: float(r["n"]) for r in rows}
    if not known or len(n) < 2:
        share = (n.get(1, 0.0) + 1) / (n.get(0, 0.0) + n.get(1, 0.0) + 2)
        return Model({}, 0.0, 0.0, share)
    ship(docs.sparkSession)
    found = bags(sample, known).collect()  # at most 2 * train_rows documents, known features only
    ordered = sorted((r["toxic"], r["weight"], [list(s) for s in r["sentences"]]) for r in found)
    w, offset, leak = trained(ordered, len(known))
    return Model({f: float(x) for f, x in zip(known, w, strict=True)}, offset, leak)


class Scorer:
    """Scores of texts and of their sentences under a model."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.names = list(model.weights)
        self.w = np.array([model.weights[f] for f in self.names])
        self.reader = Instances({f: i for i, f in enumerate(self.names)})

    def __call__(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (start, end, score) of the sentences at THRESHOLD or above."""
        if self.model.constant is not None:
            return self.model.constant, []
        clean, found = np.log1p(-self.model.leak), []
        for a, b, fs in self.reader.of_text(text):
            p = float(_sigmoid(self.model.offset + self.w[sorted(fs)].sum()))
            clean += np.log1p(-min(p, 1 - 1e-15))
            if p >= THRESHOLD:
                own = text[a:b]
                found.append((b - len(own.lstrip()), a + len(own.rstrip()), p))
        return float(-np.expm1(clean)), found


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1), predicted (1 if score >= THRESHOLD, else 0) and offending added.

    offending holds (start, end, score) of the sentences that score THRESHOLD or more by
    themselves, in code points, in order. Only the text is looked at; null and empty texts get the
    leak as score and no sentences. All rows and columns stay; columns of these names are replaced.
    """
    ship(docs.sparkSession)
    rows = docs.drop("score", "predicted", "offending")
    at = rows.columns.index("text")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer(t.as_py() or "") for t in batch.column(at)]
            score = np.array([s for s, _ in found], float)
            spans = [[dict(zip(("start", "end", "score"), x, strict=True)) for x in o] for _, o in found]
            yield pa.record_batch(
                [
                    *batch.columns,
                    pa.array(score),
                    pa.array((score >= THRESHOLD).astype(np.int32)),
                    pa.array(spans, pa.list_(span)),
                ],
                [*batch.schema.names, "score", "predicted", "offending"],
            )

    added = "score double, predicted int, offending array<struct<start:long,end:long,score:double>>"
    return mapped(rows, run, with_columns(rows, added))
