"""Quality scores by compression: how much better a good-text dictionary fits than a bad-text one.

Two Zstandard dictionaries are trained, on pieces of labelled good and of labelled bad texts. A
text is cut into pieces and compressed with either; the difference of the sizes over the text's
own size, beside the mean compressed size, is calibrated into a probability by logistic
regression on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.llm.common import mapped, saved, ship, with_columns

#: Labelled rows of either label that are learned from, chosen by a hash of their id.
TRAIN_ROWS = 4_000
#: Bytes of a piece, of a dictionary, and pieces of one labelled text that train a dictionary.
PIECE, DICTIONARY, TRAIN_PIECES, LEVEL = 1024, 65536, 16, 3
THRESHOLD = 0.3
RIDGE, NEWTON_STEPS = 1e-2, 50


@dataclass(frozen=True)
class Model:
    """Plain values, so that it is the same on every executor."""

    good: bytes
    bad: bytes
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    constant: float | None = None


def pieces(text: str) -> list[bytes]:
    data = text.encode()
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


class Measure:
    """Features of a text under a model's two dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.by_good, self.by_bad = self._compressor(good), self._compressor(bad)

    @staticmethod
    def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(
            level=LEVEL,
            dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        )

    def __call__(self, text: str) -> tuple[float, ...]:
        """Relative to the text's bytes: size difference, mean size, their product; and the
        difference relative to both sizes. All zero for an empty text."""
        parts = pieces(text)
        if not parts:
            return (0.0, 0.0, 0.0, 0.0)
        good = sum(len(self.by_good.compress(p)) for p in parts)
        bad = sum(len(self.by_bad.compress(p)) for p in parts)
        n = PIECE * (len(parts) - 1) + len(parts[-1])
        apart, mean = (bad - good) / n, (bad + good) / 2 / n
        return (apart, mean, apart * mean, (bad - good) / (bad + good))


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too little text to train on is a dictionary as it stands."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method with a small ridge."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(NEWTON_STEPS):
        p = _sigmoid(a @ w)
        curve = (a * (p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(len(w))
        move = np.linalg.solve(curve, a.T @ (p - y) + RIDGE * w)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def is_held_out() -> Column:
    """Of the column doc_id; a row without one is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most train_rows labelled documents of either label, none of them held out.

    A doc_id with several labels counts with its lowest; rows without an id, a label or a text are
    left out. Half of the rows train the dictionaries, the other half the calibration. With rows
    of one label only, or none, every score is the smoothed share of label 1.
    """
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
        .filter("doc_id IS NOT NULL AND quality IN (0, 1)")
        .filter(~is_held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .withColumn("place", F.xxhash64("doc_id"))
    )
    chosen = [
        known.filter(F.col("quality") == q).orderBy("place", "doc_id").limit(train_rows)
        for q in (0, 1)
    ]
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # at most 2 * train_rows ids are broadcast
    sample = saved(
        texts.filter("text IS NOT NULL").join(
            F.broadcast(chosen[0].union(chosen[1])), "doc_id", "left_semi"
        ),
        "labelled",
    ).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    half = F.pmod(F.shiftright("place", 20), F.lit(2)) == 0
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for quality, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = pieces(text)
                some = parts[:: max(1, -(-len(parts) // TRAIN_PIECES))]
                yield pa.record_batch(
                    [pa.array([quality] * len(some), pa.int32()), pa.array(some, pa.binary())],
                    ["quality", "piece"],
                )

    got = (
        sample.filter(half).select("quality", "text").mapInArrow(cut, "quality int, piece binary")
    ).collect()
    by_label = [sorted(bytes(r["piece"]) for r in got if r["quality"] == q) for q in (0, 1)]
    bad, good = (dictionary(x) if x else b"" for x in by_label)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(good, bad)
        for batch in batches:
            found = np.array([measure(t) for t in batch.column(1).to_pylist()]).reshape(-1, 4)
            yield pa.record_batch(
                [batch.column(0), *map(pa.array, found.T)], ["quality", "a", "b", "c", "d"]
            )

    rows = np.array(
        sample.filter(~half)
        .select("quality", "text")
        .mapInArrow(measured, "quality int, a double, b double, c double, d double")
        .collect(),
        float,
    ).reshape(-1, 5)
    rows = rows[np.lexsort(rows.T)]
    y, x = rows[:, 0], rows[:, 1:]
    if not (good and bad and 0 < y.sum() < len(y)):
        seen = [len(v) for v in by_label]
        share = (y.sum() + (seen[1] > 0) + 1) / (len(y) + (seen[0] > 0) + (seen[1] > 0) + 2)
        return Model(b"", b"", (), (), (), float(share))
    means, scales = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    weights = logistic((x - means) / scales, y)
    return Model(good, bad, tuple(means), tuple(scales), tuple(weights))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= THRESHOLD, else 0) added.

    Only the text is looked at; null and empty texts get the score of an empty one. All rows and
    columns stay; columns named score or predicted are replaced.
    """
    ship(docs.sparkSession)
    rows = docs.drop("score", "predicted")
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(model.good, model.bad)
        for batch in batches:
            if model.constant is None:
                found = np.array([measure(t.as_py() or "") for t in batch.column(at)])
                x = (found.reshape(-1, 4) - model.means) / np.array(model.scales)
                score = _sigmoid(x @ np.array(model.weights[:-1]) + model.weights[-1])
            else:
                score = np.full(batch.num_rows, model.constant)
            predicted = (score >= THRESHOLD).astype(np.int32)
            yield pa.record_batch(
                [*batch.columns, pa.array(score), pa.array(predicted)],
                [*batch.schema.names, "score", "predicted"],
            )

    return mapped(rows, run, with_columns(rows, "score double, predicted int"))
