"""Ranked lexical search with integer scores, by a length-stratified index.

Documents with the same normaliser m form a stratum. The index is a table with a row for each
stratum of each part of the corpus: its documents, and its postings by term and, within a term, by
falling tf. In a stratum a term's impact depends on tf alone, so it is computed once for each tf,
and the impact of the first tf bounds what the term can add there. A search adds up these bounds
for each stratum, visits strata from the highest bound on, and stops where the bound is below the
k-th score it has.

The index is built and searched where its rows are: no postings are shuffled. Queries go through
in blocks of a bounded number of terms, and each task returns k documents for each of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackscan.llm.common import discard, new_folder, rows_per_batch, saved, ship

#: Postings of one part of the index; a task holds two parts at a time, or one larger row.
PART_POSTINGS = 1 << 18
#: Terms of a block of queries. A block goes to every task, so its size is checked.
BLOCK_TERMS = 1 << 18
#: Strata, and texts or their terms, that a task is handed at a time.
BATCH_ROWS, BATCH_TEXTS = 64, 256
#: Of a term's weight, an impact and the normaliser of documents.
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, M_SCALE = 1_000, 1_000_000_000, 1_000, 12
M_BASE, M_SHARE = 100, 25

#: Letters, digits and all beyond ASCII make terms; A-Z counts as a-z; all else stands between.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in order; both are UTF-8."""
    return (text or b"").translate(_FOLD).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (IMPACT_SCALE * tf) // (TF_SCALE * tf + M_SCALE * m)


@dataclass(frozen=True)
class Index:
    """strata: the table; docs: documents with a term; length: terms of all with repeats."""

    strata: DataFrame
    docs: int
    length: int


def counted(docs: DataFrame, keep: str) -> DataFrame:
    """Rows (keep, n, terms, tfs) of the rows with a term; a row's terms are distinct, joined by a
    space, and tfs are their counts as 64-bit integers."""
    ship(docs.sparkSession)
    rows = _texts(docs, keep)
    kind = rows.schema[keep].dataType.simpleString()
    return rows.mapInArrow(
        lambda batches: _counted(batches, keep), f"{keep} {kind}, n long, terms binary, tfs binary"
    )


def _texts(docs: DataFrame, keep: str) -> DataFrame:
    return docs.select(F.col(keep), F.col("text").cast("string").alias("text"))


def _counted(batches: Iterator[pa.RecordBatch], keep: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, n, words, tfs = [], [], [], []
        held = 0

        def out(at=at, n=n, words=words, tfs=tfs, batch=batch) -> pa.RecordBatch:
            cells = [
                batch.column(0).take(pa.array(at, pa.int64())),
                pa.array(n, pa.int64()),
                pa.array(words, pa.binary()),
                pa.array(tfs, pa.binary()),
            ]
            for x in (at, n, words, tfs):
                x.clear()
            return pa.record_batch(cells, [keep, "n", "terms", "tfs"])

        for i, text in enumerate(batch.column(1).cast(pa.binary())):
            found = terms(text.as_py())
            if not found:
                continue
            count = Counter(found)
            at.append(i)
            n.append(len(found))
            words.append(b" ".join(count))
            tfs.append(np.fromiter(count.values(), np.int64, len(count)).tobytes())
            held += len(count)
            if held >= PART_POSTINGS:
                yield out()
                held = 0
        yield out()


STRATUM = (
    "m long, docs array<long>, terms string, counts array<int>, "
    "runs binary, tfs binary, sizes binary, at binary"
)


def build(docs: DataFrame) -> Index:
    """The index of all rows of docs (doc_id, text) that have a term.

    Null and empty texts, and texts without a letter or digit, are not in it. Every row counts as
    a document of its own, also where a doc_id repeats or is null. Other columns are ignored.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = new_folder(spark, "forward")
    with rows_per_batch(spark, BATCH_TEXTS):
        forward = saved(counted(ids, "doc_id"), folder)
    row = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, length = int(row[0]), int(row[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        n: list[int] = []
        words: list[bytes] = []
        tfs: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc, size, some, tf in zip(*(c for c in batch.columns), strict=True):
                counts = np.frombuffer(tf.as_py(), np.int64)
                ids.append(doc.as_py())
                n.append(size.as_py())
                words += some.as_py().split(b" ")
                tfs.append(counts)
                held += len(counts)
                if held >= PART_POSTINGS:
                    yield strata(ids, n, words, tfs, n_docs, length)
                    ids, n, words, tfs, held = [], [], [], [], 0
        if ids:
            yield strata(ids, n, words, tfs, n_docs, length)

    with rows_per_batch(spark, BATCH_TEXTS):
        made = saved(forward.mapInArrow(run, STRATUM), "strata")
    discard(spark, folder)
    return Index(made, n_docs, length)


def _lists(values: pa.Array, stratum: np.ndarray, n: int) -> pa.ListArray:
    """values, which lie in the order of their strata, as a list for each of n strata."""
    ends = np.searchsorted(stratum, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _joined(words: pa.Array, stratum: np.ndarray, n: int) -> pa.Array:
    """Words, which hold no space, as one text for each of n strata."""
    ends = np.searchsorted(stratum, np.arange(n + 1))
    listed = words.to_pylist()
    return pa.array([" ".join(listed[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.string())


def _blobs(values: np.ndarray, stratum: np.ndarray, n: int) -> pa.Array:
    ends = np.searchsorted(stratum, np.arange(n + 1))
    return pa.array([values[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())


def strata(ids, n, words, tfs, n_docs: int, length: int) -> pa.RecordBatch:
    """The strata of one part, from its documents' ids, sizes, distinct terms and their counts."""
    m = M_BASE - M_SHARE + (M_SHARE * np.array(n, np.int64) * n_docs) // length
    order = np.argsort(m, kind="stable")
    values, of_doc = np.unique(m[order], return_inverse=True)
    place = np.empty(len(m), np.int64)  # of a document among all, by stratum
    place[order] = np.arange(len(m))
    first = np.searchsorted(of_doc, np.arange(len(values)))

    coded = pa.array(words, pa.binary()).cast(pa.string()).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    tf = np.concatenate(tfs)
    doc = np.repeat(place, [len(x) for x in tfs])
    by = np.lexsort((doc, -tf, code, of_doc[doc]))
    code, tf, doc = code[by], tf[by], doc[by]
    s = of_doc[doc]
    new_term = np.concatenate(([True], (s[1:] != s[:-1]) | (code[1:] != code[:-1])))
    new_run = new_term | np.concatenate(([True], tf[1:] != tf[:-1]))
    term_at, run_at = np.flatnonzero(new_term), np.flatnonzero(new_run)
    k = len(values)
    first_term = np.searchsorted(s[term_at], np.arange(k))
    run_term = (np.cumsum(new_term) - 1)[run_at] - first_term[s[run_at]]
    cells = [
        pa.array(values),
        _lists(pa.array(ids, pa.int64()).take(pa.array(order)), of_doc, k),
        _joined(coded.dictionary.take(pa.array(code[term_at])), s[term_at], k),
        _lists(pa.array(np.diff(np.append(term_at, len(code))).astype(np.int32)), s[term_at], k),
        _blobs(run_term.astype(np.int32), s[run_at], k),
        _blobs(tf[run_at], s[run_at], k),
        _blobs(np.diff(np.append(run_at, len(code))).astype(np.int32), s[run_at], k),
        _blobs((doc - first[s]).astype(np.int32), s, k),
    ]
    return pa.record_batch(cells, ["m", "docs", "terms", "counts", "runs", "tfs", "sizes", "at"])


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + n[0] - 1, first[1] .. and so on."""
    return np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


class Strata:
    """Some rows of the index, with the terms of a block of queries only."""

    def __init__(self, rows: pa.RecordBatch, vocabulary: pa.Array) -> None:
        m = rows.column(0).to_numpy()
        docs = rows.column(1)
        words = [x.as_py().split(b" ") for x in rows.column(2).cast(pa.binary())]
        self.ids = docs.flatten()
        self.key = self.ids.fill_null(np.iinfo(np.int64).max).to_numpy()  # ids by order, null last
        sizes = docs.value_lengths().to_numpy()
        self.n, self.width = len(m), max(1, len(vocabulary))
        base = np.concatenate(([0], np.cumsum(sizes)))
        word_base = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        flat = pa.array([w for some in words for w in some], pa.binary())
        known = pc.index_in(flat, value_set=vocabulary).fill_null(-1).to_numpy()

        def blob(column: int, kind) -> tuple[np.ndarray, np.ndarray]:
            parts = [np.frombuffer(x.as_py(), kind) for x in rows.column(column)]
            return np.concatenate(parts or [np.zeros(0, kind)]), np.array([len(p) for p in parts], np.int64)

        run, runs = blob(4, np.int32)
        tf, size, (at, ats) = blob(5, np.int64)[0], blob(6, np.int32)[0].astype(np.int64), blob(7, np.int32)
        s = np.repeat(np.arange(self.n), runs)
        code = known[word_base[s] + run].astype(np.int64)
        start = np.cumsum(size) - size
        mine = np.flatnonzero(code >= 0)
        key = s[mine] * self.width + code[mine]
        order = np.argsort(key, kind="stable")  # falling tf within a stratum's term stays
        mine, self.run_key = mine[order], key[order]
        self.start, self.size = start[mine], size[mine]
        self.impact = impact(tf[mine], m[s[mine]])
        self.at = at + np.repeat(base[:-1], ats)
        top = np.flatnonzero(np.concatenate(([True], self.run_key[1:] != self.run_key[:-1]))[: len(mine)])
        code, s = self.run_key[top] % self.width, self.run_key[top] // self.width
        order = np.argsort(code, kind="stable")
        self.top_code, self.top_s, self.top = code[order], s[order], self.impact[top][order]
        self.total = np.zeros(len(self.key), np.int64)

    def bounds(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each stratum no less than the score of any document in it."""
        first = np.searchsorted(self.top_code, codes)
        n = np.searchsorted(self.top_code, codes, "right") - first
        at = _ranges(first, n)
        bound = np.zeros(self.n, np.int64)
        np.add.at(bound, self.top_s[at], self.top[at] * np.repeat(weights, n))
        return bound

    def search(self, codes, weights, k: int, best: Best) -> Best:
        """best, with what these strata hold for a query; visits only what can be among the k."""
        bound = self.bounds(codes, weights)
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound)]
        done, step = 0, 1
        while done < len(order):
            some = order[done : done + step]
            some = some[bound[some] >= best.least(k)]  # an equal score may have a smaller id
            if not len(some):
                break
            keys = (some[:, None] * self.width + codes[None, :]).ravel()
            first = np.searchsorted(self.run_key, keys)
            n = np.searchsorted(self.run_key, keys, "right") - first
            run = _ranges(first, n)
            value = self.impact[run] * np.repeat(np.tile(weights, len(some)), n)
            doc = self.at[_ranges(self.start[run], self.size[run])]
            np.add.at(self.total, doc, np.repeat(value, self.size[run]))
            doc = np.unique(doc)
            score = self.total[doc]
            self.total[doc] = 0
            good = score >= best.least(k)
            best = best.with_more(score[good], self.key[doc[good]], self.ids.take(pa.array(doc[good])), k)
            done, step = done + step, 2 * step
        return best


@dataclass(frozen=True)
class Best:
    """The best documents of a query so far."""

    score: np.ndarray
    key: np.ndarray
    ids: pa.Array

    @classmethod
    def none(cls) -> Best:
        return cls(np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.int64()))

    def least(self, k: int) -> int:
        """A score that a document has to reach."""
        return max(1, int(self.score[k - 1])) if len(self.score) >= k else 1

    def with_more(self, score, key, ids, k: int) -> Best:
        score, key = np.append(self.score, score), np.append(self.key, key)
        at = np.lexsort((key, -score))[:k]
        both = pa.concat_arrays([self.ids, *(ids.chunks if isinstance(ids, pa.ChunkedArray) else [ids])])
        return Best(score[at], key[at], both.take(pa.array(at)))


def weighted(index: Index, queries: DataFrame) -> DataFrame:
    """Rows (item_id, text, term, weight): a query's terms that the corpus has, with what one unit
    of impact adds to the score; text is a digest that tells queries of one id apart."""
    asked = queries.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).distinct()
    key = F.struct("item_id", F.md5("text").alias("text")).alias("query")
    spark = queries.sparkSession
    ship(spark)

    # both steps in one function: a second Python worker for each task would stay with its executor
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _counted(batches, "query"):
            for i in range(batch.num_rows):
                words = batch.column(2)[i].as_py().split(b" ")
                n = np.frombuffer(batch.column(3)[i].as_py(), np.int64)
                query = batch.column(0).take(pa.array([i] * len(words)))
                yield pa.record_batch(
                    [query, pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)],
                    ["query", "term", "n"],
                )

    schema = "query struct<item_id:long,text:string>, term string, n long"
    with rows_per_batch(spark, BATCH_TEXTS):
        mine = saved(_texts(asked.select(key, "text"), "query").mapInArrow(run, schema), "query-terms")
    zipped = F.arrays_zip(F.split("terms", " ").alias("terms"), "counts")
    listed = index.strata.select(F.explode(zipped).alias("x"))
    # the terms of queries are few beside those of documents; Spark broadcasts them if they are small
    held = listed.select(F.col("x.terms").alias("term"), F.col("x.counts").alias("docs"))
    df = (
        held.join(mine.select("term").distinct(), "term")
        .groupBy("term")
        .agg(F.sum("docs").alias("df"))
    )
    ratio = F.lit(float(2 * index.docs + 2)) / (2 * F.col("df") + 1).cast("double")
    weight = F.floor(WEIGHT_SCALE * F.log(ratio)).cast("long") * F.col("n")
    found = mine.join(df, "term").select("query.*", "term", weight.alias("weight")).filter("weight > 0")
    # few rows don't make a file for each partition
    return found.repartition(max(1, -(-mine.count() // BLOCK_TERMS)))


def _in_blocks(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with a column block, where a block has BLOCK_TERMS terms or a single query."""
    by_query = rows.groupBy("item_id", "text").count()
    blocks = max(1, -(-rows.count() // BLOCK_TERMS))
    while True:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
        sizes = by_query.groupBy(block.alias("block")).agg(F.sum("count").alias("n"), F.count("*").alias("q"))
        if not sizes.filter((F.col("n") > 2 * BLOCK_TERMS) & (F.col("q") > 1)).limit(1).count():
            return rows.withColumn("block", block), blocks
        blocks *= 2


def search(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): for each query the k documents with the highest scores.

    queries has (item_id, text). Only scores above 0 count, so there may be fewer than k; equal
    scores go by ascending doc_id, a null one last. Equal rows of queries are one query; an item_id
    with several texts has results for each. Queries without a known term have none.
    """
    spark = queries.sparkSession
    rows, blocks = _in_blocks(saved(weighted(index, queries), "weights"))
    found = []
    with rows_per_batch(spark, BATCH_ROWS):
        for b in range(blocks):
            found.append(saved(_searched(index, rows.filter(F.col("block") == b), k), "found"))
    best = Window.partitionBy("item_id", "text").orderBy(
        F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    )
    ship(spark)
    return (
        reduce(DataFrame.union, found)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )


def _searched(index: Index, block: DataFrame, k: int) -> DataFrame:
    """Rows (item_id, text, doc_id, score), k from every task, for a block of queries."""
    asked = block.select("item_id", "text", "term", "weight").orderBy("item_id", "text", "term").collect()
    known = sorted({r["term"] for r in asked})
    vocabulary = pa.array([t.encode() for t in known], pa.binary())
    code = {t: i for i, t in enumerate(known)}
    queries: dict[tuple, list[tuple[int, int]]] = {}
    for r in asked:
        queries.setdefault((r["item_id"], r["text"]), []).append((code[r["term"]], r["weight"]))
    names = list(queries)
    parts = [np.array(sorted(x), np.int64).T for x in queries.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best.none() for _ in parts]
        for batch in batches:
            postings = np.cumsum(pc.binary_length(batch.column(7)).to_numpy()) // 4
            cuts = np.unique(postings // (2 * PART_POSTINGS), return_index=True)[1]
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=False):
                some = Strata(batch.slice(a, b - a), vocabulary)
                best = [some.search(c, w, k, x) for (c, w), x in zip(parts, best, strict=True)]
        n = [len(b.score) for b in best]
        if sum(n):
            owner = np.repeat(np.arange(len(n)), n)
            yield pa.record_batch(
                [
                    pa.array([names[i][0] for i in owner], pa.int64()),
                    pa.array([names[i][1] for i in owner], pa.string()),
                    pa.concat_arrays([b.ids for b in best]),
                    pa.array(np.concatenate([b.score for b in best])),
                ],
                ["item_id", "text", "doc_id", "score"],
            )

    return index.strata.mapInArrow(run, "item_id long, text string, doc_id long, score long")
