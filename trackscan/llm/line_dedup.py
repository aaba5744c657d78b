"""Remove repeated lines or paragraphs: of each, the earliest occurrence in rank order stays.

A unit is a line, a paragraph, or a sentence of a line. With least_run, a repeated unit goes only
where it stands among other repeated ones: a passage of that many words in a row that have all been
seen before. So passages go even if lines are cut or joined around them, and the short lines that
many documents share by chance or by form stay. Units are normalised (lower case, single spaces) and hashed to 128 bits. Digests are counted with
a combine before the shuffle, so a line that stands in most documents is one row from each task;
the join back to its occurrences has plain shuffles on both sides, which adaptive execution
splits. Only digests, ids and positions move; each text is joined once to its own spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.llm.common import free_name, mapped, quoted, saved, ship, with_columns

SEPARATORS = {"line": re.compile("\n"), "paragraph": re.compile("\n[\x20\x09-\x0d]*\n")}
#: A sentence ends behind its marks, wherever they stand, or with its line.
SENTENCES = re.compile("[^\n.!?]+[.!?]*|[.!?]+")
LEAST_WORDS = 5
#: The order of occurrences: rows without a doc_id come last; rows of one doc_id by text hash.
RANK = ("no_id", "doc_id", "tie", "start")


def split_units(text: str, unit: str) -> list[tuple[int, int]]:
    """(start, end) of every unit in code points; separators are outside."""
    if unit == "sentence":
        return [m.span() for m in SENTENCES.finditer(text)] or [(0, len(text))]
    found, past = [], 0
    for m in SEPARATORS[unit].finditer(text):
        found.append((past, m.start()))
        past = m.end()
    return [*found, (past, len(text))]


def normalised(unit: str) -> list[bytes]:
    return unit.lower().encode().split()


def without(text: str, unit: str, removed: set[int]) -> str:
    """text without the units that start at removed; a kept unit keeps the separator behind it,
    but for the last one. Of sentences, what is between them stays."""
    if unit == "sentence":
        past, parts = 0, []
        for a, b in split_units(text, unit):
            if a in removed:
                parts.append(text[past:a])
                past = b
        return "".join([*parts, text[past:]])
    kept = [(a, b) for a, b in split_units(text, unit) if a not in removed]
    ends = {m.start(): m.end() for m in SEPARATORS[unit].finditer(text)}
    parts = [text[a : ends.get(b, b)] for a, b in kept[:-1]]
    return "".join([*parts, *(text[a:b] for a, b in kept[-1:])])


def in_runs(text: str, unit: str, repeated: set[int], least_run: int) -> set[int]:
    """Those of the repeated units that stand in a run of at least least_run words.

    A run is repeated units one after the other; units without words neither count nor end it.
    """
    kept: set[int] = set()
    run: list[int] = []
    words = 0
    for a, b in [*split_units(text, unit), (-1, -1)]:
        if a >= 0 and a not in repeated:
            if not text[a:b].strip():
                continue
            a = -1
        if a < 0:
            if words >= least_run:
                kept.update(run)
            run, words = [], 0
        else:
            run.append(a)
            words += len(normalised(text[a:b]))
    return kept


def _key(rows: DataFrame) -> list[Column]:
    doc_id = F.col("doc_id").cast("long")
    return [
        doc_id.isNull().alias("no_id"),
        F.coalesce(doc_id, F.lit(0)).alias("doc_id"),
        F.xxhash64("text").alias("tie"),
    ]


def units(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows (no_id, doc_id, tie, start, end, digest) of the units of least_words words or more."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, starts, ends, digests = [], [], [], []
            for i, text in enumerate(batch.column(3)):
                whole = text.as_py()
                for a, b in split_units(whole, unit):
                    words = normalised(whole[a:b])
                    if len(words) >= least_words:
                        row.append(i)
                        starts.append(a)
                        ends.append(b)
                        digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            at = pa.array(row, pa.int64())
            yield pa.record_batch(
                [
                    *(batch.column(k).take(at) for k in range(3)),
                    pa.array(starts, pa.int64()),
                    pa.array(ends, pa.int64()),
                    pa.array(digests, pa.binary()),
                ],
                ["no_id", "doc_id", "tie", "start", "end", "digest"],
            )

    rows = docs.filter("text IS NOT NULL").select(*_key(docs), F.col("text").cast("string"))
    return rows.mapInArrow(
        run, "no_id boolean, doc_id long, tie long, start long, end long, digest binary"
    )


def repeats(found: DataFrame) -> DataFrame:
    """The rows of units() that are not the earliest of their digest.

    The firsts are dealt out by an expression of the digest: adaptive execution can split a hot
    digest between two plain shuffles, but not where an aggregate has dealt one side out.
    """
    first = (
        found.groupBy("digest")
        .agg(F.min(F.struct(*RANK)).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.concat("digest", F.lit(bytearray())).alias("digest"), "first")
    )
    return found.join(first, "digest").filter(F.struct(*RANK) != F.col("first"))


def deduplicated(
    docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS, least_run: int = 0
) -> DataFrame:
    """docs with n_units and removed added, and removed units taken out of text.

    removed holds (start, end) of each in the original text, in code points, in order. Units of
    fewer than least_words words are left alone, and with least_run also repeated units that don't
    stand in a run of so many repeated words. Rows that are equal in doc_id and text are one
    document and are treated alike. Null texts stay null with no units; empty texts have one unit.
    Other columns stay; columns named n_units or removed are replaced.
    """
    rows = docs.drop("n_units", "removed")
    keys = [free_name(rows.columns, n) for n in ("no_id", "own_id", "tie")]
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))  # equal rows give equal spans
    gone = (
        repeats(saved(units(rows, unit, least_words), "units"))
        .groupBy("no_id", "doc_id", "tie")
        .agg(spans.alias("removed"))
        .select(
            *(F.col(c).alias(k) for c, k in zip(("no_id", "doc_id", "tie"), keys, strict=True)),
            "removed",
        )
    )
    keyed = rows.select("*", *(c.alias(k) for c, k in zip(_key(rows), keys, strict=True)))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    joined = keyed.join(gone, keys, "left").select(
        *map(quoted, rows.columns), F.coalesce("removed", none).alias("removed")
    )
    at = rows.columns.index("text")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [*batch.schema.names, "n_units"]
            new, counts, removed = [], [], []
            for text, cut in zip(batch.column(at), batch.column(len(names) - 2), strict=True):
                whole, spans = text.as_py(), cut.as_py()
                counts.append(0 if whole is None else len(split_units(whole, unit)))
                starts = {s["start"] for s in spans}
                if starts and least_run:
                    starts = in_runs(whole, unit, starts, least_run)
                    spans = [s for s in spans if s["start"] in starts]
                removed.append(spans)
                new.append(without(whole, unit, starts) if starts else whole)
            columns = [*batch.columns[:-1], pa.array(removed, span), pa.array(counts, pa.int64())]
            columns[at] = pa.array(new, pa.string())
            yield pa.record_batch(columns, names)

    return mapped(joined, run, with_columns(joined, "n_units long"))
