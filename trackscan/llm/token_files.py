"""Token-id files: documents in id order, ids in patched frame-of-reference blocks.

A file is what one task of the range sort held, cut after about FILE_TOKENS ids. Spark writes it
as a text file, so its committer and file systems apply, and reads it as a binary file. Its lines are
up to SECTIONS sections, so that no task has to hold a whole file, and empty lines. A section:

    magic 8 bytes | documents u64 | ids u64 | blocks u64 | length of the block data u64
    | document keys i64 each | has-a-key u8 each | ids of each document u32 | block starts u64 each
    | block data
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackscan.llm import frames
from trackscan.llm.common import new_folder, rows_per_batch, saved, ship
from trackscan.llm.tokens import encoder, grouped

MAGIC = b"PFORIDS1"
FILE_TOKENS, SECTIONS, BATCH_TEXTS = 6_000_000, 8, 256
END_ID = 0
_HEAD = len(MAGIC) + 32
_NUMBERS = re.compile(r"part-(\d+)-[^/]*-c(\d+)\.txt$").search


def write(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = END_ID,
    file_tokens: int = FILE_TOKENS,
) -> None:
    """Write the ids of every text of docs (doc_id, text), each followed by end_id, below path.

    A null text counts as empty. Documents are in ascending doc_id order over and within files;
    rows without a doc_id come first, and rows of one doc_id are in the order of their texts'
    hashes, so that many rows of one doc_id are spread too. A document is never cut: one with more than file_tokens ids is a file of its own. Other columns are ignored.

    Files are few because each that an executor writes to a local folder starts a ``chmod``, and
    such a child shows the memory of the whole JVM a second time until it runs.
    """
    ship(docs.sparkSession)

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int]]:
        encode = encoder(vocabulary).many
        end = np.array([end_id], "<u4").tobytes()
        keys: list[int | None] = []
        ids: list[bytes] = []
        size = 0
        for part in grouped(batches):
            for key, found in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                if size and size + len(found) > 4 * file_tokens // SECTIONS:
                    yield assemble(keys, ids), size // 4
                    keys, ids, size = [], [], 0
                keys.append(key)
                ids.append(found + end)
                size += len(found) + 4
        if keys:
            yield assemble(keys, ids), size // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(_one, lines_of_files(sections(batches), file_tokens))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(parts, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
    )
    files = ordered.mapInArrow(run, "content binary")
    lines = files.select(F.col("content").cast("string").alias("value"))
    with rows_per_batch(docs.sparkSession, BATCH_TEXTS):
        lines.write.option("maxRecordsPerFile", SECTIONS).text(path)


def _one(content: bytes) -> pa.RecordBatch:
    return pa.record_batch([pa.array([content], pa.binary())], ["content"])


def lines_of_files(sections: Iterable[tuple[bytes, int]], file_tokens: int) -> Iterator[bytes]:
    """The sections, which come with their numbers of ids, as lines of files with SECTIONS lines.

    Empty lines fill up a file that the next section would take above file_tokens ids.
    """
    lines = held = 0
    for section, ids in sections:
        if lines and held + ids > file_tokens:
            yield from [b""] * (SECTIONS - lines)
            lines = held = 0
        yield section
        lines, held = (lines + 1, held + ids) if lines + 1 < SECTIONS else (0, 0)


def assemble(keys: list[int | None], ids: list[bytes]) -> bytes:
    """One section's bytes from the documents' keys and ids (little-endian u32)."""
    sizes = np.array([len(x) // 4 for x in ids], "<u4")
    data, starts = frames.pack(np.frombuffer(b"".join(ids), "<u4"))
    head = np.array([len(keys), sizes.sum(dtype=np.int64), len(starts) - 1, len(data)], "<u8")
    return b"".join(
        (
            MAGIC,
            head.tobytes(),
            np.array([x or 0 for x in keys], "<i8").tobytes(),
            np.array([x is not None for x in keys], np.uint8).tobytes(),
            sizes.tobytes(),
            starts[:-1].astype("<u8").tobytes(),
            data,
        )
    )


class TokenFile:
    """Reads documents of the section that content begins with; block starts lead to any document
    without reading the rest."""

    def __init__(self, content: bytes | memoryview) -> None:
        if content[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token-id file")
        self.documents, self.ids, blocks, size = (
            int(x) for x in np.frombuffer(content, "<u8", 4, len(MAGIC))
        )
        at = _HEAD
        self.keys = np.frombuffer(content, "<i8", self.documents, at)
        at += 8 * self.documents
        self.has_key = np.frombuffer(content, np.uint8, self.documents, at) > 0
        at += self.documents
        self.sizes = np.frombuffer(content, "<u4", self.documents, at).astype(np.int64)
        at += 4 * self.documents
        starts = np.frombuffer(content, "<u8", blocks, at).astype(np.int64)
        at += 8 * blocks
        self.starts = np.append(starts, size)
        self.data = memoryview(content)[at : at + size]
        self.length = at + size
        self.first = np.cumsum(self.sizes) - self.sizes

    def document(self, i: int) -> np.ndarray:
        first = int(self.first[i])
        a, b = first // frames.BLOCK, -(-(first + int(self.sizes[i])) // frames.BLOCK)
        some = frames.unpack(self.data, self.starts[a : b + 1], (b - a) * frames.BLOCK)
        return some[first - a * frames.BLOCK :][: int(self.sizes[i])]

    def all_ids(self) -> np.ndarray:
        return frames.unpack(self.data, self.starts, self.ids)


def sections_of(content: bytes) -> Iterator[TokenFile]:
    """The sections of a file's lines."""
    rest = memoryview(content)
    while rest:
        if rest[0] == ord("\n"):
            rest = rest[1:]
            continue
        section = TokenFile(rest)
        yield section
        rest = rest[section.length :]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, task, part), one for each document at path.

    start counts the ids of all documents before it, over all files. Files are ordered by the
    numbers in their names: the task of the range sort, and the task's part.
    """
    ship(spark)
    schema = "doc_id long, first long, n_tokens long, ids_crc32 long, task long, part long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number = [int(x) for x in _NUMBERS(batch.column(0)[i].as_py()).groups()]
                base = 0
                for some in sections_of(batch.column(1)[i].as_py()):
                    ids = np.asarray(some.all_ids(), "<u4")
                    crc = [
                        zlib.crc32(ids[a : a + n])
                        for a, n in zip(some.first.tolist(), some.sizes.tolist(), strict=True)
                    ]
                    keys = pa.array(some.keys, mask=~some.has_key)
                    columns = [keys, base + some.first, some.sizes, crc]
                    columns += [np.full(some.documents, x) for x in number]
                    yield pa.record_batch(
                        [pa.array(x, pa.int64()) for x in columns],
                        ["doc_id", "first", "n_tokens", "ids_crc32", "task", "part"],
                    )
                    base += some.ids

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    # just as they are read: an expression beside them would copy the contents
    index = files.select("path", "content").mapInArrow(run, schema)
    # small rows: not a file for each task
    found = saved(index.hint("rebalance"), "token-index")
    heads = found.groupBy("task", "part").agg(F.sum("n_tokens").alias("ids"))
    # one row for each file, so a single task holds them all
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = heads.select(
        "task", "part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")
    )
    return found.join(offsets, ["task", "part"]).select(
        "doc_id",
        (F.col("base") + F.col("first")).alias("start"),
        "n_tokens",
        "ids_crc32",
        "task",
        "part",
    )


def round_trip(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write docs to token-id files in the shared folder and read them back."""
    path = new_folder(docs.sparkSession, "token-ids")
    write(docs, path, vocabulary, **options)
    return read(docs.sparkSession, path)
