"""What the operators share: tables, the shared folder, and the package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per application.

    Modules imported there keep their state (a loaded tokenizer, a memo) between the tasks of a
    Python worker; functions pickled by value would not.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="trackscan-")) / f"trackscan_{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster gets an error, since a
    folder of one machine would lose data there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="trackscan-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and readable after an executor is lost.

    name: of a new folder there; or the path of one, so that it can be discarded later.
    """
    path = name if "/" in name else new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def with_columns(df: DataFrame, added: str) -> StructType:
    """The schema of df, whatever its columns are called, with more columns from a DDL string."""
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])


def quoted(name: str) -> str:
    """A column's name as it is written in an expression, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def free_name(columns: list[str], name: str) -> str:
    """name, or a longer one that no column has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def mapped(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any name, also those that Spark can't look up.

    run sees columns c0, c1 and so on, and its columns count by their order.
    """
    inside = StructType.fromDDL(
        ", ".join(f"r{i} {f.dataType.simpleString()}" for i, f in enumerate(schema.fields))
    )

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, inside.names)

    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(renamed, inside).toDF(*schema.names)


@contextmanager
def rows_per_batch(spark: SparkSession, n: int):
    """Within it, Python gets n rows at a time of what is run: for rows of hundreds of kilobytes,
    of which Spark's own number would fill an executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)
