"""Folders of stored tables, on any file system that Spark knows."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, sorted; none if there is no such folder."""
    fs, folder = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, folder = _path(spark, path)
    fs.delete(folder, True)


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already. Of two callers one gets True."""
    fs, file = _path(spark, path)
    fs.mkdirs(file.getParent())
    try:
        return fs.createNewFile(file)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            return False
        raise


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a folder to a name that is free; its parent is made."""
    fs, folder = _path(spark, path)
    target = _path(spark, to)[1]
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(folder, target):
        raise FileExistsError(f"{path} can't become {to}")
