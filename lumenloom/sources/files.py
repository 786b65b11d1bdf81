"""Small files through Hadoop's file system, so that any store Spark can reach will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    fs, target = _open(spark, path)
    return fs.exists(target)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    fs, target = _open(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, target = _open(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a new small file that appears as a whole or not at all; an existing one is replaced."""
    fs, target = _open(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"{path} could not be put in place")


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or a folder with all in it, if it is there."""
    fs, target = _open(spark, path)
    if fs.exists(target):
        fs.delete(target, True)
