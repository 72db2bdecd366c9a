"""Small files and folders in any file system that Spark reaches, by Hadoop paths."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    where, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, over what was there."""
    where, fs = _at(spark, path)
    fs.mkdirs(where.getParent())
    stream = fs.create(where, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """A new small file that is there whole or not at all; false if there is one already."""
    where, fs = _at(spark, path)
    if fs.exists(where):
        return False
    half = f"{path}.{spark.sparkContext._jvm.java.util.UUID.randomUUID()}.half"
    write_text(spark, half, text)
    source, _ = _at(spark, half)
    if fs.exists(where) or not fs.rename(source, where):
        fs.delete(source, False)
        return False
    return True


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)
