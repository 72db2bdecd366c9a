"""Scratch tables in the folder that the cluster shares.

Long jobs cut their lineage with Parquet tables under ``spark.checkpoint.dir``;
the setting is read from the session and only set here (to a local temporary
folder, as in tests) where it is missing.  Tables live in one folder per
session, removed when the driver ends.  The shuffle files of a job that wrote
such a table are removed as soon as it is written: nothing reads them again.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
_tag: list[str] = []
_tagged: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a URI or path that Spark can write to."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="factorloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{at.rstrip('/')}/factorloom-{app}"
        atexit.register(_forget, spark, app)
    return _roots[app]


def _forget(spark: SparkSession, app: str) -> None:
    try:
        remove(spark, _roots[app])
    except Exception:  # the session may be gone already
        pass


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _tag:
        _tagged.setdefault(_tag[-1], []).append(path)
    return path


@contextmanager
def tagged(tag: str) -> Iterator[None]:
    """Tables made inside are known by ``tag``."""
    _tag.append(tag)
    try:
        yield
    finally:
        _tag.pop()


def release(spark: SparkSession, tag: str, needed: DataFrame) -> None:
    """Remove the tables of ``tag`` unless ``needed`` still reads one of them."""
    old = _tagged.get(tag, [])
    names = {p.rpartition("/")[2] for p in old}
    if old and not any(part in names for f in needed.inputFiles() for part in f.split("/")):
        for p in _tagged.pop(tag):
            remove(spark, p)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a folder, in place of what was at ``to``; false if there is none."""
    where, store = _file(spark, path)
    target, _ = _file(spark, to)
    store.delete(target, True)
    if not store.exists(where):
        return False
    if not store.rename(where, target):
        raise OSError(f"{path} could not be moved to {to}")
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or None; if its replacement was broken off, the new one."""
    for at in (path, f"{path}.new"):
        where, store = _file(spark, at)
        if store.exists(where):
            stream = store.open(where)
            try:
                return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
    return None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: the new one is whole before the old one goes."""
    new, store = _file(spark, f"{path}.new")
    stream = store.create(new, True)
    stream.write(text.encode())
    stream.close()
    where, _ = _file(spark, path)
    store.delete(where, False)
    store.rename(new, where)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Jobs inside leave no shuffle files."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def write(df: DataFrame, path: str, codec: str = "zstd", by: str | None = None, mode: str = "errorifexists") -> None:
    """Write a scratch table."""
    out = df.write.mode(mode).option("compression", codec)
    with _cleaned(df.sparkSession):
        (out.partitionBy(by) if by else out).parquet(path)


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and return the table read back, and its path."""
    spark = df.sparkSession
    schema = df.schema
    path = new_path(spark, name)
    write(df, path, codec)
    return spark.read.schema(schema).parquet(path), path
