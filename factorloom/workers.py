"""The folder that a cluster shares: the package's code for Python workers, and tables that cut a long lineage."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_done: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, for a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="factorloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows as they are now, kept in the shared folder, for what is used more than once."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application, through the folder that the cluster shares."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    package = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent).as_posix())
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{package.name}-code-{sc.applicationId}/{package.name}-core-{uuid.uuid4().hex[:8]}.zip")
    store = target.getFileSystem(sc._jsc.hadoopConfiguration())
    stream = store.create(target, True)
    stream.write(held.getvalue())
    stream.close()
    sc.addPyFile(target.toString())
    _done.add(sc.applicationId)
