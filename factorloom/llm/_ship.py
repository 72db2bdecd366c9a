"""The package's own code for the Python workers, wherever they run."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from ._store import shared_dir

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application.

    The archive goes through the shared folder, so that executors that start
    later, or again, find it too.
    """
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    package = Path(__file__).resolve().parents[1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent).as_posix())
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/code/{package.name}.zip")
    stream = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    stream.write(held.getvalue())
    stream.close()
    sc.addPyFile(target.toString())
    _done.add(sc.applicationId)
