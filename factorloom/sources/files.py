"""Text and JSON in and out, by Hadoop paths."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

ARCHIVE = "expr string, signature string, score double, reward double, metrics map<string,double>, task string"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Stored factors from JSON lines."""
    return spark.read.schema(ARCHIVE).json(path)


def write_archive(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    records.select("expr", "signature", "score", "reward", "metrics", "task").write.mode(mode).json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``text`` rows."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def write_report(spark: SparkSession, payload: dict, path: str) -> None:
    """A small result (already on the driver) as a JSON document."""
    store.write_text(spark, path, json.dumps(payload, indent=2, sort_keys=True))


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)
