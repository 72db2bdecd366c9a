"""Ranks of large cross-sections, so that one timestamp is not one task.

Rows are put in the order of (keys, value, tie-breaker) by a range exchange,
whose parts split a large cross-section wherever its rows are.  A part numbers
its own rows; what came before a part within its cross-section is a sum over
parts, of which there is one row for each part and cross-section.  Equal values
that lie in several parts meet as one row for each part and value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import cut


def spread_ranks(rows: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Adds ``place`` (from 1, ties by ``tie``), ``rank`` (average over ties) and ``n`` within ``keys``, for rows whose ``value`` is known.

    The same numbers as windows over ``keys`` give, for cross-sections of any size.
    """
    keys = list(keys)
    order = [F.col(c) for c in (*keys, value, *tie)]
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    # kept, so that the numbers and the sums over parts are of the same deal
    held = cut(dealt.withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part", *keys).orderBy(value, *tie)
    local = held.withColumn("__k", F.row_number().over(inside))
    sizes = held.groupBy(*keys, "__part").agg(F.count("*").alias("__m"))
    along = Window.partitionBy(*keys).orderBy("__part")
    before = F.coalesce(F.sum("__m").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*keys, "__part", before.alias("__before"), F.sum("__m").over(Window.partitionBy(*keys)).alias("n"))
    placed = _join(local, offsets, [*keys, "__part"]).withColumn("place", (F.col("__before") + F.col("__k")).cast("long"))
    # equal values of a part are one row; those of several parts are put together, and each part is told
    ties = placed.groupBy(*keys, "__part", value).agg(F.min("place").alias("__lo"), F.max("place").alias("__hi"))
    same = Window.partitionBy(*keys, value)
    told = ties.select(*keys, "__part", value, ((F.min("__lo").over(same) + F.max("__hi").over(same)) / F.lit(2.0)).alias("rank"))
    return _join(placed, told, [*keys, "__part", value]).select(*rows.columns, "place", "rank", "n")


def _join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    a, b = left.alias("a"), right.alias("b")
    same = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in on]
    return a.join(b, same).select(*(F.col(f"a.`{c}`") for c in left.columns), *(F.col(f"b.`{c}`") for c in right.columns if c not in on))
