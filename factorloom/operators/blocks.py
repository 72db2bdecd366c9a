"""Panels cut into blocks of time, so that one asset's windows run in several tasks.

Rows are counted by (asset, bucket of time); running counts give each bucket its
block.  A block also gets copies of the rows that its windows reach back to, and
of those that forward returns look ahead to, so windows stay inside (asset,
block) and results are those of the whole asset.  No task sees an asset whole:
what is ordered for a whole asset are counts by bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a blocked panel: the block, the row number within the asset (from 1), and whether a row is the block's own.
BLOCK, PLACE, OWN = "__block", "__place", "__own"


def time_blocks(panel: DataFrame, before: int, after: int = 0, rows: int = 100_000, bucket_seconds: int = 3600) -> DataFrame:
    """``panel`` (``asset, ts, ...``) with BLOCK, PLACE and OWN; rows that other blocks need come again for each.

    A block has about ``rows`` rows, and no fewer buckets than one: choose ``bucket_seconds`` so
    that a bucket of one asset fits a task.  Rows of equal time keep no order among themselves,
    as in any window.
    """
    size = max(int(rows), before, after, 1)
    bucket = F.coalesce(F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "ts") / int(bucket_seconds)), F.lit(-(1 << 60)))
    tagged = panel.withColumn("__bucket", bucket)
    along = Window.partitionBy("asset").orderBy("__bucket")
    counts = tagged.groupBy("asset", "__bucket").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = counts.withColumn("start", start).withColumn(BLOCK, F.floor(F.col("start") / size))
    # any two blocks in a row hold more than `size` rows, so a row is needed two blocks away at most
    edges = numbered.groupBy("asset", BLOCK).agg(F.min("start").alias("first"))
    order = Window.partitionBy("asset").orderBy(BLOCK)
    near = {f"{c}{k}": F.lead(c, k).over(order) for c in (BLOCK, "first") for k in (1, 2)} | {f"{c}_{k}": F.lag(c, k).over(order) for c in (BLOCK, "first") for k in (1, 2)}
    edges = edges.withColumns(near)
    a, b = numbered.alias("a"), edges.alias("b")
    places = a.join(b, F.col("a.asset").eqNullSafe(F.col("b.asset")) & (F.col(f"a.{BLOCK}") == F.col(f"b.{BLOCK}"))).select("a.asset", "a.__bucket", "b.*").drop(F.col("b.asset"))
    t, p = tagged.alias("t"), places.alias("p")
    met = t.join(p, F.col("t.asset").eqNullSafe(F.col("p.asset")) & (F.col("t.__bucket") == F.col("p.__bucket")))
    met = met.select(*(F.col(f"t.`{c}`") for c in panel.columns), *(F.col(f"p.`{c}`") for c in edges.columns if c != "asset"))
    met = met.withColumn(PLACE, F.col("first") + F.row_number().over(Window.partitionBy("asset", BLOCK).orderBy("ts")))
    target = lambda c, own: F.struct(F.col(c).alias("block"), F.lit(own).alias("own"))
    copies = [target(BLOCK, True)]
    for k in (1, 2):
        copies.append(F.when(F.col(PLACE) > F.col(f"first{k}") - before, target(f"{BLOCK}{k}", False)))
        # the block k before ends where the one after it begins
        copies.append(F.when(F.col(PLACE) <= F.col("first" if k == 1 else "first_1") + after, target(f"{BLOCK}_{k}", False)))
    goes = F.filter(F.array(*copies), lambda c: c["block"].isNotNull())
    return met.select(*panel.columns, PLACE, F.explode(goes).alias("__to")).select(*panel.columns, F.col("__to.block").alias(BLOCK), PLACE, F.col("__to.own").alias(OWN))
