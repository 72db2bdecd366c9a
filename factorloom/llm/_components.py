"""Connected components by alternating large and small stars; tables stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialise, remove


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``: long); root is the least node reachable."""
    spark = edges.sparkSession
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    table, path = materialise(pairs, "stars")
    before = None
    for _ in range(limit):
        # large star: neighbours above v go to the least neighbour of v
        both = table.select("v", "u").unionByName(table.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(low, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # small star: v and its neighbours below go to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        nxt, new_path = materialise(small.unionByName(low.select("v", F.col("m").alias("u"))).distinct(), "stars")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        remove(spark, path)
        table, path = nxt, new_path
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = table.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(table.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
