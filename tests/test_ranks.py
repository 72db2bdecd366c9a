"""Ranks by range exchanges against windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from factorloom.functions.guarded import average_rank
from factorloom.operators.ranks import spread_ranks
from factorloom.operators.scoring import cross_sections


def _rows(spark, seed=3):
    """One time has most of the rows; many values are equal, at that time half of them."""
    rng = random.Random(seed)
    rows = [(t, f"a{k:04d}", float(rng.choice([1, 1, 1, rng.randint(0, 50), rng.random()])), rng.gauss(0, 1)) for t, n in ((0, 900), (1, 12), (2, 5), (None, 40)) for k in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "ts int, asset string, factor double, fwd double").withColumn("expr_id", F.lit(0)).repartition(5)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_ranks_of_a_large_time(spark, parts):
    rows = _rows(spark)
    w = Window.partitionBy("ts")
    want = rows.select("ts", "asset", F.row_number().over(w.orderBy("factor", "asset")).cast("long").alias("place"), average_rank(F.col("factor"), "ts").alias("rank"), F.count("*").over(w).alias("n"))
    got = spread_ranks(rows, ["ts"], "factor", ["asset"], parts)
    assert got.columns == [*rows.columns, "place", "rank", "n"]
    key = lambda r: (r.ts is None, r.ts or 0, r.asset)
    assert sorted(map(tuple, want.collect()), key=repr) == sorted(map(tuple, got.select("ts", "asset", "place", "rank", "n").collect()), key=repr)
    if parts == 40:
        assert rows.repartitionByRange(parts, "ts", "factor", "asset").where("ts = 0").select(F.spark_partition_id()).distinct().count() > 5


def test_cross_sections_are_the_same(spark):
    rows = _rows(spark)
    whole, dealt = ({r.ts: [None if x is None else round(x, 9) for x in r[2:]] for r in cross_sections(rows, spread=s).collect()} for s in (False, True))
    assert whole == dealt and set(whole) == {0, 1, None}
    assert cross_sections(rows.limit(0), spread=True).count() == 0


def test_scores_in_blocks_and_spread(spark):
    from datetime import datetime, timedelta

    from factorloom.operators.scoring import score_cross_section

    rng = random.Random(2)
    rows = [(f"a{a}", datetime(2024, 1, 1) + timedelta(minutes=m), rng.uniform(1, 9)) for a in range(9) for m in range(60)]
    panel = spark.createDataFrame(rows, "asset string, ts timestamp_ntz, close double")
    texts = ["ts_mean(crypto.close(5))", "rank(crypto.close(9))", "ema(diff(crypto.close(4)))"]
    plain, split = (sorted([None if x is None else round(x, 9) if isinstance(x, float) else x for x in r] for r in score_cross_section(panel, texts, "crypto", "close", 2, 3, **o).collect()) for o in ({}, {"spread": True, "block_rows": 20, "bucket_seconds": 600}))
    assert plain == split
