"""Bars from an unbounded stream of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versioned import VersionedTable


def stream_bars(trades: DataFrame, width: str = "1 minute", late: str = "5 minutes", symbol: str = "symbol", ts: str = "ts", price: str = "price", size: str = "size") -> DataFrame:
    """Tumbling bars ``symbol, start, open, high, low, close, volume, trade_count``.

    Trades later than ``late`` behind the newest one are dropped, and a bar is
    final when the watermark has passed its end, so state stays bounded.
    """
    order = F.struct("t", price, size)
    rows = trades.withColumn("t", F.col(ts).cast("timestamp")).withWatermark("t", late)  # watermarks need zoned times
    return (
        rows.groupBy(F.col(symbol).alias("symbol"), F.window("t", width).alias("w"))
        .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(size).alias("volume"), F.count("*").alias("trade_count"))
        .select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "trade_count")
    )


def write_upserts(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("symbol", "start"), by: str | None = None, keep: int | None = 10):
    """Keep a versioned table of the last row of each key.

    A batch writes the partitions (of ``by``) that it touches and one manifest; a batch that is
    run again changes nothing.  All but the newest ``keep`` versions go.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table = VersionedTable(batch.sparkSession, path, keys, by)
        table.upsert(batch, "stream", number)
        if keep:
            table.expire(keep)

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge)
