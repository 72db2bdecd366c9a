"""Raw daily rows and ticks as panels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import date, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.guarded import finite, number, ratio
from ..sources import store
from ..sources.panels import require
from ..sources.versioned import VersionedTable

DAILY = ("dlyopen", "dlyhigh", "dlylow", "dlyclose", "dlyvol", "dlyret", "dlycap")
BARS = ("open", "high", "low", "close", "volume", "spread", "midret", "imbalance", "trade_size", "trade_count")


def members(rows: DataFrame, intervals: DataFrame, key: str, day: str, start: str = "start", end: str = "ending") -> DataFrame:
    """Rows within a membership interval of their key; a missing end is open.

    Equal keys join by hash or sort as Spark's size estimates decide, the range
    is a condition on top; a row in two intervals comes twice, as in SQL.
    """
    a, b = rows.alias("a"), intervals.alias("b")
    within = (F.col(f"a.{day}") >= F.col(f"b.{start}")) & (F.col(f"b.{end}").isNull() | (F.col(f"a.{day}") <= F.col(f"b.{end}")))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & within).select("a.*")


def largest(rows: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """Rows of the ``n`` keys with the largest mean absolute size; missing sizes come last, ties by key."""
    top = rows.groupBy(key).agg(F.avg(F.abs(size)).alias("__size")).orderBy(F.desc_nulls_last("__size"), key).limit(int(n)).select(key)
    return rows.join(top, key, "left_semi")


def daily_rows(rows: DataFrame, start: str, end: str, intervals: DataFrame | None = None, most: int | None = None, key: str = "permno", day: str = "dlycaldt") -> DataFrame:
    """The daily scan: range and not-null filters, then membership, then the largest assets."""
    out = rows.where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("dlyclose").isNotNull() & F.col("dlyret").isNotNull())
    if intervals is not None:
        out = members(out, intervals, key, day)
    return largest(out, key, "dlycap", most) if most else out


def one_asset(rows: DataFrame, asset: int | str, start: str | None = None, end: str | None = None, key: str = "permno", day: str = "dlycaldt") -> DataFrame:
    """The rows of one asset within a range of days (both included), in order; range and asset reach the scan."""
    out = rows.where(F.col(key) == asset)
    if start:
        out = out.where(F.col(day) >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col(day) <= F.lit(end).cast("date"))
    return out.orderBy(day)


def first_asset(rows: DataFrame, key: str = "permno", day: str = "dlycaldt") -> DataFrame:
    """The rows of the first asset of a table, the smallest key, in order; a table without ``key`` is one asset's."""
    if key not in rows.columns:
        return rows.orderBy(day)
    return rows.where(F.col(key) == rows.agg(F.min(key)).scalar()).orderBy(day)


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order]))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def clean_daily(rows: DataFrame, ordinal: str | None = None, key: str = "permno", day: str = "dlycaldt") -> DataFrame:
    """A daily panel: lenient numbers, rows without close or return dropped, one row for each (asset, day).

    Of duplicates the one with the largest ``ordinal`` stays (without one: the largest by its values).
    """
    require(rows, (key, day, *DAILY))
    out = rows.select(
        F.col(key).try_cast("long").cast("string").alias("asset"),
        F.col(day).try_cast("timestamp_ntz").alias("ts"),
        *(number(F.col(c)).alias(c) for c in DAILY),
        *([F.col(ordinal).alias("__ordinal")] if ordinal else []),
    ).na.drop(subset=["asset", "ts", "dlyclose", "dlyret"])
    return keep_last(out, ["asset", "ts"], ["__ordinal"] if ordinal else list(DAILY)).drop("__ordinal")


def tick_time(day: Column, time: Column) -> Column:
    """Date and time of day, with or without fractions; what cannot be read is missing."""
    return F.concat_ws(" ", day.cast("string"), time.cast("string")).try_cast("timestamp_ntz")


def build_bars(ticks: DataFrame, width: str = "1 minute", symbol: str = "symbol", ts: str = "ts", price: str = "price", size: str = "size", bid: str | None = "nbb", ask: str | None = "nbo") -> DataFrame:
    """``symbol, ts`` and BARS from trades with quotes.

    A trade above the middle of the quotes counts as a buy of its size, below it
    as a sale.  ``midret`` is the change of a bar's last known middle against the
    one before it on the same day.  Equal times are ordered by price and size.
    """
    has = bid in ticks.columns and ask in ticks.columns
    quote = lambda c: number(F.col(c)) if has else F.lit(None).cast("double")
    rows = ticks.select(
        F.upper(F.trim(F.col(symbol).cast("string"))).alias("symbol"),
        F.col(ts).cast("timestamp_ntz").alias("t"),
        number(F.col(price)).alias("price"),
        number(F.col(size)).alias("size"),
        ((quote(ask) + quote(bid)) / 2.0).alias("mid"),
        (quote(ask) - quote(bid)).alias("spread"),
    ).na.drop(subset=["symbol", "t", "price", "size"])
    side = F.when(F.col("price") > F.col("mid"), 1.0).when(F.col("price") < F.col("mid"), -1.0).otherwise(0.0)
    order = F.struct("t", "price", "size")
    bars = (
        rows.withColumn("signed", side * F.col("size"))
        .groupBy("symbol", F.window("t", width).alias("w"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("size").alias("volume"),
            F.avg("spread").alias("spread"),
            F.avg("size").alias("trade_size"),
            F.count("*").cast("double").alias("trade_count"),
            F.sum("signed").alias("signed"),
            F.max_by("mid", F.when(F.col("mid").isNotNull(), order)).alias("mid"),
        )
        .withColumn("ts", F.col("w.start").cast("timestamp_ntz"))
    )
    before = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts")
    last = F.last("mid", ignorenulls=True)
    now, then = last.over(before.rowsBetween(Window.unboundedPreceding, 0)), last.over(before.rowsBetween(Window.unboundedPreceding, -1))
    imbalance = F.when(F.abs("volume") > 0, F.try_divide(F.col("signed"), F.abs("volume")))
    out = bars.withColumns({"midret": finite(ratio(now, then) - 1), "imbalance": finite(imbalance), "spread": finite(F.col("spread"))})
    return out.select("symbol", "ts", *BARS)


def normal_symbols(symbols: Sequence[str]) -> tuple[str, ...]:
    """Symbols trimmed, in upper case, in the order given, each once; none at all is an error."""
    out = tuple(dict.fromkeys(t for x in symbols if (t := str(x).strip().upper())))
    if not out:
        raise ValueError("no symbol was given")
    return out


def scan_ticks(ticks: DataFrame, symbols: Sequence[str], start: str, end: str, opens: str = "09:30:00", closes: str = "16:00:00", symbol: str = "symbol", ts: str = "ts", price: str = "price", size: str = "size", day: str | None = None) -> DataFrame:
    """Trades of some symbols on the business days of a range, within a time of day (both ends included), with price and size.

    ``day``: a date column that the table is partitioned by; it prunes whole days.
    """
    when = F.col(ts).cast("timestamp_ntz")
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    clock = F.date_format(when, "HH:mm:ss.SSSSSS")
    upto = closes if "." in closes else f"{closes}.000000"
    out = ticks.where(F.col(day).between(first, last)) if day else ticks
    return out.where(
        when.cast("date").between(first, last)
        & (F.weekday(when) < 5)
        & clock.between(F.lit(opens), F.lit(upto))
        & F.upper(F.trim(F.col(symbol).cast("string"))).isin(*normal_symbols(symbols))
        & F.col(price).isNotNull()
        & F.col(size).isNotNull()
    )


@contextmanager
def _one_file_at_a_time(spark: SparkSession) -> Iterator[None]:
    """Jobs inside hand Python one row at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


DAY_STATUS = "day date, files long, rows long, damaged long, whole boolean, reason string"


def prove_days(spark: SparkSession, folder: str, days: Sequence[str]) -> list[dict]:
    """One status (of DAY_STATUS) for each of ``days`` of a table of day partitions (``day=2024-01-02/``).

    Tasks read every file of the days to its end, one file at a time; a day is whole if it has
    files and all of them can be read.  What comes back is a row for each day.  A file is at most 2 GB.
    """
    there = [d for d in days if store.exists(spark, f"{folder}/day={d}")]
    found: dict[str, dict] = {}
    if there:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{folder}/day={d}" for d in there])

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                    rows, reason = 0, ""
                    try:
                        with pq.ParquetFile(pa.BufferReader(content.as_buffer())) as f:
                            rows = sum(b.num_rows for b in f.iter_batches())
                            if rows != f.metadata.num_rows:
                                reason = f"{rows} of {f.metadata.num_rows} rows"
                    except Exception as problem:  # whatever is wrong with it, the day is not whole
                        reason = f"{type(problem).__name__}: {problem}"[:200]
                    yield pa.RecordBatch.from_pydict({"path": [path], "rows": pa.array([rows], pa.int64()), "reason": [reason]})

        proofs = raw.select("path", "content").mapInArrow(read, "path string, rows long, reason string")
        bad = F.col("reason") != ""
        by_day = proofs.groupBy(F.regexp_extract("path", "/day=([^/]+)/[^/]*$", 1).alias("day")).agg(
            F.count("*").alias("files"), F.sum(F.when(~bad, F.col("rows")).otherwise(0)).alias("rows"), F.count_if(bad).alias("damaged"), F.min(F.when(bad, F.concat(F.element_at(F.split("path", "/"), -1), F.lit(": "), F.col("reason")))).alias("reason")
        )
        with _one_file_at_a_time(spark):
            found = {r["day"]: r.asDict() for r in by_day.collect()}
    none = lambda d: {"day": d, "files": 0, "rows": 0, "damaged": 0, "reason": "no files" if d in there else "missing"}
    out = []
    for d in days:
        r = found.get(d) or none(d)
        out.append({**r, "day": date.fromisoformat(d), "whole": r["files"] > 0 and r["damaged"] == 0, "reason": r["reason"] or ""})
    return out


def business_days(start: str, end: str) -> list[str]:
    """Monday to Friday, both ends included."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    every = (first + timedelta(days=k) for k in range((last - first).days + 1))
    return [str(d) for d in every if d.weekday() < 5]


def read_whole_days(spark: SparkSession, folder: str, schema: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the whole business days of a range, and the status of all of them; no part of a damaged day is read."""
    status = prove_days(spark, folder, business_days(start, end))
    paths = [f"{folder}/day={s['day']}" for s in status if s["whole"]]
    rows = spark.read.schema(schema).option("basePath", folder).parquet(*paths) if paths else spark.createDataFrame([], schema)
    names = [c.split()[0] for c in DAY_STATUS.split(", ")]
    return rows, spark.createDataFrame([tuple(s[n] for n in names) for s in status], DAY_STATUS)


def build_days(ticks: DataFrame, symbols: Sequence[str], start: str, end: str, width: str = "1 minute", old: DataFrame | None = None, **scan: str) -> DataFrame:
    """Bars of several days in one job; bars of ``old`` stay where the new days have none."""
    bars = build_bars(scan_ticks(ticks, symbols, start, end, **scan), width)
    return bars if old is None else upsert(old, bars)


def build_table(spark: SparkSession, folder: str, schema: str, symbols: Sequence[str], start: str, end: str, path: str, width: str = "1 minute", **scan: str) -> dict[str, DataFrame]:
    """Bars of the whole days of a range, upserted into a versioned table by day.

    Returns ``bars`` (the table as it now is), ``days`` (the status of every business day asked for)
    and ``symbols`` (rows and range of every symbol asked for, over the table).
    """
    ticks, days = read_whole_days(spark, folder, schema, start, end)
    bars = build_bars(scan_ticks(ticks, symbols, start, end, **scan), width).withColumn("day", F.to_date("ts"))
    table = VersionedTable(spark, path, ("symbol", "ts"), "day")
    table.upsert(bars)
    now = table.read()
    return {"bars": now, "days": days, "symbols": bar_summary(now, symbols)}


def bar_summary(bars: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """``symbol, rows, first, last`` of the symbols asked for, without rows too, and of all others that there are."""
    spark = bars.sparkSession
    found = bars.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    wanted = spark.createDataFrame([(s,) for s in normal_symbols(symbols)], "symbol string")
    return wanted.join(found, "symbol", "full").fillna(0, ["rows"]).select("symbol", "rows", "first", "last")


def bars_panel(bars: DataFrame) -> DataFrame:
    """Bars as a panel; prices stay beside the features, for scoring on ``close``."""
    return bars.withColumnRenamed("symbol", "asset")


def symbol_counts(ticks: DataFrame, symbols: DataFrame | Sequence[str], symbol: str = "symbol") -> DataFrame:
    """``symbol, rows`` of all wanted symbols, 0 for those without rows, in the order of the symbols.

    Symbols are compared trimmed and in upper case; empty ones are left out.
    """
    normal = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    if not isinstance(symbols, DataFrame):
        symbols = ticks.sparkSession.createDataFrame([(s,) for s in normal_symbols(symbols)], "symbol string")
    n = ticks.groupBy(normal(symbol).alias("symbol")).agg(F.count("*").alias("rows"))
    wanted = symbols.select(normal("symbol").alias("symbol")).where("symbol <> ''").distinct()
    return wanted.join(n, "symbol", "left").fillna(0, ["rows"]).orderBy("symbol")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Old rows and a new batch; for equal keys the new row stays."""
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, ["__batch"]).drop("__batch")
