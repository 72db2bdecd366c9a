"""Panels: one long table ``asset, ts, <field> DOUBLE...`` for each namespace, and ways into it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.guarded import number, ratio
from ..plans import registry

#: Columns that each adapter needs, in namespace order.
NEEDED = {
    "crsp": ("dlyopen", "dlyhigh", "dlylow", "dlyclose", "dlyvol", "dlyret", "dlycap"),
    "taq": ("spread", "midret", "imbalance", "trade_size", "trade_count", "volume"),
    "crypto": ("open", "high", "low", "close", "volume"),
}


def field_columns(space: str, extra: Mapping[str, str] | None = None) -> dict[str, str]:
    """Full field name to panel column of a namespace."""
    return {f.full_name: f.name for f in registry.FIELDS.values() if f.space == space} | dict(extra or {})


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def pct_change(c, *partition: str, order: str):
    """Change against the last known value before; a missing value repeats the last known one."""
    w = Window.partitionBy(*partition).orderBy(order)
    known = F.last(c, ignorenulls=True)
    now = known.over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = known.over(w.rowsBetween(Window.unboundedPreceding, -1))
    return ratio(now, before) - 1


def adapt(df: DataFrame, space: str, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """A raw table as a panel: needed columns only, lenient numbers, time in order of arrival.

    Coin bars without ``returns`` get them from ``close``.
    """
    names = NEEDED[registry.space(space).name]
    require(df, (asset, ts, *names))
    own = [*names, *(["returns"] if space == "crypto" and "returns" in df.columns else [])]
    out = df.select(F.col(asset).cast("string").alias("asset"), F.col(ts).try_cast("timestamp_ntz").alias("ts"), *(number(F.col(n)).alias(n) for n in own))
    if space == "crypto" and "returns" not in own:
        out = out.withColumn("returns", pct_change(F.col("close"), "asset", order="ts"))
    return out


def from_wide(fields: Mapping[str, DataFrame], ts: str = "ts", assets: Sequence[str] | None = None) -> DataFrame:
    """One table for each field, a column for each asset, as one long panel.

    Every field must have every asset; rows are kept where any field has a value's row.  A time
    that a field has twice keeps its largest value.
    """
    if not fields:
        raise ValueError("no fields")
    wanted = list(assets or [c for c in next(iter(fields.values())).columns if c != ts])
    out = None
    for name, df in fields.items():
        require(df, [ts, *wanted])
        long = df.select(F.col(ts).alias("ts"), *(number(F.col(f"`{a}`")).alias(a) for a in wanted)).unpivot("ts", wanted, "asset", "value")
        long = long.select("asset", "ts", F.lit(name).alias("field"), "value")
        out = long if out is None else out.unionByName(long)
    # one shuffle for all fields, not a join for each
    return out.groupBy("asset", "ts").agg(*(F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in fields))


def to_long(panel: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """``asset, ts, field, value`` rows of a panel."""
    names = list(fields or [c for c in panel.columns if c not in ("asset", "ts")])
    return panel.unpivot(["asset", "ts"], names, "field", "value")


def read_panel(spark: SparkSession, path: str, space: str) -> DataFrame:
    return adapt(spark.read.parquet(path), space)


def write_panel(panel: DataFrame, path: str, by: str = "asset", mode: str = "overwrite") -> None:
    """Parquet, one folder for each value of ``by``; rows of an asset stay together and in order."""
    panel.repartition(by).sortWithinPartitions(by, "ts").write.mode(mode).partitionBy(by).parquet(path)


def file_safe(symbol):
    """A symbol as part of a file name."""
    return F.translate(symbol, "/:.", "___")


def time_slice(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows from ``start`` to ``end``, both included; empty bounds are open."""
    if start:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return df


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str] = ("asset",), ts: str = "ts") -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` at or before it, without a range join.

    Both sides are put in one order and the last right row is carried forward:
    one shuffle by key, linear in the rows.
    """
    by = list(by)
    values = [c for c in right.columns if c not in (*by, ts)]
    tagged = left.select(*by, ts, F.struct(*[c for c in left.columns if c not in (*by, ts)] or [F.lit(1).alias("one")]).alias("l"), F.lit(1).alias("side"))
    other = right.select(*by, ts, F.struct(*values).alias("r"), F.lit(0).alias("side"))
    w = Window.partitionBy(*by).orderBy(ts, "side").rowsBetween(Window.unboundedPreceding, 0)
    carried = tagged.unionByName(other, allowMissingColumns=True).withColumn("r", F.last("r", ignorenulls=True).over(w)).where("side = 1")
    own = [c for c in left.columns if c not in (*by, ts)]
    return carried.select(*by, ts, *(F.col(f"l.{c}").alias(c) for c in own), *(F.col(f"r.{c}").alias(c) for c in values))
