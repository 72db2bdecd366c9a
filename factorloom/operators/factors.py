"""Factor values and forward returns of a panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guarded import ratio
from ..plans import expr as X
from ..plans.compiler import Compiler, Prepared
from ..sources.panels import field_columns
from . import blocks


def compile_all(exprs: Sequence[str], compiler: Compiler, limits: X.Limits = X.Limits()) -> list:
    """A column for each expression; one that is not usable here is missing everywhere."""
    out = []
    for text in exprs:
        try:
            out.append(compiler.root(X.validate(text, limits)))
        except X.ExpressionError:
            out.append(F.lit(None).cast("double"))
    return out


def reach(exprs: Sequence[str]) -> int:
    """The rows that the longest window of some expressions has."""
    longest = 1
    for text in exprs:
        try:
            longest = max(longest, *(w.length for w in X.windows(X.validate(text))), 1)
        except X.ExpressionError:
            pass
    return longest


def forward_return(price: str, horizon: int = 1, *within: str):
    """price[t + horizon] / price[t] - 1; a zero price gives an infinite return."""
    w = Window.partitionBy("asset", *within).orderBy("ts")
    return ratio(F.lead(price, horizon).over(w), F.col(price)) - 1


def forward_returns(panel: DataFrame, price: str, horizon: int = 1) -> DataFrame:
    return panel.select("asset", "ts", forward_return(price, horizon).alias("fwd"))


def factor_frame(panel: DataFrame, exprs: Sequence[str], space: str, min_history: int = 1, price: str | None = None, horizon: int = 1, columns: Mapping[str, str] | None = None, block_rows: int | None = None, bucket_seconds: int = 3600) -> DataFrame:
    """``asset, ts, f0, f1, ...`` (and ``fwd`` with ``price``) from the ``min_history``-th row of each asset on.

    All windows of all expressions share one shuffle and one sort by (asset, ts).
    ``block_rows``: an asset is cut into blocks of time of about so many rows
    (``blocks.time_blocks``), for panels in which one asset is too much for a task.
    """
    if block_rows:
        panel = blocks.time_blocks(panel, reach(exprs), horizon if price else 0, block_rows, bucket_seconds)
    at = {"block": blocks.BLOCK, "place": blocks.PLACE} if block_rows else {}
    compiler = Compiler({k.lower(): v for k, v in (columns or field_columns(space)).items()}, prepared=Prepared(), **at)
    found = compile_all(exprs, compiler)
    panel = compiler.prepared.add_to(panel, compiler)
    fwd = [forward_return(price, horizon, *([blocks.BLOCK] if block_rows else [])).alias("fwd")] if price else []
    own = [F.col(blocks.OWN)] if block_rows else []
    wide = panel.select("asset", "ts", *(c.alias(f"f{i}") for i, c in enumerate(found)), *fwd, compiler.row().alias("__row"), *own)
    return wide.where((F.col("__row") >= min_history) & (F.col(blocks.OWN) if block_rows else F.lit(True))).drop("__row", blocks.OWN)


def factor_series(panel: DataFrame, text: str, space: str, min_history: int = 1, columns: Mapping[str, str] | None = None) -> DataFrame:
    """``asset, ts, factor`` of one expression."""
    return factor_frame(panel, [text], space, min_history, columns=columns).withColumnRenamed("f0", "factor")


def factor_long(panel: DataFrame, exprs: Sequence[str], space: str, min_history: int = 1, price: str | None = None, horizon: int = 1, columns: Mapping[str, str] | None = None, **blocked: int) -> DataFrame:
    """``expr_id, ts, asset, factor`` (and ``fwd``): one row for each expression, never a pivot.

    ``blocked``: ``block_rows`` and ``bucket_seconds`` of ``factor_frame``.
    """
    return lengthen(factor_frame(panel, exprs, space, min_history, price, horizon, columns, **blocked), len(exprs))


def lengthen(wide: DataFrame, count: int) -> DataFrame:
    """Columns ``f0, f1, ...`` as rows ``expr_id, ts, asset, factor`` (and ``fwd`` where it is there)."""
    ids = F.posexplode(F.array(*(F.col(f"f{i}") for i in range(count)))).alias("expr_id", "factor")
    return wide.select(ids, "ts", "asset", *(["fwd"] if "fwd" in wide.columns else []))


def last_values(panel: DataFrame, exprs: Sequence[str], space: str, min_history: int = 1, columns: Mapping[str, str] | None = None) -> DataFrame:
    """The factors at the last time of each asset, if it has the history."""
    wide = factor_frame(panel, exprs, space, min_history, columns=columns)
    return wide.groupBy("asset").agg(F.max("ts").alias("ts"), *(F.max_by(f"f{i}", "ts").alias(f"f{i}") for i in range(len(exprs))))
