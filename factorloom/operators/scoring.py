"""Scores of factors: across assets at each time, and through time for each asset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guarded import average_rank, clip, finite, pearson, sharpe
from .factors import factor_long
from .namespaces import across_long
from .ranks import spread_ranks

#: No cross-section has fewer assets than this, whatever the caller asks for.
LEAST_ASSETS = 8


def least_assets(given: int) -> int:
    return max(LEAST_ASSETS, int(given))


def _agreement() -> Column:
    """Share of rows with a signed factor whose forward return has the same sign."""
    active = F.signum("factor") != 0
    return F.avg(F.when(active, (F.signum("factor") == F.signum("fwd")).cast("double")))


def cross_sections(pairs: DataFrame, min_assets: int = LEAST_ASSETS, keys: Sequence[str] = ("expr_id",), spread: bool = False) -> DataFrame:
    """Metrics at each time: ``assets, dir_acc, ic, rank_ic, spread`` by ``keys`` and ``ts``.

    Only rows with factor and forward return count, and only times with enough
    of them.  The spread is the mean return of the top fifth less that of the
    bottom fifth; equal factors are put in the order of their assets.
    ``spread``: ranks by range exchanges (``ranks``), for cross-sections that
    are too much for a task; else by windows, a third of the shuffles.
    """
    by = [*keys, "ts"]
    rows = pairs.where(F.col("factor").isNotNull() & F.col("fwd").isNotNull())
    if spread:
        ranked = spread_ranks(rows.select(*by, "asset", "factor", "fwd"), by, "factor", ["asset"]).withColumnRenamed("rank", "rf").where(F.col("n") >= least_assets(min_assets))
        rows = spread_ranks(ranked.withColumnsRenamed({"place": "by_factor", "n": "assets"}), by, "fwd").select(*by, "asset", "factor", "fwd", "n", "rf", F.col("rank").alias("rr"), F.col("by_factor").alias("place"))
    else:
        n = F.count(F.lit(1)).over(Window.partitionBy(*by))
        rows = rows.withColumn("n", n).where(F.col("n") >= least_assets(min_assets))
        place = F.row_number().over(Window.partitionBy(*by).orderBy("factor", "asset"))
        rows = rows.select(*by, "asset", "factor", "fwd", "n", average_rank(F.col("factor"), *by).alias("rf"), average_rank(F.col("fwd"), *by).alias("rr"), place.alias("place"))
    fifth = F.greatest(F.lit(1), F.floor(F.col("n") * 0.2))
    top, bottom = F.avg(F.when(F.col("place") > F.col("n") - fifth, F.col("fwd"))), F.avg(F.when(F.col("place") <= fifth, F.col("fwd")))
    return rows.groupBy(*by).agg(
        F.first("n").cast("long").alias("assets"),
        finite(_agreement()).alias("dir_acc"),
        pearson(F.col("factor"), F.col("fwd"), pairs=False).alias("ic"),
        pearson(F.col("rf"), F.col("rr")).alias("rank_ic"),
        finite(top - bottom).alias("spread"),
    )


def over_time(sections: DataFrame, keys: Sequence[str] = ("expr_id",)) -> DataFrame:
    """Means, spreads and information ratios over the times of ``cross_sections``."""
    n, ls = F.count("rank_ic"), F.count("spread")
    return sections.groupBy(*keys).agg(
        F.avg("dir_acc").alias("dir_acc"),
        F.avg("ic").alias("ic_mean"),
        F.avg("rank_ic").alias("rank_ic_mean"),
        F.stddev_pop("rank_ic").alias("rank_ic_std"),
        sharpe(F.avg("rank_ic"), F.stddev_pop("rank_ic"), n).alias("rank_ic_ir"),
        sharpe(F.avg("ic"), F.stddev_pop("ic")).alias("icir"),
        F.avg("spread").alias("long_short_mean"),
        sharpe(F.avg("spread"), F.stddev_pop("spread"), ls).alias("long_short_sharpe"),
        n.cast("long").alias("valid_times"),
        F.avg("assets").alias("mean_assets"),
    )


CROSS_SECTION_METRICS = ("rank_ic_mean", "rank_ic_std", "rank_ic_ir", "long_short_mean", "long_short_sharpe")


def _expressions(panel: DataFrame, exprs: Sequence[str]) -> DataFrame:
    spark = panel.sparkSession
    return spark.createDataFrame([(i, e) for i, e in enumerate(exprs)], "expr_id int, expr string")


#: A panel of one namespace, or a panel for each of several.
Panels = DataFrame | Mapping[str, DataFrame]


def _paired(panel: Panels, exprs: Sequence[str], space: str, min_history: int, price: str, horizon: int, columns: Mapping[str, str] | None, **blocked: int) -> tuple[DataFrame, DataFrame]:
    """The panel whose rows are scored, and its factors with their forward returns."""
    if isinstance(panel, Mapping):
        return panel[space], across_long(panel, exprs, space, min_history, price, horizon)
    return panel, factor_long(panel, exprs, space, min_history, price, horizon, columns, **blocked)


def score_cross_section(panel: Panels, exprs: Sequence[str], space: str, price: str, horizon: int = 1, min_history: int = 1, min_assets: int = LEAST_ASSETS, columns: Mapping[str, str] | None = None, spread: bool = False, **blocked: int) -> DataFrame:
    """One row for each expression: its score from -1 to 1 and what it is made of.

    All expressions are scored in one job.  A universe of too few assets, an
    expression that cannot be used and one without any rank correlation score -1.
    With panels of several namespaces, the rows and the price are those of ``space``.
    ``spread`` and ``blocked`` (``block_rows``, ``bucket_seconds``) are for times and
    assets that are too much for a task: ``cross_sections``, ``factor_frame``.
    """
    least = least_assets(min_assets)
    panel, pairs = _paired(panel, exprs, space, min_history, price, horizon, columns, **blocked)
    enough = panel.select("asset").distinct().limit(least).agg(F.count("*") >= least).scalar()  # part of the plan, not a job before it
    return score_sections(cross_sections(pairs, min_assets, spread=spread), exprs, enough)


def score_sections(sections: DataFrame, exprs: Sequence[str], enough: Column | bool = True) -> DataFrame:
    """The scores of ``score_cross_section`` from the ``cross_sections`` of expressions, numbered as given; ``enough``: whether there are enough assets."""
    totals = over_time(sections).where((F.col("valid_times") > 0) & enough)
    joined = _expressions(sections, exprs).join(totals, "expr_id", "left")
    score = clip(F.col("rank_ic_mean") * 5.0 + 0.02 * F.tanh("rank_ic_ir"), -1.0, 1.0)
    return joined.select(
        "expr_id",
        "expr",
        F.coalesce(score, F.lit(-1.0)).alias("score"),
        *CROSS_SECTION_METRICS,
        F.coalesce("valid_times", F.lit(0)).cast("long").alias("valid_times"),
        F.coalesce("mean_assets", F.lit(0.0)).alias("mean_assets"),
    )


def score_direction(panel: Panels, exprs: Sequence[str], space: str, price: str, horizon: int = 1, min_history: int = 1, columns: Mapping[str, str] | None = None, **blocked: int) -> DataFrame:
    """One row for each expression and asset: share of signed factors that foretold the sign of the return.

    Without aligned rows the score is missing; with rows but no signed factor it is -1.
    """
    panel, pairs = _paired(panel, exprs, space, min_history, price, horizon, columns, **blocked)
    by = ["expr_id", "asset"]
    rows = pairs.where(F.col("factor").isNotNull() & F.col("fwd").isNotNull())
    ranked = rows.select(*by, "factor", "fwd", average_rank(F.col("factor"), *by).alias("rf"), average_rank(F.col("fwd"), *by).alias("rr"))
    found = ranked.groupBy(*by).agg(
        _agreement().alias("dir_acc"),
        pearson(F.col("factor"), F.col("fwd"), pairs=False).alias("ic"),
        pearson(F.col("rf"), F.col("rr")).alias("rank_ic"),
        F.count("*").cast("long").alias("samples"),
    )
    every = pairs.select(*by).distinct().join(found, by, "left")
    score = F.when(F.col("samples").isNotNull(), F.coalesce("dir_acc", F.lit(-1.0)))
    return every.join(_expressions(panel, exprs), "expr_id").select("expr_id", "expr", "asset", score.alias("score"), "dir_acc", "ic", "rank_ic", F.coalesce("samples", F.lit(0)).cast("long").alias("samples"))
