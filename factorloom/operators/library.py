"""Factor libraries: validation metrics, decorrelated selection, rank fusion, test metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.comoments import pooled_pearson
from ..functions.guarded import average_rank, plain
from ..sources.panels import time_slice
from .factors import factor_frame, lengthen
from .scoring import cross_sections, least_assets, over_time

METRICS = ("dir_acc", "ic_mean", "rank_ic_mean", "icir", "long_short_mean", "long_short_sharpe")


@dataclass(frozen=True)
class Selection:
    """Split bounds (included; None is open) and selection controls."""

    validation: tuple[str | None, str | None] = (None, None)
    test: tuple[str | None, str | None] = (None, None)
    threshold: float = 0.7
    top_k: int = 5
    min_history: int = 30
    min_assets: int = 8
    horizon: int = 1


@dataclass(frozen=True)
class Evaluation:
    """Metrics of one factor on one split."""

    name: str
    split: str
    dir_acc: float | None = None
    ic_mean: float | None = None
    rank_ic_mean: float | None = None
    icir: float | None = None
    long_short_mean: float | None = None
    long_short_sharpe: float | None = None
    valid_times: int = 0
    mean_assets: float = 0.0


@dataclass(frozen=True)
class LibraryResult:
    selected: tuple[str, ...]
    validation: Evaluation
    test: Evaluation
    threshold: float


def evaluate(pairs: DataFrame, min_assets: int = 8, keys: Sequence[str] = ("expr_id",)) -> DataFrame:
    """Library metrics by ``keys`` of ``ts, asset, factor, fwd`` rows."""
    return over_time(cross_sections(pairs, min_assets, keys), keys).select(*keys, *METRICS, "valid_times", F.coalesce("mean_assets", F.lit(0.0)).alias("mean_assets"))


def pair_correlations(factors: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """``a, b, corr`` of all pairs of expressions, pooled over (ts, asset), from ``expr_id, ts, asset, factor``.

    ``ids``: only these expressions.  A cell's factors meet in one array; pairs are sums of
    co-moment matrices, so neither rows nor shuffles grow with pairs times cells.
    """
    if ids is None:
        ids = [r[0] for r in factors.select("expr_id").distinct().collect()]  # one number for each expression
    ids = sorted(ids)
    rows = factors.where(F.col("factor").isNotNull() & F.col("expr_id").isin(ids))
    cells = rows.groupBy("ts", "asset").agg(F.map_from_entries(F.collect_list(F.struct("expr_id", "factor"))).alias("m"))
    return _named(pooled_pearson(cells.select(F.array(*(F.try_element_at("m", F.lit(i)) for i in ids)).alias("x")), "x", len(ids)), ids)


def wide_correlations(wide: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The same from ``factors.factor_frame`` rows (columns ``f<id>``), without any shuffle of rows."""
    ids = sorted(ids)
    return _named(pooled_pearson(wide.select(F.array(*(F.col(f"f{i}") for i in ids)).alias("x")), "x", len(ids)), ids)


def _named(found: DataFrame, ids: Sequence[int]) -> DataFrame:
    named = F.array(*(F.lit(i) for i in ids)) if ids else F.array().cast("array<int>")
    return found.select(*(F.get(named, F.col(c)).cast("int").alias(c) for c in ("a", "b")), "corr")


def in_order(scores: Mapping[int, float | None]) -> list[int]:
    """Best scores first, missing ones last, ties as given; scores that agree in twelve digits tie, as sums of other orders do."""
    return sorted(scores, key=lambda i: round(scores[i], 12) if scores[i] is not None else -1e12, reverse=True)


def select_decorrelated(scores: Mapping[int, float | None], corr: Mapping[tuple[int, int], float | None], threshold: float = 0.7, top_k: int = 5) -> list[int]:
    """Best scores first (missing last); a factor goes in unless it is too close to one that is in.

    Runs on the driver: it is sequential by definition, over one number for each factor.
    """
    return _admit([], in_order(scores), corr, threshold, top_k)


def _admit(chosen: list[int], candidates: Sequence[int], corr: Mapping[tuple[int, int], float | None], threshold: float, top_k: int) -> list[int]:
    chosen = list(chosen)
    for i in candidates:
        if len(chosen) >= top_k:
            break
        near = [abs(corr.get((min(i, j), max(i, j))) or 0.0) for j in chosen]
        if max(near, default=0.0) <= threshold:
            chosen.append(i)
    return chosen


def select_lazily(scores: Mapping[int, float | None], correlate: Callable[[Sequence[int]], DataFrame], threshold: float = 0.7, top_k: int = 5, wave: int | None = None) -> list[int]:
    """The choice of ``select_decorrelated``, with correlations only where the choice gets to.

    Candidates come in waves in the order of their scores.  A wave is first compared with what is
    chosen and with itself; it ends as soon as ``top_k`` are in, so lower candidates are never
    compared.  A wave is ``wave`` candidates (four times ``top_k``), twice as many each time, so a
    library of E factors takes log(E) waves at most.  Pair-wise masks leave no triangle inequality,
    so there is no bound to skip a pair inside a wave by.
    """
    order, chosen, at = in_order(scores), [], 0
    size = max(1, wave or 4 * top_k)
    while at < len(order) and len(chosen) < top_k:
        here = order[at : at + size]
        met = [*chosen, *here]
        corr = {(r["a"], r["b"]): plain(r["corr"]) for r in correlate(met).collect()} if len(met) > 1 else {}
        chosen = _admit(chosen, here, corr, threshold, top_k)
        at, size = at + len(here), 2 * size
    return chosen


def normalised_rank(pairs: DataFrame, keys: Sequence[str] = ("expr_id",)) -> DataFrame:
    """Adds ``rank``: average percentile rank at each time over all assets with a factor, from -1 to 1."""
    by = [*keys, "ts"]
    known = pairs.where(F.col("factor").isNotNull())
    share = average_rank(F.col("factor"), *by) / F.count(F.lit(1)).over(Window.partitionBy(*by))
    return known.withColumn("rank", (share - 0.5) * 2.0)


def fuse(pairs: DataFrame, chosen: Sequence[int]) -> DataFrame:
    """``ts, asset, factor, fwd``: the mean normalised rank of the chosen factors, where all are known.

    Means that agree in twelve digits are equal, so that the order in which rows arrive breaks no tie.
    """
    ranked = normalised_rank(pairs.where(F.col("expr_id").isin(list(chosen))))
    cells = ranked.groupBy("ts", "asset").agg(F.count("*").alias("k"), F.sum("rank").alias("s"), F.first("fwd").alias("fwd"))
    return cells.where(F.col("k") == len(chosen)).select("ts", "asset", F.round(F.col("s") / len(chosen), 12).alias("factor"), "fwd")


def _evaluation(name: str, split: str, row) -> Evaluation:
    if row is None:
        return Evaluation(name, split)
    return Evaluation(name, split, *(plain(row[m]) for m in METRICS), int(row["valid_times"]), float(row["mean_assets"] or 0.0))


def undersized(config: Selection) -> LibraryResult:
    none = Evaluation("undersized_universe", "undersized")
    return LibraryResult((), none, none, config.threshold)


def evaluate_library(panel: DataFrame, exprs: Sequence[str], space: str, price: str, config: Selection = Selection(), columns: Mapping[str, str] | None = None) -> LibraryResult:
    """Validate all factors in one job, choose decorrelated ones, fuse them, and evaluate the fusion on both splits."""
    exprs = list(dict.fromkeys(exprs))
    least = least_assets(config.min_assets)
    if panel.select("asset").distinct().limit(least).count() < least:
        return undersized(config)
    wide = factor_frame(panel, exprs, space, config.min_history, price, config.horizon, columns).cache()
    try:
        found = evaluate(lengthen(time_slice(wide, *config.validation), len(exprs)), least)
        return choose_and_fuse(wide, exprs, {r["expr_id"]: plain(r["rank_ic_mean"]) for r in found.collect()}, config)
    finally:
        wide.unpersist()


def choose_and_fuse(wide: DataFrame, exprs: Sequence[str], scores: Mapping[int, float | None], config: Selection) -> LibraryResult:
    """The rest of ``evaluate_library``: from ``factors.factor_frame`` rows of ``exprs`` and their scores on the validation split."""
    least = least_assets(config.min_assets)
    inside, pairs = time_slice(wide, *config.validation), lengthen(wide, len(exprs))
    chosen = select_lazily(dict.fromkeys(range(len(exprs))) | dict(scores), lambda ids: wide_correlations(inside, ids), config.threshold, config.top_k)
    results = []
    for split, bounds in (("validation_fused", config.validation), ("test_fused", config.test)):
        row = None
        if chosen:
            one = time_slice(fuse(pairs, chosen), *bounds).withColumn("expr_id", F.lit(0))
            row = evaluate(one, least).first()
        results.append(_evaluation("equal_weight_fusion", split, row))
    return LibraryResult(tuple(exprs[i] for i in chosen), *results, config.threshold)
