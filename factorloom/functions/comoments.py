"""Pooled correlations of many columns at once, by partial co-moment matrices.

Each task turns its rows into five small matrices (pairs known, sums, squares
and products under pair-wise masks: matrix products, nothing is exploded) and
hands on one row for each pair.  Spark adds those up with partial sums, so what
is shuffled is a row for each pair and task, however many rows there are.
Values are taken from a centre that is near each column's mean, so that sums of
squares do not cancel: each task has its own, and its few sums are moved to a
common one, so no pass over the values goes before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .guarded import EPS, finite

_PAIR = "a int, b int, n double, cx double, cy double, sx double, sy double, sxx double, syy double, sxy double"
#: A spread that is this small beside the distance from the centre is rounding.
RELATIVE = 1e-13


def partial_moments(values: DataFrame, column: str, width: int) -> DataFrame:
    """One row (of _PAIR) for each pair of places ``a < b`` and task, from an array column of doubles.

    Sums are from the task's own centres ``cx, cy``: the means of the first batch in which a place is known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, middle = np.zeros((6, width, width)), np.full(width, np.nan)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            known = np.isfinite(flat)
            new = np.isnan(middle) & known.any(axis=0)  # nothing of these has been added up yet
            with np.errstate(over="ignore", invalid="ignore"):
                middle[new] = np.where(known, flat, 0.0).sum(axis=0)[new] / known.sum(axis=0)[new]
                x = np.where(known, flat - middle, 0.0)
                m, sq = known.astype(float), x * x
                total += (m.T @ m, x.T @ m, m.T @ x, sq.T @ m, m.T @ sq, x.T @ x)
        a, b = np.nonzero(np.triu(total[0] > 0, 1))
        columns = [pa.array(a, pa.int32()), pa.array(b, pa.int32()), *(pa.array(v) for v in (total[0][a, b], middle[a], middle[b], *(t[a, b] for t in total[1:])))]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n", "cx", "cy", "sx", "sy", "sxx", "syy", "sxy"])

    return values.select(F.col(column).cast("array<double>")).mapInArrow(run, _PAIR)


def pooled_pearson(values: DataFrame, column: str, width: int) -> DataFrame:
    """``a, b, corr`` of all pairs of places of an array column of doubles, over the rows where both are known.

    Missing for fewer than two such rows or no spread.  Pairs that never meet have no row.
    The values are read once.
    """
    parts, pair = partial_moments(values, column, width), Window.partitionBy("a", "b")
    # from the task's centres to the mean of all tasks' centres, by as much as (dx, dy)
    n, dx, dy = (F.col(c) for c in ("n", "dx", "dy"))
    parts = parts.withColumns({f"d{c}": F.col(f"c{c}") - F.sum(n * F.col(f"c{c}")).over(pair) / F.sum(n).over(pair) for c in "xy"})
    moved = {
        "n": n,
        "sx": F.col("sx") + n * dx,
        "sy": F.col("sy") + n * dy,
        "sxx": F.col("sxx") + 2 * dx * F.col("sx") + n * dx * dx,
        "syy": F.col("syy") + 2 * dy * F.col("sy") + n * dy * dy,
        "sxy": F.col("sxy") + dx * F.col("sy") + dy * F.col("sx") + n * dx * dy,
    }
    sums = parts.groupBy("a", "b").agg(*(F.sum(v).alias(c) for c, v in moved.items()))
    mx, my = F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    vx, vy = F.col("sxx") / F.col("n") - mx * mx, F.col("syy") / F.col("n") - my * my
    spread = (F.col("n") >= 2) & (vx > EPS * EPS) & (vy > EPS * EPS) & (vx > RELATIVE * mx * mx) & (vy > RELATIVE * my * my)
    return sums.select("a", "b", F.when(spread, finite(F.try_divide(F.col("sxy") / F.col("n") - mx * my, F.sqrt(vx) * F.sqrt(vy)))).alias("corr"))
