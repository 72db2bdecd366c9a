"""Sliding order statistics and windowed recurrences, as one scan along each asset.

Rows arrive sorted by asset and time, batch after batch; what is kept between
them is one window for each scan, so memory follows the window and not the rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import ship


@dataclass(frozen=True)
class Scan:
    """``kind`` (ema or rank) of the last ``rows`` values of ``source``, less the first ``lost`` of an asset."""

    kind: str
    source: str
    rows: int
    lost: int = 0


class Rank:
    """The place of the newest value among the finite ones of its window, ties counted."""

    def __init__(self, scan: Scan):
        self.size = scan.rows - scan.lost
        self.held: deque = deque()
        self.ordered: list[float] = []

    def step(self, v: float, place: int) -> float | None:
        known = math.isfinite(v)
        if len(self.held) == self.size and (old := self.held.popleft()) is not None:
            del self.ordered[bisect_left(self.ordered, old)]
        self.held.append(v if known else None)
        if known:
            insort(self.ordered, v)
            return float(bisect_right(self.ordered, v))
        return None


class Ema:
    """Exponential mean of a window, started at its first finite value.

    The endless mean ``h`` (weight ``a`` for the newest value) differs from the windowed one by
    what came before the window, which has decayed: h + (1 - a)^(m - 1) * (y_first - h_first)
    over the window's m finite values.  While an asset has fewer rows than the window, ``a``
    changes with every row, and the few values are weighed one by one.
    """

    def __init__(self, scan: Scan):
        self.rows, self.lost = scan.rows, scan.lost
        self.weight = 2.0 / (scan.rows - scan.lost + 1)
        self.h, self.row = math.nan, 0
        self.held: deque = deque()  # (row, value, h there) of finite values

    def step(self, v: float, place: int) -> float | None:
        self.row += 1
        size = min(self.rows, place) - self.lost
        while self.held and self.held[0][0] <= self.row - (self.rows - self.lost):
            self.held.popleft()
        if math.isfinite(v):
            self.h = v if math.isnan(self.h) else self.weight * v + (1.0 - self.weight) * self.h
            self.held.append((self.row, v, self.h))
        m = len(self.held)
        if not m or size <= 0:
            return None
        if place >= self.rows:
            _, first, then = self.held[0]
            return self.h + (1.0 - self.weight) ** (m - 1) * (first - then)
        a = 2.0 / (size + 1)
        w = a * (1.0 - a) ** np.arange(m - 1, -1, -1)
        w[0] = (1.0 - a) ** (m - 1)
        return float(w @ np.array([y for _, y, _ in self.held]))


KINDS = {"ema": Ema, "rank": Rank}


def scan_columns(panel: DataFrame, scans: Sequence[tuple[Scan, str]], keys: Sequence[str], ts: str, place: str | None = None) -> DataFrame:
    """Adds a column for each (scan, name), along ``ts`` within ``keys``.

    ``place``: the row number within the asset, where ``keys`` hold a part of it only.
    """
    ship(panel.sparkSession)
    names = [n for _, n in scans]
    schema = T.StructType([*panel.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    plan = [s for s, _ in scans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, steps, row = None, [], 0
        for batch in batches:
            cells = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            places = batch.column(place).to_pylist() if place else [None] * batch.num_rows
            values = [[math.nan if v is None else v for v in batch.column(s.source).to_pylist()] for s in plan]
            out: list[list] = [[] for _ in plan]
            for i, cell in enumerate(cells):
                if cell != at or not steps:
                    at, row, steps = cell, 0, [KINDS[s.kind](s) for s in plan]
                row += 1
                k = places[i] or row
                for o, x, s in zip(out, values, steps):
                    o.append(s.step(x[i], k))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(o, pa.float64()) for o in out)], names=[*batch.schema.names, *names])

    return panel.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, ts).mapInArrow(run, schema)
