"""Pooled correlations by co-moments, lazy selection."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from factorloom.operators import library as L

DAY = datetime(2024, 1, 1)


def _plain(columns, i, j):
    both = np.isfinite(columns[i]) & np.isfinite(columns[j])
    x, y = columns[i][both], columns[j][both]
    if len(x) < 2 or x.std() <= 1e-12 or y.std() <= 1e-12:
        return None
    return float(np.cov(x, y, bias=True)[0, 1] / (x.std() * y.std()))


def _columns(n=9, rows=300, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, rows)) + rng.normal(size=rows)
    x[rng.random(x.shape) < 0.3] = np.nan
    x[1] = x[1] * 1e-4 + 1e6  # far from zero beside its spread
    x[2] = 5.0
    x[3, :150], x[4, 150:] = np.nan, np.nan  # never together
    x[5] = np.where(np.arange(rows) < 100, 3.0, x[5])
    x[6] = np.where(np.arange(rows) < 100, x[6], np.nan)  # known where its partner is constant
    return x


def _frames(spark, x):
    n, rows = x.shape
    value = lambda v: None if np.isnan(v) else float(v)
    wide = spark.createDataFrame([(f"a{r % 10}", DAY + timedelta(days=r // 10), *(value(x[i, r]) for i in range(n))) for r in range(rows)], "asset string, ts timestamp_ntz, " + ", ".join(f"f{i} double" for i in range(n)))
    long = spark.createDataFrame([(i, DAY + timedelta(days=r // 10), f"a{r % 10}", value(x[i, r])) for i in range(n) for r in range(rows)], "expr_id int, ts timestamp_ntz, asset string, factor double")
    return wide.repartition(3), long.repartition(3)


def test_pooled_correlations(spark):
    x = _columns()
    wide, long = _frames(spark, x)
    for found in (L.wide_correlations(wide, range(len(x))), L.pair_correlations(long)):
        got = {(r.a, r.b): r.corr for r in found.collect()}
        assert (3, 4) not in got
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                want = _plain(x, i, j)
                assert got.get((i, j)) == (want if want is None else pytest.approx(want, abs=1e-7)), (i, j)


def test_some_of_the_columns(spark):
    x = _columns()
    wide, long = _frames(spark, x)
    for found in (L.wide_correlations(wide, [7, 0]), L.pair_correlations(long, [0, 7])):
        rows = found.collect()
        assert [(r.a, r.b) for r in rows] == [(0, 7)] and rows[0].corr == pytest.approx(_plain(x, 0, 7))
    assert L.pair_correlations(long.limit(0)).count() == 0


def test_rows_are_not_multiplied(spark):
    wide, _ = _frames(spark, _columns())
    plan = L.wide_correlations(wide, range(9))._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan


@pytest.mark.parametrize("wave", [None, 1, 3])
def test_lazy_selection_chooses_the_same(spark, wave):
    rng = random.Random(9)
    for _ in range(40):
        n, k = rng.randint(1, 30), rng.randint(1, 6)
        scores = {i: rng.choice([None, round(rng.random(), 1)]) for i in range(n)}
        corr = {(i, j): rng.choice([None, rng.uniform(-1, 1)]) for i in range(n) for j in range(i + 1, n)}
        asked = []

        class Some:
            def __init__(self, ids):
                self.ids = ids

            def collect(self):
                asked.append(len(self.ids))
                return [{"a": i, "b": j, "corr": c} for (i, j), c in corr.items() if i in self.ids and j in self.ids]

        want = L.select_decorrelated(scores, corr, 0.5, k)
        assert L.select_lazily(scores, Some, 0.5, k, wave) == want
        if n == 30 and wave is None and len(want) == k:
            assert sum(asked) <= n + k * len(asked)


def test_low_candidates_are_not_compared():
    asked = []

    class None_:
        def __init__(self, ids):
            asked.append(list(ids))

        def collect(self):
            return []

    assert L.select_lazily({i: 100.0 - i for i in range(100)}, None_, 0.7, 5) == [0, 1, 2, 3, 4]
    assert asked == [list(range(20))]
