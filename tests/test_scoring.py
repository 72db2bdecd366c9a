import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from naive import series

from factorloom.operators import library as L
from factorloom.operators import scoring as S
from factorloom.operators.factors import factor_long, forward_returns
from factorloom.sources.panels import time_slice

DAY = datetime(2024, 1, 1)


def coins(spark, prices, volume=None):
    """A panel of closes by asset; high and low one off, returns computed."""
    rows = []
    for a, p in prices.items():
        for i, v in enumerate(p):
            rows.append((a, DAY + timedelta(days=i), float(v), v + 1.0, v - 1.0, float(v), float((volume or {}).get(a, [1000.0] * len(p))[i]), v / p[i - 1] - 1 if i and p[i - 1] else None))
    return spark.createDataFrame(rows, "asset string, ts timestamp_ntz, open double, high double, low double, close double, volume double, returns double")


def rising(n, days=6):
    return {f"a{k}": [100 + (k + 1) * i * i for i in range(days)] for k in range(n)}


def test_forward_returns(spark):
    got = [r["fwd"] for r in forward_returns(coins(spark, {"a": [10, 12, 15]}), "close").orderBy("ts").collect()]
    assert got == [pytest.approx(0.2), pytest.approx(0.25), None]
    got = [r["fwd"] for r in forward_returns(coins(spark, {"a": [0, 3, 0, 0]}), "close").orderBy("ts").collect()]
    assert got[0] == math.inf and got[1] == -1.0 and got[2] is None and got[3] is None


def test_universe_guard_and_rank_ic(spark):
    few = S.score_cross_section(coins(spark, rising(3)), ["last(crypto.close(1))"], "crypto", "close", min_assets=2).first()
    assert (few["score"], few["valid_times"], few["mean_assets"]) == (-1.0, 0, 0.0)
    many = S.score_cross_section(coins(spark, rising(8)), ["last(crypto.close(1))", "bad("], "crypto", "close").orderBy("expr_id").collect()
    assert many[0]["rank_ic_mean"] > 0 and many[0]["valid_times"] == 4  # at first all closes are equal: no rank correlation
    assert many[0]["mean_assets"] == 8 and many[1]["score"] == -1.0 and many[1]["rank_ic_mean"] is None


def _cross_reference(panel, text, history=3):
    """Spearman, spread and so on by pandas, time by time."""
    f, r = {}, {}
    for a, g in panel.toPandas().sort_values("ts").groupby("asset"):
        cols = {n: g[n].tolist() for n in ("open", "high", "low", "close", "volume", "returns")}
        cols = {k: [float("nan") if v is None else v for v in c] for k, c in cols.items()}
        s = pd.Series(series(text, cols), index=g.ts.tolist(), dtype=float)
        f[a] = s.iloc[history - 1 :]
        c = g.close.to_numpy(float)
        r[a] = pd.Series(np.append(c[1:] / c[:-1] - 1, np.nan), index=g.ts.tolist())
    f, r = pd.DataFrame(f), pd.DataFrame(r)
    ics, spreads, n = [], [], []
    for t in f.index:
        pair = pd.DataFrame({"f": f.loc[t], "r": r.loc[t]}).dropna()
        if len(pair) < 8:
            continue
        n.append(len(pair))
        a, b = pair.f.rank(), pair.r.rank()
        if a.std(ddof=0) > 1e-12 and b.std(ddof=0) > 1e-12:
            ics.append(a.corr(b))
        k = max(1, int(len(pair) * 0.2))
        o = pair.sort_index().sort_values("f", kind="stable")
        spreads.append(o.r.iloc[-k:].mean() - o.r.iloc[:k].mean())
    return np.array(ics), np.array(spreads), np.array(n)


def test_cross_section_matches_pandas(spark):
    rng = np.random.default_rng(5)
    prices = {f"a{k}": np.round(50 + rng.normal(0, 3, 20).cumsum().clip(-40), 1).tolist() for k in range(11)}
    panel = coins(spark, prices)
    text = "div(ts_mean(crypto.returns(3)), ts_std(crypto.returns(5)))"
    ics, spreads, n = _cross_reference(panel, text)
    got = S.score_cross_section(panel, [text], "crypto", "close", min_history=3).first()
    ir = ics.mean() / (ics.std() + 1e-12) * np.sqrt(len(ics))
    assert got["rank_ic_mean"] == pytest.approx(ics.mean()) and got["rank_ic_std"] == pytest.approx(ics.std()) and got["rank_ic_ir"] == pytest.approx(ir)
    assert got["score"] == pytest.approx(max(-1, min(1, 5 * ics.mean() + 0.02 * np.tanh(ir))))
    assert got["long_short_mean"] == pytest.approx(spreads.mean()) and got["valid_times"] == len(ics) and got["mean_assets"] == pytest.approx(n.mean())


def test_direction(spark):
    panel = coins(spark, {"up": [1, 2, 3, 4], "flat": [5, 5, 5, 5], "one": [3]})
    got = {(r["expr_id"], r["asset"]): r for r in S.score_direction(panel, ["sign(diff(crypto.close(2)))"], "crypto", "close").collect()}
    assert got[0, "up"]["score"] == 1.0 and got[0, "up"]["samples"] == 2
    assert got[0, "flat"]["score"] == -1.0 and got[0, "flat"]["dir_acc"] is None
    assert got[0, "one"]["score"] is None and got[0, "one"]["samples"] == 0


def test_selection_and_ties():
    assert L.select_decorrelated({0: 0.9, 1: 0.8, 2: 0.1}, {(0, 1): 1.0, (0, 2): 0.0, (1, 2): 0.0}) == [0, 2]
    assert L.select_decorrelated({0: None, 1: 0.1}, {}, top_k=1) == [1]
    assert L.select_decorrelated({0: 0.5, 1: 0.4}, {(0, 1): -0.9}) == [0]
    assert L.select_decorrelated({0: 0.5, 1: 0.4}, {(0, 1): None}) == [0, 1]


def test_library(spark):
    rng = np.random.default_rng(2)
    panel = coins(spark, {f"a{k}": (100 + rng.normal(0, 2, 24).cumsum()).tolist() for k in range(9)})
    split = L.Selection(("2024-01-01", "2024-01-15"), ("2024-01-16", "2024-01-24"), min_history=3)
    exprs = ["ts_mean(crypto.returns(3))", "mul(2, ts_mean(crypto.returns(3)))", "ts_std(crypto.returns(4))"]
    got = L.evaluate_library(panel, exprs, "crypto", "close", split)
    assert not {exprs[0], exprs[1]} <= set(got.selected) and got.validation.valid_times > 0 and got.test.valid_times > 0
    # the fusion against pandas
    pairs = factor_long(panel, list(got.selected), "crypto", 3, "close").toPandas()
    wide = [g.pivot(index="ts", columns="asset", values="factor") for _, g in pairs.groupby("expr_id")]
    fused = sum((w.rank(axis=1, pct=True) - 0.5) * 2 for w in wide) / len(wide)
    fwd = pairs[pairs.expr_id == 0].pivot(index="ts", columns="asset", values="fwd")
    inside = fused[fused.index <= datetime(2024, 1, 15)]
    ics = [x.corr(fwd.loc[t]) for t, x in inside.iterrows() if (x.notna() & fwd.loc[t].notna()).sum() >= 8]
    assert got.validation.ic_mean == pytest.approx(np.nanmean(ics)) and got.validation.icir == pytest.approx(np.nanmean(ics) / (np.nanstd(ics) + 1e-12))
    small = L.evaluate_library(coins(spark, rising(3)), exprs, "crypto", "close")
    assert small.selected == () and small.test.split == "undersized"


def test_slices_are_inclusive(spark):
    panel = coins(spark, {"a": [1, 2, 3, 4]})
    assert time_slice(panel, "2024-01-02", "2024-01-03").count() == 2 and time_slice(panel, "", None).count() == 4
