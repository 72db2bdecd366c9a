import math
import random
from datetime import datetime, timedelta

import pytest
from naive import series
from pyspark.sql import functions as F

from factorloom.operators import blocks
from factorloom.operators.factors import factor_frame, factor_series
from factorloom.plans import expr as X
from factorloom.plans.compiler import Compiler
from factorloom.sources.panels import field_columns

NAMES = ("open", "high", "low", "close", "volume", "returns")
DAY = datetime(2024, 1, 1)
SCHEMA = "asset string, ts timestamp_ntz, " + ", ".join(f"{n} double" for n in NAMES)
EXPRESSIONS = [
    "crypto.close(4)", "last(crypto.volume(3))", "first(crypto.volume(4))", "ts_mean(crypto.volume(5))", "ts_std(crypto.returns(6))", "ts_sum(crypto.returns(4))", "ts_min(crypto.returns(3))", "ts_max(crypto.volume(7))",
    "diff(crypto.close(4))", "diff(crypto.close(1))", "normalize(crypto.volume(5))", "zscore(crypto.volume(6))", "zscore(crypto.returns(6))", "ema(crypto.returns(5))", "rank(crypto.volume(6))", "log(crypto.returns(3))",
    "corr(crypto.close(6), crypto.volume(4))", "cov(crypto.returns(5), crypto.volume(9))", "corr(crypto.high(5), crypto.high(5))", "corr(sub(crypto.close(5), crypto.close(5)), crypto.open(4))",
    "sub(crypto.close(3), crypto.close(7))", "add(crypto.close(5), crypto.volume(1))", "div(crypto.close(2), diff(crypto.close(3)))", "ts_mean(diff(crypto.close(5)))", "ts_std(zscore(crypto.volume(6)))", "ema(diff(crypto.close(6)))",
    "ts_max(rank(crypto.volume(5)))", "ts_sum(normalize(crypto.returns(4)))", "ts_mean(ema(crypto.volume(5)))", "rank(div(crypto.close(5), crypto.volume(5)))", "first(diff(crypto.close(1)))", "diff(diff(crypto.close(5)))",
    "tanh(div(ts_mean(crypto.returns(3)), ts_std(crypto.returns(7))))", "sign(crypto.returns(3))", "abs_s(neg(crypto.volume(2)))", "ts_mean(mul(crypto.close(3), 2))", "div(1, crypto.volume(3))", "cov(diff(crypto.close(6)), crypto.volume(3))",
    "ts_mean(div(crypto.close(4), crypto.volume(4)))", "corr(mul(crypto.close(5), 2), diff(crypto.close(7)))", "ts_std(diff(diff(crypto.close(6))))", "first(log(crypto.close(4)))", "ema(log(crypto.volume(6)))", "rank(diff(crypto.close(5)))",
    "ema(crypto.volume(1))", "ema(diff(crypto.close(1)))", "rank(diff(crypto.close(1)))", "ts_sum(diff(crypto.close(1)))", "zscore(diff(crypto.close(6)))", "normalize(div(crypto.returns(5), crypto.returns(5)))", "ema(crypto.returns(20))", "rank(sub(crypto.returns(20), crypto.returns(20)))",
    "ts_max(zscore(diff(crypto.close(6))))", "ts_min(normalize(crypto.returns(5)))", "ts_mean(normalize(normalize(crypto.close(4))))", "corr(zscore(crypto.close(7)), crypto.volume(5))", "cov(normalize(crypto.close(6)), zscore(crypto.volume(6)))", "ts_std(normalize(zscore(crypto.close(5))))",
    "rank(zscore(crypto.volume(5)))", "ema(zscore(crypto.close(6)))", "ema(normalize(diff(crypto.close(5))))", "first(zscore(crypto.volume(4)))", "ts_sum(zscore(crypto.returns(6)))", "zscore(normalize(crypto.volume(5)))", "ts_sum(normalize(abs(crypto.returns(3))))", "zscore(diff(crypto.close(1)))", "last(zscore(crypto.close(1)))",
    "1.5", "zscore(zscore(crypto.close(5)))", "normalize(diff(crypto.close(4)))", "add(sub(crypto.close(3), crypto.open(6)), 1)", "ts_mean(sub(crypto.close(3), crypto.open(6)))",
]


def _panel(seed, rows=25):
    rng = random.Random(seed)
    special = [float("nan"), float("inf"), -float("inf"), 0.0]
    out = {}
    for a in range(3):
        out[f"a{a}"] = {n: [rng.choice(special) if rng.random() < 0.12 and n in ("volume", "returns") else round(rng.uniform(-3, 9), 2) for _ in range(rows)] for n in NAMES}
    out["a2"]["close"] = [5.0] * rows
    return out


def _frame(spark, panel):
    rows = [(a, DAY + timedelta(days=i), *(None if math.isnan(c[n][i]) else c[n][i] for n in NAMES)) for a, c in panel.items() for i in range(len(c["open"]))]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("how", ["columns", "arrays only", "prepared", "blocks of 4 rows", "blocks of 11 rows"])
def test_against_the_naive_evaluator(spark, how):
    panel = _panel(7)
    df = _frame(spark, panel)
    if how in ("columns", "arrays only"):
        c = Compiler(field_columns("crypto"), arrays_only=how == "arrays only")
        df = df.select("asset", "ts", *(c.root(X.validate(e)).alias(f"f{i}") for i, e in enumerate(EXPRESSIONS)))
    elif how == "prepared":
        df = factor_frame(df, EXPRESSIONS, "crypto")
    else:
        df = factor_frame(df, EXPRESSIONS, "crypto", block_rows=int(how.split()[2]), bucket_seconds=86400)
        assert df.count() == sum(len(c["open"]) for c in panel.values())
    got = {}
    for r in df.collect():
        got.setdefault(r["asset"], {})[(r["ts"] - DAY).days] = r
    for a, columns in panel.items():
        for i, e in enumerate(EXPRESSIONS):
            for k, want in enumerate(series(e, columns)):
                have = got[a][k][f"f{i}"]
                assert (have is None) == (want is None) and (want is None or have == pytest.approx(want, rel=1e-9, abs=1e-9)), (e, a, k, have, want)


def test_no_look_ahead(spark):
    panel = _panel(3)
    df = _frame(spark, panel)
    later = df.withColumns({n: F.when(F.col("ts") > F.lit(DAY + timedelta(days=14)).cast("timestamp_ntz"), F.lit(1e6)).otherwise(F.col(n)) for n in NAMES})
    keep = F.col("ts") <= F.lit(DAY + timedelta(days=14)).cast("timestamp_ntz")
    a, b = (factor_frame(d, EXPRESSIONS, "crypto").where(keep) for d in (df, later))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_known_values(spark):
    def last(values, text, min_history=1):
        rows = [("x", DAY + timedelta(days=i), *([float(v)] * 6)) for i, v in enumerate(values)]
        return [r["factor"] for r in factor_series(spark.createDataFrame(rows, SCHEMA), text, "crypto", min_history).orderBy("ts").collect()]

    assert last([1, 2, 3], "ema(crypto.close(3))")[-1] == pytest.approx(2.25)
    assert last([0.01, 0.02, 0.03, 0.04], "ts_mean(crypto.returns(2))")[2] == pytest.approx(0.025)
    assert last([0.01, 0.02, 0.03], "zscore(crypto.returns(3))")[2] == pytest.approx(1.224744871391589)
    assert last([10, 11, 13, 16], "last(crypto.close(2))", 2) == [11, 13, 16]
    assert last([1, -3], "normalize(crypto.close(2))")[1] == -0.75


def test_one_sort_for_all_windows(spark):
    df = factor_frame(_frame(spark, _panel(1)), ["div(ts_mean(crypto.returns(3)), ts_std(crypto.returns(7)))", "ts_max(crypto.close(9))", "diff(crypto.open(2))"], "crypto", 3, "close")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "Python" not in plan


def test_a_hot_asset_is_cut_into_blocks(spark):
    """Uneven times: buckets of no row and of many, blocks smaller than the reach between large ones."""
    rng = random.Random(8)
    minutes = sorted(rng.sample(range(60), 50) + rng.sample(range(600, 3000), 150) + list(range(5000, 5003)))
    rows = [("hot", m, rng.random()) for m in minutes] + [("cold", m, rng.random()) for m in (3, 700, 9000)]
    df = spark.createDataFrame([(a, DAY + timedelta(minutes=m), v) for a, m, v in rows], "asset string, ts timestamp_ntz, close double")
    cut = blocks.time_blocks(df, before=7, after=2, rows=20)
    own = cut.where(blocks.OWN)
    assert own.select("asset", "ts", "close").exceptAll(df).isEmpty() and own.count() == len(rows)
    places = {(r.asset, r.ts): r[blocks.PLACE] for r in own.collect()}
    assert sorted(p for (a, _), p in places.items() if a == "hot") == list(range(1, len(minutes) + 1))
    groups = {}
    for r in cut.collect():
        groups.setdefault((r.asset, r[blocks.BLOCK]), []).append(r)
    hot = [g for (a, _), g in groups.items() if a == "hot"]
    assert len(hot) > 5 and max(map(len, hot)) < len(minutes) / 2
    for g in groups.values():
        g.sort(key=lambda r: r.ts)
        mine = [r[blocks.PLACE] for r in g if r[blocks.OWN]]
        assert mine == list(range(mine[0], mine[-1] + 1))
        have, last = [r[blocks.PLACE] for r in g], max(p for (a, _), p in places.items() if a == g[0].asset)
        assert set(range(max(1, mine[0] - 6), min(last, mine[-1] + 2) + 1)) <= set(have) and len(set(have)) == len(have)


def test_factors_of_a_hot_asset(spark):
    rng = random.Random(6)
    rows = [("hot", m, rng.choice([None, 1.0, rng.random()]) or 0.5) for m in range(400)] + [("cold", m, 1.5) for m in range(3)] + [(None, m, 2.5 + m) for m in range(5)]
    df = spark.createDataFrame([(a, DAY + timedelta(minutes=m), float(v)) for a, m, v in rows], "asset string, ts timestamp_ntz, close double")
    texts = ["ts_mean(crypto.close(9))", "ema(crypto.close(12))", "rank(crypto.close(30))", "diff(crypto.close(3))", "ts_sum(diff(crypto.close(7)))", "ts_mean(zscore(crypto.close(5)))"]
    whole = factor_frame(df, texts, "crypto", 3, "close", 2)
    parts = factor_frame(df, texts, "crypto", 3, "close", 2, block_rows=40, bucket_seconds=600)
    key = lambda r: (r.asset or "", r.ts)
    for a, b in zip(sorted(whole.collect(), key=key), sorted(parts.collect(), key=key), strict=True):
        assert a[:2] == b[:2]
        assert [None if x is None else round(x, 9) for x in a[2:]] == [None if x is None else round(x, 9) for x in b[2:]]
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(asset#" in plan and "__block" in plan


def test_scans_keep_one_window(spark):
    """Long series: the endless mean does not drift away from the windowed one."""
    from factorloom.functions.sliding import Ema, Rank, Scan

    rng = random.Random(4)
    values = [math.nan if rng.random() < 0.2 else rng.choice([1e6, 1.0]) * rng.random() for _ in range(5000)]
    for n in (1, 2, 7, 300):
        ema, rank = Ema(Scan("ema", "x", n)), Rank(Scan("rank", "x", n))
        for i, v in enumerate(values):
            e, r = ema.step(v, i + 1), rank.step(v, i + 1)
            assert len(ema.held) <= n and len(rank.held) <= n
            if i % 97 == 0 or i < 20:
                window = values[max(0, i - n + 1) : i + 1]
                known = [x for x in window if math.isfinite(x)]
                acc, a = None, 2 / (len(window) + 1)
                for x in known:
                    acc = x if acc is None else a * x + (1 - a) * acc
                assert e == (None if acc is None else pytest.approx(acc, rel=1e-9))
                assert r == (None if math.isnan(v) else float(sum(x <= v for x in known)))


def test_unusable_expressions_are_missing(spark):
    df = factor_frame(_frame(spark, _panel(1)), ["no(", "last(crsp.dlyret(1))"], "crypto")
    assert df.where("f0 is not null or f1 is not null").isEmpty()
