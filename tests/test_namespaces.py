"""Expressions over several namespaces against the slow evaluator, row by row."""

import math
import random
from datetime import datetime, timedelta

import pytest
from naive import Broken, evaluate

from factorloom.operators.namespaces import across_frame, across_long
from factorloom.operators.scoring import score_cross_section
from factorloom.plans import expr as X

DAY = datetime(2024, 1, 1)
EXPRESSIONS = [
    "corr(crypto.close(5), crsp.dlyclose(5))", "sub(crypto.close(3), crsp.dlyclose(3))", "ts_mean(add(crypto.close(4), crsp.dlyclose(2)))", "last(crsp.dlyclose(2)) * ts_std(crypto.volume(4))",
    "diff(mul(crypto.close(4), crsp.dlyclose(4)))", "ema(div(crypto.volume(3), crsp.dlyvol(3)))", "rank(sub(crypto.close(1), crsp.dlyclose(4)))", "cov(diff(crypto.close(4)), crsp.dlyvol(6)) + last(taq.spread(1))",
    "crsp.dlyclose(3)", "1.5", "neg(crypto.close(2))", "corr(crypto.close(9), taq.spread(9))", "add(crypto.close(2), crypto.close(3)) + crsp.dlyvol(1)", "bad(", "last(crypto.close(9999))",
]


def _histories(seed):
    """Two assets, three namespaces with times of their own; one asset lacks a namespace, some times are shared."""
    rng = random.Random(seed)
    fields = {"crypto": ("close", "volume"), "crsp": ("dlyclose", "dlyvol"), "taq": ("spread",)}
    out = {}
    for space, names in fields.items():
        for asset in ("a", "b"):
            if (space, asset) == ("taq", "b"):
                continue
            days = sorted(rng.sample(range(30), 18))
            values = {n: [rng.choice([float("nan"), float("inf")]) if rng.random() < 0.1 else round(rng.uniform(-3, 9), 2) for _ in days] for n in names}
            out[space, asset] = days, values
    return fields, out


def _panels(spark, fields, histories):
    panels = {}
    for space, names in fields.items():
        rows = [(a, DAY + timedelta(days=d), *(None if math.isnan(v[n][i]) else v[n][i] for n in names)) for (s, a), (days, v) in histories.items() if s == space for i, d in enumerate(days)]
        random.Random(2).shuffle(rows)
        panels[space] = spark.createDataFrame(rows, "asset string, ts timestamp_ntz, " + ", ".join(f"{n} double" for n in names))
    return panels


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_naive_evaluator(spark, seed):
    fields, histories = _histories(seed)
    got = {(r.asset, (r.ts - DAY).days): r for r in across_frame(_panels(spark, fields, histories), EXPRESSIONS, "crypto").collect()}
    for asset in ("a", "b"):
        days, _ = histories["crypto", asset]
        assert {d for a, d in got if a == asset} == set(days)
        for day in days:
            seen = {f"{s}.{n}": [x for d, x in zip(ds, v[n]) if d <= day] for (s, a), (ds, v) in histories.items() if a == asset for n in v}
            for i, text in enumerate(EXPRESSIONS):
                try:
                    value = evaluate(X.validate(text), {f"taq.spread": [], **seen})
                    value = (value[-1] if value else math.nan) if isinstance(value, list) else value
                except (Broken, X.ExpressionError):
                    value = math.nan
                have = got[asset, day][f"f{i}"]
                assert (have is None) == (not math.isfinite(value)) and (have is None or have == pytest.approx(value, rel=1e-9, abs=1e-9)), (text, asset, day, have, value)


def test_rows_and_history_are_those_of_the_base(spark):
    fields, histories = _histories(3)
    panels = _panels(spark, fields, histories)
    frame = across_frame(panels, ["last(crsp.dlyclose(1))"], "taq", min_history=4, price="spread")
    assert frame.columns == ["asset", "ts", "f0", "fwd"] and {r.asset for r in frame.collect()} == {"a"}
    assert frame.count() == len(histories["taq", "a"][0]) - 3
    assert across_long(panels, EXPRESSIONS, "crypto").count() == len(EXPRESSIONS) * panels["crypto"].count()


def test_namespaces_that_are_not_loaded(spark):
    fields, histories = _histories(4)
    panels = _panels(spark, fields, histories)
    with pytest.raises(ValueError, match="not loaded"):
        across_frame({"crypto": panels["crypto"]}, ["last(crypto.close(1))"], "crsp")
    only = across_frame({"crypto": panels["crypto"]}, ["last(crsp.dlyclose(1))", "ts_mean(crypto.volume(3))"], "crypto").collect()
    assert all(r.f0 is None for r in only) and any(r.f1 is not None for r in only)


def test_future_rows_of_another_namespace_are_not_seen(spark):
    fields, histories = _histories(5)
    panels = _panels(spark, fields, histories)
    cut = DAY + timedelta(days=15)
    late = dict(panels, crsp=panels["crsp"].where(f"ts <= timestamp_ntz'{cut}'"))
    one, two = (sorted(tuple(r) for r in across_frame(p, EXPRESSIONS, "crypto").where(f"ts <= timestamp_ntz'{cut}'").collect()) for p in (panels, late))
    assert repr(one) == repr(two)


def test_scores_over_two_namespaces(spark):
    days = range(40)
    coin = spark.createDataFrame([(f"c{a}", DAY + timedelta(days=d), float((a * 7 + d * 3) % 11 + 1)) for a in range(9) for d in days], "asset string, ts timestamp_ntz, close double")
    stock = spark.createDataFrame([(f"c{a}", DAY + timedelta(days=d), float((a * 5 + d) % 7)) for a in range(9) for d in days if d % 2], "asset string, ts timestamp_ntz, dlyclose double")
    got = score_cross_section({"crypto": coin, "crsp": stock}, ["sub(last(crypto.close(1)), last(crsp.dlyclose(1)))"], "crypto", "close").first()
    assert got.valid_times == 38 and got.mean_assets == 9.0
