"""The pruned profile index against plain correlations of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from factorloom.operators import candidates as C
from factorloom.operators.profiles import closest_profiles

NAN, INF = float("nan"), float("inf")


def _profile(rng, names):
    """Profiles gather around a few shapes; some metrics are missing or not finite."""
    shape = rng.randint(0, 9)
    out = {n: (shape * 37 + k * k * (shape % 3 + 1)) % 11 + rng.gauss(0, 0.4) for k, n in enumerate(names) if rng.random() > 0.05}
    if rng.random() < 0.1:
        out[rng.choice(names)] = rng.choice([NAN, INF, None])
    return out if rng.random() > 0.05 else dict.fromkeys(names, 3.0)


def _frames(spark, asked, held):
    a = spark.createDataFrame(list(enumerate(asked)), "ordinal int, metrics map<string,double>")
    return a, spark.createDataFrame([(m,) for m in held], "metrics map<string,double>")


@pytest.mark.parametrize("pivots,block", [(1, 3), (8, 1024), (64, 16)])
def test_the_closest_of_all(spark, pivots, block):
    rng, names = random.Random(5), [f"m{k}" for k in range(6)]
    held = [_profile(rng, names) for _ in range(400)] + [None, {}, {"m0": 1.0}, {"other": 2.0, "m1": 3.0, "m2": 1.0}]
    asked = [_profile(rng, names) for _ in range(60)] + [None, {}, {"m0": 1.0}, {"x": 1.0, "y": 2.0}, {"m1": -3.0, "m2": 5.0}]
    got = {r.ordinal: r for r in closest_profiles(*_frames(spark, asked, held), pivots, block, compared=True).collect()}
    archive = C.Archive(C.Record("e", str(k), 0.0, 0.0, m) for k, m in enumerate(held) if m is not None)
    for i, m in enumerate(asked):
        assert (got[i].closest if i in got else 0.0) == pytest.approx(archive.closest(m or {}), abs=1e-9), i
    if pivots == 64:
        assert sum(r.compared for r in got.values()) < 0.5 * len(asked) * len(held)


def test_an_empty_archive_and_copies(spark):
    a, none = _frames(spark, [{"x": 1.0, "y": 2.0, "z": 4.0}], [])
    assert closest_profiles(a, none).count() == 0
    a, copies = _frames(spark, [{"x": 1.0, "y": 2.0, "z": 4.0}], [{"x": 2.0, "y": 4.0, "z": 8.0}] * 500 + [{"x": -1.0, "y": -2.0, "z": -4.5}] * 500)
    row = closest_profiles(a, copies, compared=True).first()
    assert row.closest == pytest.approx(1.0) and row.compared <= 2


def test_no_join_without_a_key(spark):
    a, b = _frames(spark, [{"x": 1.0, "y": 2.0}], [{"x": 1.0, "y": 3.0}])
    plan = closest_profiles(a, b)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rewards_of_a_batch(spark):
    held = [("e", "s1", 0.5, 0.6, {"score": 0.5, "x": 2.0, "y": 4.0})]
    rows = [(0, "s0", True, 0.4, {"score": 0.4, "x": 1.0, "y": 3.0}), (1, "s1", True, 0.9, {"score": 0.9, "x": -1.0, "y": -3.0}), (2, "", False, -1.0, {})]
    batch = spark.createDataFrame(rows, "ordinal int, signature string, valid boolean, score double, metrics map<string,double>")
    archive = spark.createDataFrame(held, "expr string, signature string, score double, reward double, metrics map<string,double>")
    got = {r.ordinal: r for r in C.reward_batch(batch, archive).collect()}
    kept = C.Archive(C.Record(*r) for r in held)
    for i, s, valid, score, m in rows:
        want = C.reward_of(score, s in kept, kept.closest(m)) if valid else -1.0
        assert (got[i].reward, got[i].duplicate) == (pytest.approx(want), s in kept)
