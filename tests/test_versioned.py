"""Versions, broken-off and repeated batches of a table."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from factorloom.sources import store
from factorloom.sources.versioned import ConflictProblem, VersionedTable

SCHEMA = "symbol string, day date, v double"
D = [date(2024, 1, k) for k in range(1, 6)]


def rows(spark, *values):
    return spark.createDataFrame(values, SCHEMA)


def held(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"{tmp_path}/t", ("symbol", "day"), "day")


def test_upserts_touch_only_their_days(spark, table):
    assert table.upsert(rows(spark, ("a", D[0], 1.0), ("a", D[1], 2.0), ("b", D[1], 3.0), ("b", D[1], 4.0))) == 0
    assert held(table.read()) == [("a", D[0], 1.0), ("a", D[1], 2.0), ("b", D[1], 4.0)]
    first = table.manifest()["folders"]
    assert table.upsert(rows(spark, ("b", D[1], 0.5), ("c", D[2], 6.0))) == 1
    second = table.manifest()["folders"]
    assert second[str(D[0])] == first[str(D[0])] and second[str(D[1])] != first[str(D[1])]
    assert held(table.read()) == [("a", D[0], 1.0), ("a", D[1], 2.0), ("b", D[1], 0.5), ("c", D[2], 6.0)]
    assert held(table.read(0)) == [("a", D[0], 1.0), ("a", D[1], 2.0), ("b", D[1], 4.0)]
    assert held(table.read(parts=[str(D[2])])) == [("c", D[2], 6.0)]
    assert len(table.read(parts=[str(D[2])]).inputFiles()) == 1


def test_a_repeated_batch_changes_nothing(spark, table):
    assert table.append(rows(spark, ("a", D[0], 1.0)), "log", 0) == 0
    assert table.append(rows(spark, ("a", D[0], 2.0)), "log", 1) == 1
    assert table.append(rows(spark, ("a", D[0], 2.0)), "log", 1) == 1 and table.append(rows(spark, ("a", D[0], 1.0)), "log", 0) == 1
    assert table.append(rows(spark, ("a", D[0], 2.0)), "other", 0) == 2
    assert [r[2] for r in held(table.read())] == [1.0, 2.0, 2.0]


def test_a_broken_off_batch_is_not_seen(spark, table, monkeypatch):
    table.upsert(rows(spark, ("a", D[0], 1.0)), "stream", 0)
    with monkeypatch.context() as m:
        m.setattr(store, "put_new", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.upsert(rows(spark, ("a", D[0], 9.0), ("b", D[1], 9.0)), "stream", 1)
    assert held(table.read()) == [("a", D[0], 1.0)] and len(store.names_in(spark, f"{table.path}/data")) == 2
    assert table.upsert(rows(spark, ("a", D[0], 9.0), ("b", D[1], 9.0)), "stream", 1) == 1
    assert held(table.read()) == [("a", D[0], 9.0), ("b", D[1], 9.0)]
    table.expire(1)
    assert len(store.names_in(spark, f"{table.path}/data")) == 1 and held(table.read()) == [("a", D[0], 9.0), ("b", D[1], 9.0)]


def test_two_writers(spark, table):
    table.append(rows(spark, ("a", D[0], 1.0)))
    before = table.manifest()
    other = VersionedTable(spark, table.path, table.keys, table.by)
    other.append(rows(spark, ("b", D[0], 1.0)))
    with pytest.raises(ConflictProblem):
        table._commit(before, before["folders"], rows(spark).schema, None, None)
    assert held(table.read()) == [("a", D[0], 1.0), ("b", D[0], 1.0)]


def test_old_versions_expire(spark, table):
    for k in range(4):
        table.upsert(rows(spark, ("a", D[k % 2], float(k))))
    assert table.expire(2) == [0, 1] and table.versions() == [2, 3]
    assert held(table.read()) == [("a", D[0], 2.0), ("a", D[1], 3.0)] and held(table.read(2)) == [("a", D[0], 2.0), ("a", D[1], 1.0)]
    with pytest.raises(ValueError):
        table.read(0)


def test_odd_tables(spark, tmp_path):
    whole = VersionedTable(spark, f"{tmp_path}/w", ("k",))
    with pytest.raises(ValueError):
        whole.read()
    df = lambda *v: spark.createDataFrame(v, "k string, v int")
    whole.upsert(df((None, 1), ("x", 1)))
    whole.upsert(df((None, 2)))
    assert {r.k: r.v for r in whole.read().collect()} == {None: 2, "x": 1}
    part = VersionedTable(spark, f"{tmp_path}/p", ("k", "g"), "g")
    part.upsert(spark.createDataFrame([("x", None, 1), ("x", "a/b c=%", 2)], "k string, g string, v int"))
    part.upsert(spark.createDataFrame([("x", None, 5), ("y", "a/b c=%", 6)], "k string, g string, v int").withColumn("more", F.lit(7)))
    assert sorted((r.k, r.g or "", r.v, r.more or 0) for r in part.read().collect()) == [("x", "", 5, 7), ("x", "a/b c=%", 2, 0), ("y", "a/b c=%", 6, 7)]
    with pytest.raises(ValueError):
        VersionedTable(spark, f"{tmp_path}/n").upsert(df(("x", 1)))
