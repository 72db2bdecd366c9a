from datetime import date, datetime

import pytest

from factorloom.operators import ingest as I
from factorloom.sources import panels as P
from factorloom.sources.versioned import VersionedTable
from factorloom.streaming.bars import stream_bars, write_upserts

TICKS = "date date, time_m string, symbol string, size long, price double, nbo double, nbb double"


def ticks(spark):
    from pyspark.sql import functions as F

    d = date(2024, 1, 2)
    rows = [(d, "9:30:01", " aa ", 100, 100.0, 100.1, 99.9), (d, "9:30:20.5", "AA", 200, 100.2, 100.1, 99.9), (d, "9:31:00", "AA", 50, 100.1, 100.3, 100.1), (d, "nonsense", "AA", 1, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, TICKS).withColumn("ts", I.tick_time(F.col("date"), F.col("time_m")))


def test_bars(spark):
    got = I.build_bars(ticks(spark)).orderBy("ts").collect()
    assert len(got) == 2 and (got[0]["open"], got[0]["high"], got[0]["volume"], got[0]["trade_count"]) == (100.0, 100.2, 300.0, 2.0)
    assert got[1]["close"] == 100.1 and got[0]["midret"] is None and got[1]["midret"] == pytest.approx(100.2 / 100.0 - 1)
    assert got[0]["imbalance"] == pytest.approx(200 / 300) and got[0]["symbol"] == "AA"
    bare = I.build_bars(ticks(spark).drop("nbo", "nbb")).first()
    assert bare["spread"] is None and bare["imbalance"] == 0.0
    assert I.symbol_counts(ticks(spark), spark.createDataFrame([("AA",), ("ZZ",)], "symbol string")).where("symbol = 'ZZ'").first()["rows"] == 0


def test_clean_daily(spark):
    cols = "permno string, dlycaldt string, " + ", ".join(f"{c} string" for c in I.DAILY) + ", o int"
    row = lambda k, d, close, ret, o: (k, d, "1", "1", "1", close, "x", ret, "5", o)
    raw = spark.createDataFrame([row("7", "2024-01-02", "10", "0.1", 0), row("7", "2024-01-02", "11", "0.2", 1), row("8", "2024-01-02", None, "0.1", 0), row("z", "2024-01-02", "1", "0.1", 0)], cols)
    got = I.clean_daily(raw, "o").collect()
    assert len(got) == 1 and got[0]["asset"] == "7" and got[0]["dlyclose"] == 11.0 and got[0]["dlyvol"] is None
    with pytest.raises(ValueError):
        I.clean_daily(raw.drop("dlycap"))


def test_members_and_largest(spark):
    rows = spark.createDataFrame([(1, date(2024, 1, k), float(k), 0.1, 5.0) for k in (1, 5, 9)] + [(2, date(2024, 1, 5), 1.0, 0.1, -50.0)], "permno int, dlycaldt date, dlyclose double, dlyret double, dlycap double")
    iv = spark.createDataFrame([(1, date(2024, 1, 2), date(2024, 1, 6)), (2, date(2024, 1, 1), None)], "permno int, start date, ending date")
    assert I.members(rows, iv, "permno", "dlycaldt").count() == 2
    assert {r["permno"] for r in I.daily_rows(rows, "2024-01-01", "2024-01-31", iv, 1).collect()} == {2}


def test_adapters_and_wide(spark):
    raw = spark.createDataFrame([("a", "2024-01-01", "1", "2", "0.5", "2", "9"), ("a", "2024-01-02", "1", "2", "0.5", "NaN", "bad"), ("a", "2024-01-03", "1", "2", "0.5", "3", "9")], "asset string, ts string, open string, high string, low string, close string, volume string")
    got = P.adapt(raw, "crypto").orderBy("ts").collect()
    assert [r["returns"] for r in got] == [None, 0.0, pytest.approx(0.5)] and got[1]["close"] is None and got[1]["volume"] is None
    with pytest.raises(ValueError):
        P.adapt(raw.drop("open"), "crypto")
    wide = {n: spark.createDataFrame([(date(2024, 1, 1), v, v + 1)], "ts date, A double, B double") for n, v in (("open", 1.0), ("close", 2.0))}
    assert sorted(tuple(r)[2:] + (r["asset"],) for r in P.from_wide(wide).collect()) == [(1.0, 2.0, "A"), (2.0, 3.0, "B")]
    with pytest.raises(ValueError):
        P.from_wide(wide, assets=["C"])


def test_as_of_and_upsert(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    left = spark.createDataFrame([("a", t(5), 1), ("a", t(1), 2), ("b", t(9), 3)], "asset string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([("a", t(2), 10.0), ("a", t(5), 20.0), ("a", t(6), 30.0)], "asset string, ts timestamp_ntz, v double")
    assert {r["id"]: r["v"] for r in P.as_of(left, right).collect()} == {1: 20.0, 2: None, 3: None}
    old, new = (spark.createDataFrame([("a", 1, v), ("a", k, v)], "symbol string, ts int, v double") for k, v in ((2, 1.0), (3, 9.0)))
    assert {r["ts"]: r["v"] for r in I.upsert(old, new).collect()} == {1: 9.0, 2: 1.0, 3: 9.0}


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("AA", datetime(2024, 1, 1, 9, 30, s), 100.0 + s, 1.0) for s in (1, 20)] + [("AA", datetime(2024, 1, 1, 9, 31, 5), 99.0, 2.0)]
    spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, price double, size double").write.parquet(str(source))
    stream = spark.readStream.schema("symbol string, ts timestamp_ntz, price double, size double").parquet(str(source))
    write_upserts(stream_bars(stream), str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = VersionedTable(spark, str(tmp_path / "out")).read().orderBy("start").collect()
    assert [(r["open"], r["close"], r["trade_count"]) for r in got] == [(101.0, 120.0, 2), (99.0, 99.0, 1)]


def test_tick_scan(spark, tmp_path):
    rows = [(" ab ", "2024-01-05 09:30:00", 1.0, 1.0), ("AB", "2024-01-05 16:00:00", 2.0, 1.0), ("AB", "2024-01-05 16:00:00.000001", 3.0, 1.0), ("AB", "2024-01-06 10:00:00", 4.0, 1.0), ("C", "2024-01-08 10:00:00", 5.0, 1.0), ("AB", "2024-01-08 10:00:00", None, 1.0), ("AB", "2024-01-09 10:00:00", 6.0, 1.0)]
    ticks = spark.createDataFrame(rows, "symbol string, ts string, price double, size double").selectExpr("symbol", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "price", "size", "CAST(ts AS DATE) AS day")
    assert I.normal_symbols([" ab", "AB", "", "c "]) == ("AB", "C")
    with pytest.raises(ValueError):
        I.scan_ticks(ticks, [" "], "2024-01-05", "2024-01-08")
    ticks.write.partitionBy("day").parquet(str(tmp_path / "ticks"))
    (tmp_path / "ticks" / "day=2024-01-05" / "broken.parquet").write_bytes(b"not parquet")
    schema = "symbol string, ts timestamp_ntz, price double, size double, day date"
    stored = spark.read.schema(schema).option("pathGlobFilter", "part-*").parquet(str(tmp_path / "ticks"))
    got = I.scan_ticks(stored, ["ab"], "2024-01-05", "2024-01-08", day="day")
    assert sorted(r["price"] for r in got.collect()) == [1.0, 2.0]
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().executedPlan().toString()


SCHEMA = "symbol string, ts timestamp_ntz, price double, size double"


def _days(spark, folder, days, rows=40):
    """Day folders of two files each, with pages that can be damaged apart."""
    for d in days:
        data = [(s, datetime.fromisoformat(d).replace(hour=10, minute=k), 1.0 + k, 2.0) for s in ("AA", "BB") for k in range(rows)]
        spark.createDataFrame(data, SCHEMA).repartition(2).write.parquet(f"{folder}/day={d}")


def test_a_damaged_file_takes_its_whole_day(spark, tmp_path):
    folder = f"{tmp_path}/ticks"
    _days(spark, folder, ["2024-01-03", "2024-01-04", "2024-01-05", "2024-01-09"])
    torn = next((tmp_path / "ticks" / "day=2024-01-04").glob("*.parquet"))
    data = bytearray(torn.read_bytes())
    data[30:200] = bytes(170)  # the pages; the footer can still be read
    torn.write_bytes(bytes(data))
    for f in (tmp_path / "ticks").rglob(".*.crc"):
        f.unlink()
    (tmp_path / "ticks" / "day=2024-01-05" / "extra.parquet").write_bytes(b"not parquet")
    (tmp_path / "ticks" / "day=2024-01-08").mkdir()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows, status = I.read_whole_days(spark, folder, SCHEMA, "2024-01-02", "2024-01-09")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert sorted({r.ts.date().isoformat() for r in rows.collect()}) == ["2024-01-03", "2024-01-09"] and rows.count() == 160
    got = {str(r.day): r for r in status.collect()}
    assert list(got) == ["2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05", "2024-01-08", "2024-01-09"]
    assert [r.whole for r in got.values()] == [False, True, False, False, False, True]
    assert (got["2024-01-02"].reason, got["2024-01-08"].reason) == ("missing", "no files") and got["2024-01-03"].rows == 80
    assert got["2024-01-04"].damaged == 1 and got["2024-01-05"].damaged == 1 and got["2024-01-05"].reason.startswith("extra.parquet: ") and got["2024-01-05"].files == 3


def test_a_table_of_whole_days(spark, tmp_path):
    folder, path = f"{tmp_path}/ticks", f"{tmp_path}/bars"
    _days(spark, folder, ["2024-01-03", "2024-01-04"])
    first = I.build_table(spark, folder, SCHEMA, ["aa ", "ZZ"], "2024-01-03", "2024-01-03", path)
    assert {r.symbol: r.rows for r in first["symbols"].collect()} == {"AA": 40, "ZZ": 0}
    both = I.build_table(spark, folder, SCHEMA, ["AA", "bb"], "2024-01-03", "2024-01-05", path)
    got = {r.symbol: r for r in both["symbols"].collect()}
    assert {s: r.rows for s, r in got.items()} == {"AA": 80, "BB": 80}
    assert (got["AA"].first, got["AA"].last) == (datetime(2024, 1, 3, 10), datetime(2024, 1, 4, 10, 39))
    again = I.build_table(spark, folder, SCHEMA, ["AA", "BB"], "2024-01-03", "2024-01-04", path)
    assert again["bars"].count() == 160
    assert I.read_whole_days(spark, folder, SCHEMA, "2024-02-01", "2024-02-02")[0].count() == 0


def test_symbol_check(spark):
    t = spark.createDataFrame([(" aa",), ("AA",), ("bb",), ("cc",)], "symbol string")
    assert [tuple(r) for r in I.symbol_counts(t, [" zz", "aa ", "AA", "", "bb"]).collect()] == [("AA", 2), ("BB", 1), ("ZZ", 0)]
    with pytest.raises(ValueError):
        I.symbol_counts(t, [" "])
