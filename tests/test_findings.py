"""Cases that a review found: queries on small tables of their own against their SQL, and steps that must not grow."""

import random
import statistics
import tracemalloc
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from factorloom import catalog
from factorloom.functions.comoments import pooled_pearson
from factorloom.operators import candidates as C
from factorloom.operators.candidates import expressions_in
from factorloom.operators.profiles import _blocks
from factorloom.sources import candidate_source


def _events(tmp_path, values, users=1, step=timedelta(hours=13)):
    """``events.parquet`` with these values, dealt to the users in turn."""
    at = datetime(2024, 1, 1)
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, 'view', ?, '{}')", [(i, at + step * (i // users), i % users, v) for i, v in enumerate(values)])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    return con


def _same(spark, tmp_path, con, name):
    want = con.execute(catalog.ORACLE[name])
    columns = [c[0] for c in want.description]
    show = lambda rows: sorted(tuple("-" if v is None else repr(v + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert show(got) == show(want.fetchall())


def test_hot_asset_after_a_zero_price(spark, tmp_path):
    con = _events(tmp_path, [1.0, 2.0, 0.0, 4.0, 5.0] * 5, step=timedelta(seconds=7))
    _same(spark, tmp_path, con, "dsl_hot_asset")


def test_sign_of_a_difference_that_is_rounding(spark, tmp_path):
    con = _events(tmp_path, [0.3, 0.1, 0.2], step=timedelta(days=1))  # the mean is 0.20000000000000004
    _same(spark, tmp_path, con, "dsl_sign_s")


@pytest.mark.parametrize("name", ["ingest_adapter", "score_forward_returns"])
def test_returns_half_way_between_two_roundings(spark, tmp_path, name):
    con = _events(tmp_path, [32.0, 15.67, 32.0, 96.77, 6.4, 9.73], step=timedelta(days=1))
    _same(spark, tmp_path, con, name)


@pytest.mark.parametrize("name", ["ingest_adapter", "score_forward_returns"])
def test_days_that_close_with_events_at_one_time(spark, tmp_path, name):
    """The first of them counts, for the open too."""
    con = _events(tmp_path, [3.0, 5.0, 7.0, 2.0, 8.0, 4.0, 9.0, 1.0], step=timedelta(hours=6))
    con.execute("UPDATE events SET ts = date_trunc('day', ts)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    _same(spark, tmp_path, con, name)


@pytest.mark.parametrize("name", ["ingest_adapter", "score_forward_returns"])
def test_days_that_close_without_a_value(spark, tmp_path, name):
    con = _events(tmp_path, [3.0, None, None, 2.0, 8.0, None], step=timedelta(hours=12))
    _same(spark, tmp_path, con, name)


def test_candidates_of_one_cell_are_dealt_to_blocks(spark):
    """However many candidates or profiles a cell has, what meets at once is bounded."""
    rows = spark.range(5000).select(F.lit(1).alias("cell"), F.col("id").alias("ordinal"), F.array(F.col("id").cast("double")).alias("u"))
    blocks = _blocks(rows, ["cell"], 100, "ordinal", "u").select(F.size("held").alias("n")).collect()
    assert sum(r.n for r in blocks) == 5000 and max(r.n for r in blocks) <= 200


def test_expressions_of_a_file_in_pieces(tmp_path, monkeypatch):
    """The same as of the whole text, for every size of a piece."""
    texts = ["", "a\r\nb\rc\n\n d \x0be\u2028f", "<expr> a\n</EXPR>x<Expr></expr><expr>b<expr>ü</expr> <expr>open", "<expr></expr>\nline", "</expr><ex<expr>1</expr></expr><expr>2</ex</expr>"]
    for text in texts:
        (tmp_path / "t").write_bytes(text.encode())
        for size in (1, 2, 3, 5, 7, 1000):
            monkeypatch.setattr(candidate_source, "CHUNK", size)
            assert tuple(candidate_source.file_expressions(str(tmp_path / "t"))) == expressions_in(text), (text, size)


def test_a_large_file_is_not_held_whole(tmp_path):
    with open(tmp_path / "t", "w") as f:
        for k in range(400_000):
            f.write(f"<expr>ts_mean(crypto.close({k}))</expr>\n")
    tracemalloc.start()
    assert sum(1 for _ in candidate_source.file_expressions(str(tmp_path / "t"))) == 400_000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 << 20 < (tmp_path / "t").stat().st_size


def test_correlations_read_their_rows_once(spark):
    """Tasks whose values are far apart have centres of their own."""
    read = spark.sparkContext.accumulator(0)

    def values(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rng = random.Random(3)
    rows = [[1e6 * (k // 100) + rng.gauss(0, 1), 1e6 * (k // 100) + rng.gauss(0, 1), None if k < 250 else 1e9 + 1e-3 * rng.gauss(0, 1), rng.gauss(0, 1)] for k in range(400)]
    df = spark.createDataFrame(spark.sparkContext.parallelize([(r,) for r in rows], 4), "x array<double>").mapInArrow(values, "x array<double>")
    got = {(r.a, r.b): r.corr for r in pooled_pearson(df, "x", 4).collect()}
    assert read.value == 400
    for (a, b), corr in got.items():
        met = [(r[a], r[b]) for r in rows if r[a] is not None and r[b] is not None]
        assert corr == pytest.approx(statistics.correlation(*zip(*met)), abs=1e-6), (a, b)
    assert len(got) == 6


def test_compared_approaches_share_their_factors(spark):
    """The panel is read for its days, its assets and its factors, not again for each approach."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rng = random.Random(11)
    names = ("open", "high", "low", "close", "volume", "returns")
    rows = [(f"a{a}", datetime(2024, 1, 1) + timedelta(days=d), *(rng.uniform(1, 2) for _ in names)) for a in range(9) for d in range(20)]
    schema = "asset string, ts timestamp_ntz, " + ", ".join(f"{n} double" for n in names)
    panel = spark.createDataFrame(rows, schema)
    approaches = {n: C.GENERATORS[n] for n in ("expansion", "refinement")}
    found = C.compare_approaches(panel.mapInArrow(count, schema), approaches, count=6, min_history=5)
    assert read.value <= 3 * len(rows)
    for r in found.values():  # the same as each on its own
        alone = C.compare_approaches(panel, {r["approach"]: approaches[r["approach"]]}, count=6, min_history=5)[r["approach"]]
        assert alone == r and r["selected"] and r["test"]["valid_times"] > 0
