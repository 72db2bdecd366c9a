import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F
from test_scoring import coins, rising

from factorloom.operators import candidates as C
from factorloom.operators import ingest
from factorloom.plans import registry
from factorloom.sources import files, panels
from factorloom.sources.candidate_source import read_candidates
from factorloom.sources.versioned import VersionedTable

SCENARIO = C.Scenario.of(registry.CROSS_SECTION, "crypto", 1)
TASK = C.Task("last(crypto.close(1))", 0.1, SCENARIO, C.Period("2024-01-01", "2024-01-06"), SCENARIO.objective)


def test_requests():
    r = C.refine("Find cross-sectional crypto factors, 5d ahead")
    assert (r.space, r.price, r.scenario.benchmark, r.scenario.horizon) == ("crypto", "close", registry.CROSS_SECTION, 5)
    assert C.refine("TAQ order imbalance").scenario.benchmark == registry.INTRADAY
    assert C.refine("predict AAPL tomorrow").space == "crsp" and C.refine("rank stocks 300 10").scenario.horizon == 10
    with pytest.raises(ValueError):
        C.refine("  ")


def test_extraction(spark):
    text = "x <expr> a </expr>\n<EXPR>b\nc</EXPR><expr></expr>"
    assert C.expressions_in(text) == ("a", "b\nc") and C.expressions_in(" one \n\n two") == ("one", "two") and C.expressions_in("") == ()
    df = spark.createDataFrame([(0, text), (1, " one \n\n two"), (2, ""), (3, None)], "ordinal int, text string")
    assert [(r["ordinal"], r["expr"]) for r in C.extract_expressions(df).orderBy("ordinal", "place").collect()] == [(0, "a"), (0, "b\nc"), (1, "one"), (1, "two")]


def test_pool(spark):
    exprs = ["add(last(crypto.close(1)), last(crypto.open(1)))", "add(last(crypto.open(1)), last(crypto.close(1)))", "bad", "last(crypto.high(1))", "last(crypto.low(1))"]
    scores = {exprs[0]: 0.6, exprs[1]: 0.8, exprs[3]: 0.4, exprs[4]: float("nan")}
    assert [s.expr for s in C.seed_pool(exprs, scores)] == [exprs[1], exprs[3], exprs[4]]
    assert [s.expr for s in C.seed_pool(exprs, scores, threshold=0.5, top_k=1)] == [exprs[1]]
    rows = [(r["ordinal"], r["expr"], r["valid"], r["signature"], None if (s := scores.get(r["expr"], 0.0)) != s else s) for r in C.realize_all(spark, exprs).collect()]
    df = spark.createDataFrame(rows, "ordinal int, expr string, valid boolean, signature string, score double")
    assert [r["expr"] for r in C.pool_frame(df).collect()] == [exprs[1], exprs[3], exprs[4]]


def test_windows():
    two = C.time_windows("2020-01-01", "2020-12-31", 2)
    assert two[0].start == "2020-01-01" and two[1].end == "2020-12-31" and two[0].end < two[1].start
    for bad in (("2020-01-01", "2020-12-31", 0), ("2020-02-01", "2020-01-01", 2)):
        with pytest.raises(ValueError):
            C.time_windows(*bad)
    days = [date(2024, 1, k) for k in range(1, 11)]
    assert C.split_days(days)[1].start == "2024-01-09" and len(C.row_windows(days, 3)) == 3 and C.row_windows(days, 5, 3) == ()
    assert len(C.task_bank([C.Seed("a", 1.0, "s"), C.Seed("b", 0.5, "t")], SCENARIO, two)) == 4


def test_rewards_and_archive(tmp_path, spark):
    w = C.RewardWeights(diversity=0.1, complementarity=0.1)
    assert C.reward_of(0.4, False, 0.0, w) == pytest.approx(0.6)
    assert C.reward_of(-1.0, False, 0.0) == pytest.approx(-0.9) and C.reward_of(5.0, False, 0.0) == 1.0
    a = C.Archive()
    r = C.realize("last(crypto.close(1))")
    assert a.offer(r, 0.4, 0.6, {"x": 1.0, "y": 2.0, "z": 4.0}, {}) and not a.offer(r, 0.4, 0.6, {}, {})
    assert not a.offer(C.realize("last(crypto.open(1))"), -0.1, 0.6, {}, {}) and r.signature in a
    assert a.closest({"x": 2.0, "y": 4.0, "z": 8.0}) == pytest.approx(1.0) and a.closest({"x": 2.0}) == 0.0
    a.save(spark, f"{tmp_path}/deep/a.jsonl")
    assert C.Archive.load(spark, f"{tmp_path}/deep/a.jsonl").records == a.records and C.Archive.load(spark, f"{tmp_path}/none").records == []

    files.write_archive(a.frame(spark).withColumn("task", F.lit("{}")), str(tmp_path / "table"))
    assert files.read_archive(spark, str(tmp_path / "table")).first()["metrics"] == {"x": 1.0, "y": 2.0, "z": 4.0}


def test_discovery(spark):
    panel = coins(spark, rising(8))
    archive = C.Archive()
    made = C.discover(panel, TASK, "crypto", "close", lambda *_: ["last(crypto.close(1))", "bad(", "last(crypto.close(1))", "last(crypto.high(1))"], archive=archive)
    assert [o.valid for o in made] == [True, False, True] and made[0].stored and made[1].reason
    again = C.discover(panel, TASK, "crypto", "close", lambda *_: ["last(crypto.close(1))"], archive=archive)
    assert again[0].components["duplicate"] == 1.0 and again[0].reward < made[0].reward and not again[0].stored


def test_completions(spark):
    panel = coins(spark, rising(3))
    done = C.reward_completions(panel, ["<expr>last(crypto.close(1))</expr>", "", "<expr>nope</expr>"], TASK, "crypto", "close")
    assert done[0].reward == pytest.approx(-0.9) and done[0].valid and [d.reward for d in done[1:]] == [-1.0, -1.0]
    assert done[1].reason == "no expression found"


def test_seed_bank_and_prompts(spark):
    bank = C.seed_bank(coins(spark, rising(8)), SCENARIO, "crypto", "close", C.time_windows("2024-01-01", "2024-01-06", 2), ["last(crypto.close(1))", "last(crsp.dlyret(1))"])
    assert (bank.raw_count, bank.scored_count, len(bank.tasks)) == (2, 1, 2)
    rows = C.prompt_rows(spark, bank.tasks, "crypto", 2)
    assert rows.count() == 4 and rows.first()["prompt"][0]["role"] == "system" and "allowed fields" in rows.first()["prompt"][1]["content"].lower()


def test_generators():
    t = ("ts_mean(crypto.close(7))", "ts_mean(crypto.close(20))")
    assert C.mutations(t, 3) == tuple(f"ts_mean(crypto.close({k}))" for k in (5, 7, 10))
    assert C.refinements(t, 6)[:3] == (t[0], f"tanh({t[0]})", f"zscore({t[0]})") and len(C.refinements(t, 6)) == 6
    assert C.expansions(t, 4)[2].startswith("div(") and C.expansions(t, 0) == ()


def test_gate_and_rollout(spark):
    from factorloom.operators import acceptance as A

    panel = coins(spark, rising(8, 20))
    jobs = A.acceptance_tasks(panel, C.Seed("last(crypto.close(1))", 0.1, ""), min_history=2)
    assert [j[0].scenario.benchmark for j in jobs] == [registry.CROSS_SECTION] * 3 + [registry.DIRECTION] * 2
    assert jobs[0][1].select("ts").distinct().count() == 4 and jobs[4][1].select("asset").distinct().count() == 1
    with pytest.raises(ValueError):
        A.acceptance_tasks(panel, C.Seed("x", 0.0, ""), min_history=4)
    texts = ["<expr>last(crypto.close(1))</expr>", "<expr>neg(crypto.close(1))</expr>", "junk"]
    gate = A.reward_gate(jobs, lambda t, k: texts, min_history=2)
    assert gate["varying"] >= 3 and gate["all_invalid"] == 0 and gate["passed"]
    assert not A.reward_gate(jobs[:1], lambda t, k: ["junk"], min_history=2)["passed"]
    assert A.sweep(panel, ["last(crypto.close(1))", "neg(crypto.close(1))"], min_history=2)["passed"]
    bank, rows = A.rollout(panel, "crypto cross-sectional", lambda *_: ["last(crypto.low(1))", "bad("], ["last(crypto.close(1))"], min_history=2)
    assert len(bank.tasks) == 1 and [r["valid"] for r in rows] == [True, False]


def test_direction_is_that_of_one_asset(spark):
    rows = [(a, f"2024-01-{d:02d} 00:00:00", 1.0 + d * (1 if a == "x" else -1) / 100) for a in "xy" for d in range(1, 9)]
    panel = spark.createDataFrame(rows, "asset string, ts string, close double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    scenario = C.Scenario.of(registry.DIRECTION, "crypto", 1)
    with pytest.raises(ValueError):
        C.score_all(panel, ["last(crypto.close(1))"], scenario, "crypto", "close")
    one = panel.where("asset = 'x'")
    assert C.score_all(one, ["last(crypto.close(1))"], scenario, "crypto", "close")["last(crypto.close(1))"]["score"] == 1.0
    short = C.score_all(one, ["last(crypto.close(1))"], scenario, "crypto", "close", min_history=50)
    assert short == {"last(crypto.close(1))": {"score": None, "dir_acc": None, "ic": None, "rank_ic": None, "samples": 0}}


def test_templates_are_valid():
    for name in registry.surface_names():
        assert all(C.realize(t).valid for t in registry.templates(name)), name


def test_rewards_against_an_archive_in_blocks(spark):
    """The blocks give what the archive gives record by record."""
    names, draw = ("score", "x", "y", "z", "w"), random.Random(5)
    profile = lambda: {n: draw.choice([draw.uniform(-2, 2), draw.uniform(-2, 2), None, float("inf"), 1.0]) for n in draw.sample(names, draw.randint(0, 5))}
    held = [C.Record(f"e{i}", f"s{i}", 0.0, 0.0, profile()) for i in range(23)]
    rows = [(i, f"c{i}", f"s{i}" if i % 3 == 0 else f"n{i}", i % 5 > 0, 0.1, profile() if i % 7 else None) for i in range(20)]
    given = spark.createDataFrame(rows, "ordinal int, expr string, signature string, valid boolean, score double, metrics map<string,double>")
    archive = C.Archive(held)
    for some, frame in ((archive, archive.frame(spark)), (C.Archive(), C.Archive().frame(spark))):
        for block in (4, 1024):
            got = {r["ordinal"]: r for r in C.reward_batch(given, frame, block=block).collect()}
            assert len(got) == len(rows)
            for ordinal, _, signature, valid, score, metrics in rows:
                closest = some.closest(metrics or {})
                assert got[ordinal]["closest"] == pytest.approx(closest, abs=1e-9)
                assert got[ordinal]["duplicate"] == (signature in some)
                assert got[ordinal]["reward"] == pytest.approx(C.reward_of(score, signature in some, closest) if valid else -1.0, abs=1e-9)


def test_a_table_of_candidates(spark):
    texts = ["last(crypto.close(1))", " last( crypto.close(1) ) ", "bad(", None, "", "add(last(crypto.open(1)), last(crypto.low(1)))", "last(crypto.close(0))"] * 20
    df = spark.createDataFrame([(i, t, i * 2, "mine") for i, t in enumerate(texts)], "ordinal int, expr string, other int, reason string").repartition(3)
    for cache in (1, 50_000):
        got = C.realize_table(df, cache=cache)
        assert got.columns == ["ordinal", "other", "expr", "valid", "signature", "reason"]
        for r in got.collect():
            want = C.realize(texts[r.ordinal]) if texts[r.ordinal] is not None else C.Realized("", False, reason="no expression")
            assert (r.expr, r.valid, r.signature, r.reason) == (want.expr, want.valid, want.signature, want.reason) and r.other == 2 * r.ordinal


def test_a_table_of_completions(spark):
    panel = coins(spark, rising(8))
    texts = ["<expr>last(crypto.close(1))</expr>", "", "<expr>nope</expr>", "junk", "<expr>last( crypto.close(1) )</expr> <expr>x</expr>", "neg(last(crypto.high(1)))"]
    completions = spark.createDataFrame(list(enumerate(texts)), "ordinal int, text string")
    held = C.Record("last(crypto.low(1))", C.realize("last(crypto.low(1))").signature, 0.1, 0.1, {"score": 0.3, "valid_times": 4.0, "mean_assets": 8.0})
    got = {r.ordinal: r for r in C.reward_table(panel, completions, C.Archive([held]).frame(spark), SCENARIO, "crypto", "close", batch=1).collect()}
    for i, text in enumerate(texts):
        want = C.reward_completions(panel, [text], TASK, "crypto", "close", C.Archive([held]), min_score=9.0)[0]
        assert (got[i].expr, got[i].valid, got[i].signature) == (want.expr, want.valid, want.signature)
        assert got[i].score == pytest.approx(want.score) and got[i].reward == pytest.approx(want.reward) and (got[i].reason == want.reason)


def test_prompts_of_a_table(spark):
    tasks = C.task_bank([C.Seed("add({start}, \x00end\x00)", 0.25, "s"), C.Seed("b", -1.0, "t")], SCENARIO, C.time_windows("2020-01-01", "2020-12-31", 2))
    frame = C.task_bank_frame(spark.createDataFrame([("add({start}, \x00end\x00)", 0.25), ("b", -1.0)], "expr string, score double"), C.time_windows("2020-01-01", "2020-12-31", 2))
    got = sorted([(m["role"], m["content"]) for m in r.prompt] for r in C.prompt_frame(frame, SCENARIO, "crypto", 2, count=3).collect())
    assert got == sorted([(m["role"], m["content"]) for m in C.messages(t, "crypto", 3)] for t in tasks for _ in range(2))
    assert C.task_bank_frame(frame.select("expr"), []).count() == 0


def test_horizons():
    cases = {"5d": 5, "a 10-d b": 10, "300 7": 7, "0 0d 3": 0, "x5d": 1, "12 days": 12, "253": 1, "252": 252, "": 1, "1000d": 1000}
    assert {t: C.horizon_in(t) for t in cases} == cases


def test_rewards_are_kept_once(spark, tmp_path):
    archive, log = (VersionedTable(spark, f"{tmp_path}/{n}") for n in ("archive", "log"))
    row = lambda i, s, valid, score, reward, dup=False: (i, f"e{i}", s, score, reward, {"x": score}, valid, dup, 0.0)
    schema = "ordinal int, expr string, signature string, score double, reward double, metrics map<string,double>, valid boolean, duplicate boolean, closest double"
    batch = spark.createDataFrame([row(0, "a", True, 0.5, 0.5), row(1, "a", True, 0.9, 0.9), row(2, "b", True, -0.1, 0.5), row(3, "c", True, 0.5, 0.5, True), row(4, "", False, -1.0, -1.0), row(5, "d", True, float("nan"), float("nan"))], schema)
    for _ in range(2):
        C.store_rewards(batch, archive, log, number=0)
        assert [(r.signature, r.expr) for r in archive.read().collect()] == [("a", "e0")] and log.read().count() == 6
    C.store_rewards(batch.withColumn("signature", F.concat("signature", F.lit("2"))).unionByName(batch), archive, log, number=1)
    assert sorted(r.signature for r in archive.read().collect()) == ["a", "a2"] and log.read().count() == 18


def test_one_asset_seed_bank(spark):
    panel = coins(spark, rising(3, 20))
    bank = C.asset_seed_bank(panel, panel.first()["asset"], "crypto", "close", [C.Period("2024-01-01", "2024-01-06")], ["last(crypto.close(1))", "neg(crypto.close(1))", "last(crsp.dlyret(1))"], start="2024-01-02", end="2024-01-15")
    assert bank.scenario.benchmark == registry.DIRECTION and [s.expr for s in bank.seeds] == ["last(crypto.close(1))", "neg(crypto.close(1))"]
    assert (bank.raw_count, bank.scored_count, len(bank.tasks)) == (3, 2, 2)


def test_candidate_sources(spark, tmp_path):
    def made(number):
        return [f"<expr>last(crypto.close({number + 1}))</expr>", "plain line\nother"]

    got = lambda **o: sorted(tuple(r) for r in read_candidates(spark, **o).collect())
    templates = registry.templates(registry.CROSS_SECTION)
    assert [(r[2], r[3]) for r in got(kind="template")] == list(enumerate(templates))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("<expr>x</expr> <EXPR>y\n</EXPR>")
    (tmp_path / "in" / "b.txt").write_text(" one \n\ntwo")
    (tmp_path / "in" / "c.txt").write_text("")
    folder = got(kind="file", path=f"{tmp_path}/in")
    assert [(r[1].rpartition("/")[2], r[2], r[3]) for r in folder] == [("a.txt", 0, "x"), ("a.txt", 1, "y"), ("b.txt", 0, "one"), ("b.txt", 1, "two")]
    assert [r[3] for r in got(kind="file", path=f"file://{tmp_path}/in/b.txt")] == ["one", "two"]
    df = read_candidates(spark, "function", make=made, partitions=3)
    assert df.rdd.getNumPartitions() == 3 and df.count() == 9 and {r.source for r in df.collect()} == {"function"}
    for bad in ({"kind": "file"}, {"kind": "file", "path": f"{tmp_path}/none"}, {"kind": "function"}, {"kind": "web"}):
        with pytest.raises(ValueError):
            read_candidates(spark, **bad)


def test_files_and_panels(spark, tmp_path):
    files.write_report(spark, {"b": 1, "a": [2]}, f"{tmp_path}/deep/report.json")
    assert json.loads((tmp_path / "deep" / "report.json").read_text()) == {"a": [2], "b": 1}
    for kind in ("csv", "json"):
        files.write_table(spark.createDataFrame([(1, "x")], "k int, v string"), f"{tmp_path}/{kind}", kind)
        back = spark.read.option("header", True).csv(f"{tmp_path}/csv") if kind == "csv" else spark.read.json(f"{tmp_path}/json")
        assert back.first()["v"] == "x"
    (tmp_path / "t.txt").write_text("two\nlines")
    assert files.read_texts(spark, f"{tmp_path}/t.txt").first().text == "two\nlines"
    panel = coins(spark, rising(2))
    panels.write_panel(panel, f"{tmp_path}/panel")
    back = panels.read_panel(spark, f"{tmp_path}/panel", "crypto")
    assert back.count() == panel.count() and {r.asset for r in back.select("asset").distinct().collect()} == {r.asset for r in panel.select("asset").distinct().collect()}
    assert spark.createDataFrame([("BRK.B/x:y",)], "s string").select(panels.file_safe(F.col("s"))).first()[0] == "BRK_B_x_y"
    bars = spark.createDataFrame([("AA", 1.0)], "symbol string, close double")
    assert ingest.bars_panel(bars).columns == ["asset", "close"]
    from factorloom.operators.acceptance import report_rows

    result = {"one": {"approach": "one", "candidates": 3, "usable": 2, "selected": ("a", "b"), "validation": {"ic": 0.5}, "test": {"ic": None}}}
    assert report_rows(result) == [{"approach": "one", "candidates": 3, "usable": 2, "selected_count": 2, "validation_ic": 0.5, "test_ic": None}]


def test_daily_samples(spark):
    rows = spark.createDataFrame([(k, date(2024, 1, d)) for k in (9, 7, 8) for d in (5, 3, 4)], "permno int, dlycaldt date")
    assert [tuple(r) for r in ingest.one_asset(rows, 9, "2024-01-04", "2024-01-05").collect()] == [(9, date(2024, 1, 4)), (9, date(2024, 1, 5))]
    assert [tuple(r) for r in ingest.first_asset(rows).collect()] == [(7, date(2024, 1, d)) for d in (3, 4, 5)]
    assert ingest.first_asset(rows.drop("permno")).count() == 9 and ingest.first_asset(rows.limit(0)).count() == 0


def test_descriptions(spark):
    cases = {
        "corr(crypto.close(5), crsp.dlyclose(9))": ("scalar", "", ["crsp.dlyclose", "crypto.close"], ["crsp", "crypto"], 9, 1),
        "diff(crypto.close(2))": ("array", "", ["crypto.close"], ["crypto"], 2, 1),
        "1.5": ("scalar", "", [], [], None, 0),
        "abs(crypto.nothing(3))": ("array", "limit", ["crypto.nothing"], ["crypto"], 3, 1),
        "last(crypto.close(99999))": ("scalar", "limit", ["crypto.close"], ["crypto"], 99999, 1),
        "ts_mean(1)": (None, "syntax", None, None, None, None),
        "a.b": (None, "syntax", None, None, None, None),
        "lambda x: x": (None, "syntax", None, None, None, None),
        "crypto.close(1) ** 2": (None, "syntax", None, None, None, None),
        "-crypto.close(1)": (None, "syntax", None, None, None, None),
        "": (None, "syntax", None, None, None, None),
    }
    df = spark.createDataFrame([(t, "mine") for t in cases] + [(None, "mine")], "expr string, kind string").repartition(2)
    got = {r.expr: tuple(r)[1:] for r in C.describe_table(df).collect()}
    assert got == cases | {None: (None, "syntax", None, None, None, None)}
