"""Each stage and the whole pipeline against plain Python, on small and on odd tables."""

from collections import Counter

import brute as B
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from factorloom.llm import _store

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _read(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def _plain(rows, items):
    """The stages after the quality rules, whose outlier verdict has its own tests."""
    parts = B.components([r[:2] for r in rows], 5, 80)
    first = {}
    for k, (r, (n, c)) in enumerate(zip(rows, parts)):
        if n and (c not in first or (r[0] if r[0] is not None else 2**63) < (rows[first[c]][0] if rows[first[c]][0] is not None else 2**63)):
            first[c] = k
    rows = [r for k, r in enumerate(rows) if parts[k][0] == 0 or first[parts[k][1]] == k]
    gone = B.repeats([r[1] for r in rows])
    every = Counter(tuple(w[k : k + 35]) for w in (B.words(r[1]) for r in rows) for k in range(len(w) - 34))
    rows = [r if len(w) == n else (r[0], t := B.cut(r[1], 35, every), r[2], r[3], len(t)) for r, (n, w) in zip(rows, gone) if w or n == 0]
    rows = [r for r in rows if not B.contamination(r[1], items)[3]]
    mix = B.mixture([(r[0], r[3], r[1]) for r in rows])
    return [(*r, len(B.words(r[1])), *mix[r[0], r[3], len(B.words(r[1]))]) for r in rows]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in P.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "mixing"]
    kept, _ = _store.materialise(P.STAGES[0][1](spark, docs, sf), "t0")
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    failed = {r["doc_id"] for r in docs.collect() if B.quality(r["text"])[-1]}
    assert not failed & {r["doc_id"] for r in kept.collect()}
    want = {r[0]: r for r in _plain([tuple(r) for r in kept.collect()], items)}
    now = kept
    for k, (name, stage) in enumerate(P.STAGES[1:]):
        now, _ = _store.materialise(stage(spark, now, sf), f"t{k}")
        if k < 3:
            assert now.columns == docs.columns
    got = {r["doc_id"]: tuple(r) for r in now.collect()}
    taken = {i: r for i, r in want.items() if r[-1] > 0}
    assert set(got) == set(taken)
    for i, r in got.items():
        assert r[:7] == taken[i][:7] and r[7] == pytest.approx(taken[i][7]) and r[8] == taken[i][8]
    assert _read(P.run(spark, sf)) == _read(now)


def test_stages_take_odd_rows(spark, sf):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, words, None, "a", 5), (3, words, None, "a", 5), (None, words + " end", "en", None, 5), (4, "x" * 300000, "en", "a", 5)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for table in (docs, docs.limit(0)):
        for _, stage in P.STAGES[:4]:
            assert stage(spark, table, sf).columns == docs.columns
            stage(spark, table, sf).count()
        assert P.STAGES[4][1](spark, table, sf).count() <= table.count() + 2
    assert P.STAGES[1][1](spark, docs, sf).where(F.col("doc_id") == 3).count() == 1


def test_scratch_is_removed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = P.STAGES[2][1](spark, docs, sf)
    n = first.count()
    old = list(_store._tagged["pipeline"])
    P.STAGES[3][1](spark, first, sf)  # reads the first stage's tables: they stay
    assert set(old) <= set(_store._tagged["pipeline"]) and first.count() == n
    P.STAGES[3][1](spark, docs, sf)
    assert not set(old) & set(_store._tagged.get("pipeline", []))
