"""Packing, prefix tries and periodic runs against plain versions."""

import hashlib
import random
import zlib

import brute as B
import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import periodic_runs as R
from factorloom.llm import queries as Q
from factorloom.llm.packing import Encoder, Packer, pack_documents
from factorloom.llm.periodic_runs import find_runs, plant_period, strongest
from factorloom.llm.prefix_trie import build_trie, number_turns, share_openings

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

ODD = [
    (0, None, "a", 0),
    (1, "", "a", 0),
    (2, "a " * 5000, None, 0),
    (2, "a " * 5000, None, 0),
    (None, "one two three <|endoftext|> four", "b", 0),
    (5, "x y\tz\n" * 40 + "end\x0b\x0c and  more" + "é日本語 😀" * 30, "b", 0),
    (6, " ".join(str(k * k % 97) for k in range(4000)), "a", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Two columns clash with names of results; the text is in a column of another name as well."""
    return spark.createDataFrame(ODD, "doc_id long, text string, runs string, length int")


# Packing ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def byte_bpe():
    return public.path("byte_bpe_50k.json")


def library_ids(path, texts):
    lib = tokenizers.Tokenizer.from_file(path)
    return [[*lib.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def check_packing(pieces, docs, most=1024):
    """Every id in one piece, no holes in sequences, no padding but at powers of two."""
    for i, ids in docs.items():
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert bytes(p.ids) == np.array(ids[at : at + p.length], "<u4").tobytes()
            at += p.length
        assert at == len(ids)
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sequences.get(p.sequence_id, 0) and p.length > 0
        sequences[p.sequence_id] = p.offset + p.length
    assert all(n == most or n < most and (n & (n - 1)) == 0 for n in sequences.values())


def test_packed_documents(spark, sf, byte_bpe):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    pieces = pack_documents(docs.repartition(3), byte_bpe, 1024).collect()
    check_packing(pieces, dict(zip([r.doc_id for r in rows], library_ids(byte_bpe, [r.text for r in rows]))))
    got = {(p.doc_id, p.start): p.ids_crc32 for p in Q.op11(spark, sf).collect()}
    ids = dict(zip([r.doc_id for r in rows], library_ids(byte_bpe, [r.text for r in rows])))
    for p in Q.op11(spark, sf).collect():
        assert got[p.doc_id, p.start] == p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())


@pytest.mark.parametrize("most_open", [2, 4096])
@pytest.mark.parametrize("length", [1, 3, 1024])
def test_packing_of_odd_rows(spark, odd, byte_bpe, length, most_open):
    one = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r.text for r in one.collect()}
    pieces = pack_documents(one, byte_bpe, length, most_open=most_open).collect()
    check_packing(pieces, dict(zip(rows, library_ids(byte_bpe, rows.values()))), length)
    repeated = pack_documents(odd, byte_bpe, length, most_open=most_open)
    total = sum(len(x) for x in library_ids(byte_bpe, [r[1] for r in ODD]))
    assert repeated.agg(F.sum("length")).first()[0] == total
    assert repeated.where("doc_id is null").agg(F.sum("length")).first()[0] == len(library_ids(byte_bpe, [ODD[4][1]])[0])


def test_packing_of_nothing(spark, odd, byte_bpe):
    assert pack_documents(odd.limit(0), byte_bpe).count() == 0
    kept = pack_documents(odd, byte_bpe, keep=["runs", "length"])
    assert kept.columns == ["runs", "length", "start", "ids", "doc_tokens", "sequence_id", "offset"]


def test_pieces_go_to_the_level_of_least_squares():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(2, 12)
        done = []
        p = Packer(n, done.append)
        levels = [0] * (n + 1)
        for _ in range(40):
            s = rng.randint(1, n - 1)
            costs = {}
            for h in range(n - s + 1):
                if h == 0 or levels[h]:
                    after = levels.copy()
                    after[h] -= h > 0
                    after[h + s] += 1
                    costs[h] = sum(x * x for x in after[1:n])
            want = max(h for h in costs if costs[h] == min(costs.values()))
            assert p.level_for(s) == want
            levels[want] -= want > 0
            levels[want + s] += want + s < n
            p.add(0, np.zeros(s, "<u4"))
            assert p.levels[1:n].tolist() == levels[1:n]


def test_both_encoders_agree(byte_bpe):
    e = Encoder(byte_bpe)
    assert e.fast is not None
    texts = ["", "a", "don't  stop\n\n now ", "<|endoftext|>x<|endoftext|>", "héllo wörld 12345 日本語   😀👍🏽", "\x00\x01\t  \r\n", "x" * 5000, " " * 300]
    rng = random.Random(5)
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(128, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(60)) for _ in range(200)]
    assert [[*e(t).tolist(), 0] for t in texts] == library_ids(byte_bpe, texts)
    slow = Encoder(public.path("word_bpe_49k.json"))
    assert slow.fast is None
    assert [[*slow(t).tolist(), 0] for t in texts[:8]] == library_ids(public.path("word_bpe_49k.json"), texts[:8])


# Prefix trie --------------------------------------------------------------------


def trie_rows(df):
    return sorted(tuple(r[c] for c in B.TRIE_COLUMNS) for r in df.collect())


def test_trie(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(Q.op12(spark, sf)) == B.trie(B.reopened(rows))


def test_trie_of_odd_rows(spark):
    rng = random.Random(11)
    ids = [*range(0, 30), 100, 101, 104, 207, 333, 2**40, 2**40 + 1]
    rows = []
    for c in ids:
        for k in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([None, k, k, 0]), rng.choice([None, "", "user"]), rng.choice([None, "", "hi", "hi", "x\ny"])))
    rows += [(None, 1, "user", "lost"), (50, 600, "a", "b"), (50, 5, "a", "c"), (50, None, None, None), (51, 5, "a", "c"), (51, 5, "a", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert trie_rows(build_trie(*share_openings(number_turns(df)))) == B.trie(B.reopened(rows))


def test_trie_of_copies_and_of_nothing(spark):
    turns = spark.createDataFrame([(c, p, "user", t) for c in range(600) for p, t in ((1, "same"), (2, "again"), (3, str(c // 200)))], "conv_id long, pos long, role string, text string")
    convs = spark.range(-3, 600).withColumnRenamed("id", "conv_id")
    got = trie_rows(build_trie(turns, convs))
    plain = {c: [("user", "same"), ("user", "again"), ("user", str(c // 200))] for c in range(600)} | {c: [] for c in (-3, -2, -1)}
    assert got == B.trie(plain)
    one = trie_rows(build_trie(turns.where("conv_id = 7"), convs.where("conv_id = 7")))
    assert [r[:3] for r in one] == [(7, 0, None), (7, 1, 7), (7, 2, 7), (7, 3, 7)]
    assert trie_rows(build_trie(turns.limit(0), convs.limit(0))) == []
    assert trie_rows(build_trie(turns.limit(0), convs.limit(2))) == [(-3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"-3,-2").hexdigest())]


# Periodic runs ------------------------------------------------------------------


def random_words(rng, n, kinds):
    out = []
    while len(out) < n:
        part = [rng.randint(0, kinds) for _ in range(rng.randint(1, 10))]
        out += part * (rng.randint(1, 9) if rng.random() < 0.4 else 1)
    return out[:n]


@pytest.mark.parametrize("cost", [1e-9, 1.0, 1e9])
@pytest.mark.parametrize("least,times", [(24, 3), (2, 2), (7, 4)])
def test_runs_of_random_words(monkeypatch, cost, least, times):
    """All words rare, all frequent, and as it is."""
    monkeypatch.setattr(R, "PAIR_COST", cost)
    rng = random.Random(17)
    for _ in range(120):
        docs = [random_words(rng, rng.choice([0, 1, 2, 24, 40, 150]), rng.choice([0, 1, 2, 20])) for _ in range(rng.randint(0, 4))]
        offs = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
        words = np.array([w for d in docs for w in d], np.uint64)
        counts, base = R.lag_counts(words, offs, times)
        for k, d in enumerate(docs):
            mine = counts[base[k] : base[k + 1]].copy()
            assert mine[1:].tolist() == [sum(d[i] == d[i + q] for i in range(len(d) - q)) for q in range(1, len(d) // times + 1)]
            assert R.runs_of(words[offs[k] : offs[k + 1]], mine, least, times) == B.runs(d, least, times)


def run_rows(df):
    return {tuple(r) for r in df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}


def test_runs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert run_rows(Q.op13(spark, sf)) == {B.periodic(r.doc_id, r.text) for r in docs}


def test_runs_of_odd_rows(spark, odd, tmp_path):
    found = find_runs(odd)
    assert found.columns == ["doc_id", "text", "length", "n_words", "runs", "collapsed"]
    for r in found.collect():
        words = B.words(r.text)
        assert [tuple(x) for x in r.runs] == B.runs(words) and r.n_words == len(words)
        assert r.collapsed == B.collapsed(words, B.runs(words))
    assert find_runs(odd.limit(0)).count() == 0
    odd.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((B.periodic(r[0], r[1]) for r in ODD), key=repr)
    assert sorted((tuple(r) for r in Q.op13(spark, str(tmp_path)).collect()), key=repr) == want
    with pytest.raises(ValueError):
        find_runs(odd, times=1)


def test_ties_of_the_strongest_run(spark):
    cases = [[], [(0, 30, 1), (50, 60, 2)], [(0, 24, 2), (30, 36, 3), (70, 25, 2)], [(0, 2**40, 3), (1, 2**40 + 3, 3)]]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k long, runs array<struct<start:long,length:long,period:long>>")
    got = {r.k: r.b and tuple(r.b) for r in df.select("k", strongest(F.col("runs")).alias("b")).collect()}
    assert got == {0: None, 1: (0, 30, 1), 2: (70, 25, 2), 3: (1, 2**40 + 3, 3)}


def test_planted_periods(spark):
    rows = [(c, " ".join(str(k) for k in range(n))) for c in range(60) for n in (0, 1, 2, 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.t) for r in df.select("*", plant_period(F.col("text"), F.col("doc_id")).alias("t")).collect())
    for i, text, t in got:
        assert t.split() == B.planted(i, B.words(text))
