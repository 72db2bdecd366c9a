"""Each operator against a plain version, on the driver's smallest tables and on odd rows."""

import hashlib
import random

import brute as B
import pytest
from pyspark.sql import functions as F

from factorloom.llm import _words as W
from factorloom.llm import queries as Q
from factorloom.llm.chat_format import format_trees, from_turns, masked_text, read_turns, tree_paths
from factorloom.llm.decontaminate import find_contamination, remove_contamination
from factorloom.llm.deleted_interpolation import learn_weights, score_texts
from factorloom.llm.html_text import Page, extract_text
from factorloom.llm.jaccard_join import keep_one, link_documents
from factorloom.llm.mixing import mix_sources
from factorloom.llm.quality import judge
from factorloom.llm.substring_dedup import RepeatIndex, remove_repeats
from factorloom.llm.token_counts import PrefixCounter, count_tokens
from factorloom.llm.warc import read_records, write_archive

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or for results, as columns of the caller's.
CLASHES = ["chunk", "row", "node", "bucket", "low", "hit", "at", "left", "right", "anchor", "bin", "level", "key", "path", "blocks", "n_lines", "mean_word", "round", "has.dot", "a`b"]


def _vocabulary(seed=1, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and very long texts, repeats, near copies, unusual white space."""
    rng, vocabulary = random.Random(4), _vocabulary()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, body = text(60), text(120)
    near = body.split()
    near[40] = "changed"
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "b", 0),
        (3, " \n\t\x0b\x0c\r ", "en", "b", 7),
        (4, text(3), "en", "b", 9),
        (5, text(30000), "en", "a", 9),
        (6, body, "en", "a", 9),
        (6, body, "en", "a", 9),
        (7, " ".join(near), "de", "a", 9),
        (8, body.upper(), None, "a", 9),
        (9, text(50) + "\n" + passage + " " + text(40), "en", "c", 9),
        (10, passage + " " + text(20), "en", "c", 9),
        (11, "ab cd " * 200, "en", "c", 9),
        (12, "x\x1cy z w   #*$%&|<> #a", "en", None, 9),
        (None, body, "en", "a", 9),
        (None, "Ünï ÇÖDE <|im_end|> \x00 end", "en", "d", None),
        (13, "x" * 200000, "en", "d", 9),
        (14, "same line here\nother\nsame line here\n\n\n", "en", "d", 9),
    ]
    return rows


@pytest.fixture(scope="module")
def odd_docs(spark, odd):
    df = spark.createDataFrame(odd, DOCS)
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES)).repartition(3)


def _kept_clashes(df):
    row = df.where("doc_id = 9").first()
    assert all(row[c] == f"own {c}" for c in CLASHES)


def _table(spark, sf, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


# 1 -------------------------------------------------------------------------------


def test_scores(spark, sf):
    docs = _table(spark, sf, "documents", "doc_id", "text")
    got = {r["doc_id"]: r for r in Q.QUERIES["op1_lm_scoring"](spark, sf).collect()}
    held = [0.0, 0.0]
    for (i, _), (h, n, known, train, base) in zip(docs, B.base_scores(docs)):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        if h:
            held[0] += r["score"]
            held[1] += r["base_score"]
    assert len(got) == len(docs) and held[0] > held[1]  # better than the base on texts it has not seen


@pytest.mark.parametrize("order", [1, 2, 3])
def test_the_model_is_a_distribution(spark, order):
    """Probabilities of all one-word continuations, the end and one unknown word sum to one."""
    train = spark.createDataFrame([(k, t, True) for k, t in enumerate(["a b c", "a b", "b a c c", "c a b", "a c b a"])], "doc_id long, text string, learn boolean")
    probe = ["a b " + w for w in ("a", "b", "c", "unknown")] + ["a b"]
    every = train.unionByName(spark.createDataFrame([(100 + k, t, False) for k, t in enumerate([*probe, "a"])], train.schema))
    out = {r["doc_id"]: r["score"] for r in score_texts(every, F.col("learn"), F.col("doc_id") == 3, order=order).collect()}
    single = {r["doc_id"]: r["score"] for r in score_texts(every.withColumn("text", F.when(F.col("doc_id") >= 100, F.concat("text", F.lit(" a"))).otherwise(F.col("text"))), F.col("learn"), F.col("doc_id") == 3, order=order).collect()}
    assert all(v < 0 for v in out.values()) and all(single[k] < out[k] for k in (100, 101, 102, 103))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_those_of_the_model(spark, order):
    """Every text against plain counts, EM histogram and mixture; the mixture sums to one over the vocabulary, the end and one unknown word."""
    rng, kinds = random.Random(order), [f"w{k}" for k in range(25)]
    rows = [(k, " ".join(rng.choices(kinds, [1 / (i + 1) for i in range(25)], k=rng.choice([0, 1, 2, 7, 30]))), k % 5) for k in range(150)] + [(200, "new words w0 here", 0), (201, None, 1), (202, "W0 w1 W2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part long").repartition(4)
    got = {r.doc_id: r.score for r in score_texts(docs, F.col("part") != 0, F.col("part") == 2, order=order).collect()}
    model = B.Interpolated([(t, 0 if p == 0 else 2 if p == 2 else 1) for _, t, p in rows], order, learn_weights)
    for k, t, _ in rows:
        assert got[k] == pytest.approx(model.score(t), rel=1e-9), k
    words = [w for (w,) in model.counts[0]]
    for context in ([], ["w0"], ["w0", "w1"], ["w3", "w0", "w0"], ["unseen"], ["w1", "unseen"]):
        total = sum(model.probability([*context, w], len(context)) for w in [*words, "unseen"])
        assert total == pytest.approx(1.0, abs=1e-9), context


def test_the_query_uses_trigrams(spark, sf):
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: r["score"] for r in score_texts(docs, training=part != 2, fold=part == 3, order=3).collect()}
    got = {r["doc_id"]: r["score"] for r in Q.QUERIES["op1_lm_scoring"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_weights_follow_the_held_out_counts():
    sure = learn_weights([(5, 0, 1000)], 1, 1e-6)
    assert sure[0, 5] > 0.99
    never = learn_weights([(5, 48, 1000)], 1, 1e-3)
    assert never[0, 5] < 0.01


def test_scores_of_odd_rows(spark, odd, odd_docs):
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    got = score_texts(odd_docs, part != 2, part == 3)
    _kept_clashes(got)
    want = [(i, n, k, t, round(b, 6)) for (i, *_), (_, n, k, t, b) in zip(odd, B.base_scores([r[:2] for r in odd]))]
    assert _sorted(tuple(r) for r in got.select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)).collect()) == _sorted(want)
    assert score_texts(odd_docs.limit(0), part != 2, part == 3).count() == 0
    none = score_texts(odd_docs, F.lit(False), F.lit(False))
    assert none.where("score = 0 and n_known = 0 and train_tokens = 0").count() == len(odd)  # one unknown word is all there is


# 2 -------------------------------------------------------------------------------


def test_archives(spark, sf):
    got = [tuple(r) for r in Q.QUERIES["op2_warc_round_trip"](spark, sf).collect()]
    assert _sorted(got) == _sorted(B.warc(_table(spark, sf, "pages", "page_id", "html")))


def test_archives_of_odd_rows(spark):
    rows = [(1, "http://a/ü\r\nx: y", "one"), (2, None, "one"), (3, "http://a", None), (4, "http://a", ""), (None, "u", "one"), (5, "u", "two"), (5, "u", "two"), (6, "u", "WARC/1.1\r\n\r\n" * 9 + "é" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index, _ = write_archive(pages)
    got = read_records(index, gap=10, most=1 << 16)
    assert _sorted(tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == _sorted(B.warc([(i, h) for i, _, h in rows]))
    assert {r["payload"].decode() for r in got.where("record_type = 'response'").collect()} == {h or "" for _, _, h in rows}
    some = read_records(index.where("page_id in (5, 6)"))
    assert some.count() == 3
    assert read_records(write_archive(pages, revisit_from=4)[0]).where("record_type = 'revisit'").count() == 0
    assert read_records(write_archive(pages.limit(0))[0]).count() == 0


# 3 -------------------------------------------------------------------------------


def test_quality(spark, sf):
    got = {r["doc_id"]: r for r in Q.QUERIES["op3_quality_rules"](spark, sf).collect()}
    docs = _table(spark, sf, "documents", "doc_id", "text")
    for i, t in docs:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == B.quality(t)
        assert not (r["kept"] and r["base_failed"])
    labels = dict(_table(spark, sf, "labels", "doc_id", "quality"))
    good = [got[i]["kept"] for i, q in labels.items() if q == 1 and not got[i]["base_failed"]]
    bad = [got[i]["kept"] for i, q in labels.items() if q == 0]
    assert sum(good) == len(good) and sum(bad) < 0.3 * len(bad)


def test_the_verdict_is_that_of_a_plain_estimate(spark, sf):
    """Minimum-covariance-determinant estimates with many random starts in numpy give the same verdicts."""
    from factorloom.llm import quality

    assert quality.chi_square_quantile(5, 0.999) == pytest.approx(20.515, abs=1e-3) and quality.consistency(0.75) == pytest.approx(1.4121, abs=1e-4)
    assert quality.chi_square_quantile(5, 0.9999) == pytest.approx(25.7448, abs=1e-3)
    docs = _table(spark, sf, "documents", "doc_id", "lang", "source", "text")
    got = {r["doc_id"]: r for r in Q.QUERIES["op3_quality_rules"](spark, sf).collect()}
    want = B.outliers([r[1:] for r in docs])
    for (i, *_), d in zip(docs, want):
        assert got[i]["kept"] == (not got[i]["base_failed"] and d <= 25.7448), (i, d, got[i]["distance"])


def test_quality_of_odd_rows(spark, odd, odd_docs):
    got = judge(odd_docs)
    _kept_clashes(got)
    want = [(i, *B.quality(t)) for i, t, *_ in odd]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert _sorted(tuple(r) for r in got.select(*names).collect()) == _sorted(want)
    assert judge(odd_docs.limit(0)).count() == 0


def test_outliers_are_found_per_group(spark):
    """What is ordinary in one source is rejected in another."""
    rng = random.Random(8)
    text = lambda n, k: " ".join("".join(rng.choice("etaoin") for _ in range(max(1, int(rng.gauss(k, 0.5))))) for _ in range(n))
    rows = [(i, text(80, 5), "en", "s") for i in range(300)] + [(1000 + i, text(80, 9), "en", "t") for i in range(300)]
    rows += [(5000, text(80, 9), "en", "s"), (5001, text(80, 5), "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    gone = {r["doc_id"] for r in judge(docs).where("not base_failed and not kept").collect()}
    assert gone == {5000, 5001}
    again = {r["doc_id"]: r["distance"] for r in judge(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["distance"] for r in judge(docs).collect()}


# 4 -------------------------------------------------------------------------------


def test_links(spark, sf):
    docs = _table(spark, sf, "documents", "doc_id", "text")
    want = [(i, *x) for (i, _), x in zip(docs, B.components(docs))]
    assert _sorted(tuple(r) for r in Q.QUERIES["op4_jaccard_join"](spark, sf).collect()) == _sorted(want)


def test_links_of_odd_rows(spark, odd, odd_docs):
    got = link_documents(odd_docs)
    _kept_clashes(got)
    want = B.components([r[:2] for r in odd])
    empty = [(i, 0, i) for (i, *_), (n, _) in zip(odd, want) if n == 0]
    some = [(i, n, c) for (i, *_), (n, c) in zip(odd, want) if n]
    assert _sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == _sorted(empty + some)
    assert link_documents(odd_docs.limit(0)).count() == 0
    one = keep_one(odd_docs)
    alone = {i for (i, *_), (n, c) in zip(odd, want) if n == 0 or i == c}
    assert one.columns == odd_docs.columns and {r["doc_id"] for r in one.collect()} - {None} == alone - {None}
    assert one.where("doc_id = 6").count() == 1


@pytest.mark.parametrize("rare", [2, 4, 32])
def test_links_in_crowded_groups(spark, rare):
    """Chains of near copies, shared passages, all sizes near the limit; small ``rare`` uses pairs of shingles."""
    rng, vocabulary = random.Random(rare), _vocabulary(3, 60)
    rows = []
    for g in range(4):
        now = [rng.choice(vocabulary) for _ in range(rng.choice((12, 40, 90)))]
        shared = [rng.choice(vocabulary) for _ in range(25)]
        for _ in range(45):
            if rng.random() < 0.6:
                now = list(now)
                now[rng.randrange(len(now))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(now + shared * (rng.random() < 0.3))))
    rows += [(len(rows) + k, " ".join(vocabulary[: 5 + k % 7])) for k in range(20)]
    want = [(i, *x) for (i, _), x in zip(rows, B.components(rows))]
    got = link_documents(spark.createDataFrame(rows, "doc_id long, text string"), rare=rare)
    assert _sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == _sorted(want)


def _morse(n):
    """A word of n letters and its letter swap, which polynomial hashes modulo 2^64 cannot tell apart."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 128, 1024, 4096])
def test_regular_words_are_different(spark, n):
    one, two = _morse(n)
    rows = [(k, " ".join([w, *(f"{t}{w[:3]}" for t in "mnop")] * 9)) for k, w in enumerate((one, two))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in link_documents(docs).collect()} == {0, 1}
    plain = spark.createDataFrame([(k, " ".join(f"{w}" if i == 20 else f"w{i}" for i in range(35))) for k, w in enumerate((one, two))], docs.schema)
    assert {r["n_removed"] for r in remove_repeats(plain).collect()} == {0}


def test_links_of_frequent_shingles_alone(spark):
    """Groups of 60 sparse variants of one opening, in pairs one block apart: all shingles are frequent, all lists longer than the default ``rare``."""
    rng, rows = random.Random(7), []
    blocks = [[" ".join(f"b{k}{o}{i}" for i in range(4)) for o in "xy"] for k in range(16)]
    for g in range(6):
        opening = [f"g{g}w{i}" for i in range(24)] + ["same"] * 4
        for _ in range(30):
            picks = [rng.randrange(2) for _ in blocks]
            for turn in (None, rng.randrange(len(blocks))):
                rows.append((len(rows), " ".join(opening + [b[p ^ (k == turn)] for k, (b, p) in enumerate(zip(blocks, picks))])))
    want = [(i, *x) for (i, _), x in zip(rows, B.components(rows))]
    got = link_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert _sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == _sorted(want)


# 5 -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_token_counts(spark, sf, model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = dict(_table(spark, sf, "documents", "doc_id", "text"))
    got = Q.QUERIES["op5_token_counts"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(lib.encode(docs[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 4096)


def test_models_that_change_texts():
    from factorloom.llm.token_counts import SPACE, changes_texts

    whole = lambda t: [SPACE, *t.replace(" ", SPACE)]
    assert not changes_texts(whole)
    assert changes_texts(lambda t: whole(t.replace("Ⅳ", "IV"))) and changes_texts(lambda t: whole(t.lower()))
    assert changes_texts(lambda t: whole(" ".join(t.split()))) and changes_texts(lambda t: whole(t)[1:]) and changes_texts(lambda t: whole(t.replace("\t", " ")))


def test_prefixes_of_anything(model):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    c = PrefixCounter(model)
    lib = c.library
    known = ["", " ", "a  b", "  x", "x  ", "\n\na b\t", "a▁b", "ﬁ Ⅳ é 漢字 \x00", "<s>hi</s><unk>", " " * 37 + "z", "ab" * 40, "        q      \n   r", "日本語" * 5, "🙂🙃 👩‍👩‍👧"]
    for s in known:
        assert list(c.prefixes(s)) == [len(lib.encode(s[:k])) for k in range(len(s) + 1)], s

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.sampled_from("abcdeinorstThe  .,▁é\n0x"), max_size=40))
    def same(s):
        p = c.prefixes(s)
        assert list(p) == [len(lib.encode(s[:k])) for k in range(len(s) + 1)] and c.total(s) == p[-1]

    same()
    text = "the quick brown fox jumps over the lazy dog"
    k = c.fit(text, 5)
    assert len(lib.encode(text[:k])) <= 5 < len(lib.encode(text[: k + 1]))


def test_token_counts_of_odd_rows(spark, odd, odd_docs, model):
    got = count_tokens(odd_docs, model, limit=100, budget=10, prefixes=False)
    _kept_clashes(got)
    c = PrefixCounter(model)
    want = [(i, len((t or "").encode()), n := len(c.library.encode(t or "")), n > 100) for i, t, *_ in odd]
    assert _sorted(tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == _sorted(want)
    assert count_tokens(odd_docs.limit(0), model).count() == 0
    full = count_tokens(odd_docs.where("doc_id = 10"), model, prefixes=True).first()
    assert full["prefix_counts"][-1] == full["n_tokens"] and len(full["prefix_counts"]) == len(full["text"]) + 1


# 6 -------------------------------------------------------------------------------


def test_contamination(spark, sf):
    items = _table(spark, sf, "benchmark", "item_id", "text")
    want = []
    for i, t in _table(spark, sf, "documents", "doc_id", "text"):
        n, hit, found, bad = B.contamination(t, items)
        want.append((i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bad))
    assert _sorted(tuple(r) for r in Q.QUERIES["op6_decontamination"](spark, sf).collect()) == _sorted(want)


@pytest.mark.parametrize("most_anchors", [0, 50_000])
def test_contamination_of_odd_rows(spark, odd, odd_docs, most_anchors):
    passage = odd[10][1].split()[:40]
    items = [(1, " ".join(passage)), (2, " ".join(passage).upper() + "!"), (3, "Ünï, ÇÖDE"), (4, None), (5, " .. "), (None, "end"), (6, "end"), (7, odd[6][1]), (8, "ab cd ab cd ab cd ab cd ab cd ab cd ab cd ab"), (9, "zz " * 13)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(odd_docs, benchmark, most_anchors=most_anchors)
    _kept_clashes(got)
    want = []
    for i, t, *_ in odd:
        n, hit, found, bad = B.contamination(t, items)
        want.append((i, n, hit, ",".join(found), bad))
    assert _sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", F.array_join("items", ","), "contaminated").collect()) == _sorted(want)
    assert find_contamination(odd_docs.limit(0), benchmark).count() == 0
    assert find_contamination(odd_docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_removal(spark, odd, odd_docs):
    items = [(1, " ".join(odd[10][1].split()[:40])), (6, "end")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clean = remove_contamination(odd_docs, benchmark)
    want = [i for i, t, *_ in odd if not B.contamination(t, items)[3]]
    assert _sorted((r["doc_id"],) for r in clean.collect()) == _sorted((i,) for i in want) and clean.columns == odd_docs.columns
    cut = remove_contamination(odd_docs, benchmark, "spans")
    assert cut.count() == len(odd) and find_contamination(cut, benchmark).where("n_hit > 0").count() == 0
    text = cut.where("doc_id = 9").first()["text"]
    assert odd[9][1].startswith(text[:60]) and len(text.split()) == 150 - 40
    with pytest.raises(ValueError):
        remove_contamination(odd_docs, benchmark, "words")


# 7 -------------------------------------------------------------------------------


def test_conversations_of_odd_rows(spark):
    rows = [(1, 0, "user", "<|im_end|>"), (1, 1, "assistant", "a<\\|b <\\\\| <|im_start|>x\n<"), (1, 1, "assistant", "again"), (1, 1, "assistant", "again"), (None, 0, None, None), (2, None, "assistant", ""), (2, 3, "us%er\n<|x", "|" * 5), (3, 0, "assistant", "é" * 100000)]
    done = format_trees(from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    back = {r["tree"]: r for r in done.select("tree", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("learned"), "formatted").collect()}
    assert len(back) == 4
    for tree in (1, None, 2, 3):
        own = sorted((r for r in rows if r[0] == tree), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in back[tree]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert back[tree]["learned"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert back[tree]["formatted"].count("<|im_start|>") == len(own) == back[tree]["formatted"].count("<|im_end|>\n")
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_trees(from_turns(empty)).count() == 0
    assert "Python" not in done._jdf.queryExecution().executedPlan().toString()


def test_reply_trees(spark):
    """The best of all root-to-leaf paths, by summed scores; ties by leaf."""
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 0.5), ("t", 4, 3, "user", "c", 0.7), ("t", 5, 2, "user", "d", 0.0), ("u", 9, 8, "user", "lost parent", 0.0), ("v", 1, 2, "user", "cycle", 0.0), ("v", 2, 1, "user", "cycle", 0.0)]
    m = spark.createDataFrame(rows[:6], "tree string, id long, parent long, role string, text string, score double")
    assert {(r["tree"], r["leaf"]): r["n"] for r in tree_paths(m).groupBy("tree", "leaf").agg(F.count("*").alias("n")).collect()} == {("t", 4): 3, ("t", 5): 3, ("u", 9): 1}
    best = {r["tree"]: r for r in format_trees(m).collect()}
    assert best["t"]["leaf"] == 4 and best["t"]["score"] == pytest.approx(1.2)
    assert format_trees(m, best=2).count() == 3
    cyclic = tree_paths(spark.createDataFrame([*rows, ("v", 3, 2, "user", "hangs from it", 0.0), ("v", 4, None, "user", "root", 0.0)], m.schema))
    assert {(r["tree"], r["leaf"]): r["n"] for r in cyclic.groupBy("tree", "leaf").agg(F.count("*").alias("n")).collect()} == {("t", 4): 3, ("t", 5): 3, ("u", 9): 1, ("v", 4): 1}
    long = spark.createDataFrame([("w", k, k - 1 if k else None, "user", str(k), 0.0) for k in range(100)], m.schema)
    turns = format_trees(long).select(read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"] for t in turns] == [str(k) for k in range(100)]


def test_repeated_messages(spark):
    """A chain with each row twice is one path; a different row with one id of it is a branch without replies."""
    rows = [("t", k, k - 1 if k else None, "user", f"m{k}", 1.0) for k in range(12) for _ in range(2)] + [("t", 5, 4, "user", "m0 first", 0.5), (None, None, None, "user", "no id", 0.0)]
    m = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")
    assert tree_paths(m).count() == 12 + 6 + 1
    got = sorted((r["score"], [t["text"] for t in r["t"]]) for r in format_trees(m, best=5).select("score", read_turns(F.col("formatted")).alias("t")).collect())
    assert got == [(0.0, ["no id"]), (5.5, [*(f"m{k}" for k in range(5)), "m0 first"]), (12.0, [f"m{k}" for k in range(12)])]


def test_no_message_is_dropped(spark):
    """Two messages under one id, and messages without id, are branches of their own."""
    rows = [(1, 10, None, "user", "q", 0.0), (1, 11, 10, "assistant", "A", 1.0), (1, 11, 10, "assistant", "B", 5.0), (1, 11, 10, "assistant", "B", 5.0), (1, None, 10, "assistant", "C", 2.0), (1, None, 10, "assistant", "D", 2.0), (1, None, None, "user", "alone", None), (1, 12, 11, "user", "more", 0.5), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double").repartition(3)
    got = format_trees(df, best=9).select("tree", "score", read_turns(F.col("formatted")).alias("turns")).collect()
    paths = sorted((-1 if r.tree is None else r.tree, r.score, [t.text for t in r.turns]) for r in got)
    assert paths == [(-1, 0.0, [""]), (1, 0.0, ["alone"]), (1, 1.0, ["q", "A"]), (1, 2.0, ["q", "C"]), (1, 2.0, ["q", "D"]), (1, 5.5, ["q", "B", "more"])]
    assert {(r.leaf, r.leaf_copy == 0) for r in tree_paths(df).where("tree = 1").collect()} == {(None, False), (11, False), (12, True)}


def test_branches_against_plain_python(spark):
    """Random trees with ties: the best branches, their turns and scores."""
    rng, rows = random.Random(5), []
    for t in range(30):
        for k in range(rng.randint(1, 40)):
            rows.append((t, k, rng.randrange(k) if k and rng.random() < 0.95 else None, rng.choice(("user", "assistant")), f"{t}:{k}", float(rng.randint(0, 2))))
    want = {}
    for t in range(30):
        own = {r[1]: r for r in rows if r[0] == t}
        above = {r[2] for r in own.values()}
        paths = []
        for leaf in own.keys() - above:
            path, at = [], leaf
            while at is not None:
                path.append(own[at])
                at = own[at][2]
            paths.append((-sum(r[5] for r in path), leaf, [(r[3], r[4]) for r in reversed(path)]))
        for score, leaf, turns in sorted(paths)[:2]:
            want[t, leaf] = (-score, turns)
    m = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    got = {(r["tree"], r["leaf"]): (r["score"], [(t["role"], t["text"]) for t in r["t"]]) for r in format_trees(m, best=2).select("tree", "leaf", "score", read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == want


# 8 -------------------------------------------------------------------------------


def test_mix_of_odd_rows(spark, odd, odd_docs):
    got = mix_sources(odd_docs)
    want = B.mixture([(r[0], r[3], r[1]) for r in odd])
    rows = got.collect()
    assert len(rows) == len(odd)
    for r in rows:
        size, target, taken = want[r["doc_id"], r["source"], r["size"]]
        assert r["source_size"] == size and r["target"] == pytest.approx(target) and r["taken"] <= 2 * r["size"]
    assert mix_sources(odd_docs.limit(0)).count() == 0
    assert mix_sources(odd_docs.where("doc_id < 3")).where("taken > 0").count() == 0
    assert _sorted(tuple(r) for r in mix_sources(odd_docs.repartition(5)).collect()) == _sorted(tuple(r) for r in rows)
    assert _sorted(tuple(r) for r in mix_sources(odd_docs, most_edge=0).collect()) == _sorted(tuple(r) for r in rows)


def test_mix_is_near_its_targets(spark, sf):
    docs = _table(spark, sf, "documents", "doc_id", "source", "text")
    want = B.mixture(docs)
    got = spark.read.parquet(f"{sf}/documents.parquet").transform(mix_sources).collect()
    assert {(r["doc_id"], r["source"], r["size"]): (r["source_size"], pytest.approx(r["target"]), r["taken"]) for r in got} == want
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got), rel=0.02)


def test_repeated_rows_are_mixed_one_by_one(spark):
    """A thousand rows without id in one source come near its target too."""
    rows = [(None, "nine words are in this text " * 1 + "and more here", "a")] * 1000 + [(k, "w " * 9, "b") for k in range(1000)] + [(k, "w " * 9, "c") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(got) == 3 and all(r.taken == pytest.approx(r.target, rel=0.01) for r in got)


# 9 -------------------------------------------------------------------------------


def _page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


PAGES = [
    (_page("<nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p><b>one<br><p>two&nbsp;\n three<i>!</i></p></article><footer>foot</footer>"), "A & B one two three!"),
    (_page("<p>no article<p>second", "<script>var t='</p><p>';</script><style>p{}</style>"), "no article second"),
    (_page("<main><p>main text</p><aside>side</aside><form><p>form</p></form></main><p>outside</p>"), "main text"),
    (_page("<article><p>kept</p><div id='comments'><article><p>a reader</p></article></div><ul><li>x<li>y</ul></article>"), "kept x y"),
    (_page("<div class=\"cookie-notice\">we</div><article><p>t<!-- <p>no</p> -->u</p><table><tr><td>1<td>2</table></article>"), "tu 1 2"),
    (_page("<article><p hidden>h</p><p title='a>b'>q</p><p>&lt;b&gt; &#233;&eacute; &unknown; &</p></article>"), "q <b> éé &unknown; &"),
    (_page("<div class='page-header'>Site</div><article><div class='post-header'><h1>Title</h1></div><p>x</p><div class='shareButtons'>y</div></article>"), "Title x"),
    ("", ""),
    (None, ""),
    ("plain words", "plain words"),
    ("<article>unclosed <b>bold", "unclosed bold"),
    ("<article><p>a<script>if (a < b) { x = '<p>' }</script>b</article>", "ab"),
    ("<article>" + "<p>x</p>" * 20000 + "</article>", " ".join(["x"] * 20000)),
]


def test_main_text(spark, sf):
    rows = [(i, f"http://h{i}/", h) for i, (h, _) in enumerate(PAGES)] + [(100, None, PAGES[0][0])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))
    out = extract_text(pages)
    got = {r["page_id"]: r for r in out.collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want) and got[i]["low"] == "own low"
    assert got[100]["text"] == PAGES[0][1] and extract_text(pages.limit(0)).count() == 0
    import html
    import re

    for r in Q.QUERIES["op9_html_text"](spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: "" if re.fullmatch(r"</?b>", m[0]) else " ", body)).split())


def test_the_site_tree_finds_what_pages_share(spark):
    """Text that all pages of a host have is no content, though no tag says so."""
    rows = [(i, "http://site/x", _page(f"<div class='top'><p>Welcome to our site</p></div><div class='body'><p>story {i} {'w' * i}</p></div>")) for i in range(12)]
    rows += [(99, "http://other/x", _page("<div class='top'><p>Welcome to our site</p></div>"))]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "story 3 www" and got[99] == "Welcome to our site"


def test_the_site_tree_has_all_pages(spark):
    """Pages that mark their article are in the tree and judged by it; copies of one article are not taken for a notice."""
    top = "<div class='top'><p>Welcome to our site</p></div>"
    rows = [(i, "http://site/x", _page(f"{top}<article><p>story {i}</p><div class='end'>Thanks for reading</div></article>")) for i in range(12)]
    rows += [(20 + i, "http://site/y", _page(f"{top}<div class='body'><p>plain {i}</p></div>")) for i in range(2)]
    rows += [(30 + i, "http://copies/x", _page("<article><h1>One</h1><p>story</p></article>")) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(12)] == [f"story {i}" for i in range(12)]
    assert got[20] == "plain 0" and got[21] == "plain 1"
    assert {got[30 + i] for i in range(9)} == {"One story"}


def test_branches_of_the_site_tree(spark):
    """Importance goes from children to branches: a branch goes with all below it, or stays for one part that differs."""
    news = lambda i: f"<div class='box'><div class='head'><p>Latest</p><p>Contact us</p></div><div class='items'><p>item {i}</p></div></div>"
    top = "<div class='top'><div class='in'><p>Our site</p><ul><li>since</li><li>1999</li></ul></div></div>"
    rows = [(i, "http://site/x", _page(f"{top}{news(i)}<div class='body'><h2>Story {i}</h2><p>{'w ' * i}</p></div>")) for i in range(1, 13)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "item 3 Story 3 w w w"


def test_names_that_articles_use(spark):
    rows = [(1, "http://a/", _page("<article><p>x</p><section class='discussion'><p>we discuss</p></section><p class='related-work'>others</p><div class='comments'>reader</div></article>")), (2, "http://b/", _page("<div class='story'><p>" + "a long story " * 30 + "</p></div><article><p>teaser</p></article>"))]
    rows += [(10 + i, "http://c/", _page(f"<article><p>text {i}</p><div class='related'><p>See also our shop</p></div></article>")) for i in range(8)]
    rows += [(30, "http://d/", "<article>" + "<div>x" * 20000), (31, "http://d/", "<p>y</p>" + "<a " * 100000), (32, "http://d/", "<article><script>x = \"<a href='\"</script><p>it's</p></article><p>don't</p>"), (33, "http://d/", "<article>" + "<div><dt>z</dt>" * 5000)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "x we discuss others" and got[2].startswith("a long story") and got[12] == "text 2"
    assert got[30] == " ".join(["x"] * 20000) and got[31].startswith("y <a <a") and got[32] == "it's" and got[33] == " ".join(["z"] * 5000)


def test_names_that_hold_other_names(spark):
    """Only a whole name means noise, and none does for what an article is made of."""
    story = "<div class='story'><p>" + "a long story " * 57 + "</p></div>"
    pages = [
        ("<article><p class='ad-hoc'>made for it</p><div class='comment-on-law'><p>on law</p></div><figure class='widget'><figcaption>a caption</figcaption></figure><p>end</p></article>", "made for it on law a caption end"),
        (story + "<article><p>" + "teaser " * 40 + "</p></article>", " ".join(["a long story"] * 57 + ["teaser"] * 40)),
        ("<article><p>x</p><div class='ad-slot top'>buy</div><div class='post-comments'>c</div><ol class='commentlist'><li>d</ol><div id='cookieBanner'>e</div><div class='downloads'>f</div></article>", "x f"),
        ("<div class='adverse events'>kept</div><div class='site-footer'>no</div><div class='header'>no</div><div class='shared-values'>too</div>", "kept too"),
    ]
    rows = [(k, f"http://n{k}/", _page(body)) for k, (body, _) in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(len(pages))] == [want for _, want in pages]


def test_shared_headings_of_articles_stay(spark):
    recipe = lambda i: f"<article><h1>Dish {i}</h1><h2>Ingredients</h2><p>salt</p><h2 class='how'>Method</h2><div><p>mix {i} well</p></div><div class='legal'>All rights</div></article>"
    rows = [(i, "http://cook/x", _page(recipe(i))) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5] == "Dish 5 Ingredients salt Method mix 5 well"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_site_tree_against_plain_python(spark, seed):
    """Hosts whose pages name no article: the tree alone decides."""
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(n))
    rows = []
    for host in range(3):
        shared = {c: words(4) for c in "abcdef"}
        for i in range(rng.randint(5, 14)):
            parts = []
            for c in "abcdef":
                kind = (ord(c) + host) % 4
                text = shared[c] if kind == 0 else words(6) + f" {i}" if kind == 1 else rng.choice([shared[c], shared["a"]]) if kind == 2 else shared[c] if rng.random() < 0.8 else words(3)
                inner = f"<p>{text}</p>" + (f"<div class='in'><p>{words(2)}</p><p>{shared[c]}</p></div>" if rng.random() < 0.5 else "")
                if rng.random() < 0.9:
                    parts.append(f"<div class='{c}{'-related' if kind == 3 else ''}'>{inner}</div>")
            rows.append((len(rows), f"http://h{host}/{i}", _page("".join(parts))))
        rows.append((len(rows), f"http://h{host}/again", rows[-1][2]))
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = B.site_trees([(i, url.split("/")[2], html) for i, url, html in rows])
    assert got == want and any(len(want[i]) < len(" ".join(t for _, t in Page(h).blocks)) for i, _, h in rows)


# 10 ------------------------------------------------------------------------------


def _digest(kept):
    return hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_repeats(spark, sf):
    docs = _table(spark, sf, "documents", "doc_id", "text")
    want = [(i, n, n - len(k), _digest(k)) for (i, _), (n, k) in zip(docs, B.repeats([t for _, t in docs]))]
    assert _sorted(tuple(r) for r in Q.QUERIES["op10_substring_dedup"](spark, sf).collect()) == _sorted(want)


@pytest.mark.parametrize("batches,fanout,window", [(1, 2, 35), (3, 1, 35), (4, 9, 7), (2, 2, 1)])
def test_repeats_of_odd_rows(spark, odd, odd_docs, batches, fanout, window):
    from collections import Counter

    got = remove_repeats(odd_docs, window=window, batches=batches, fanout=fanout, with_text=True)
    texts = [r[1] for r in odd]
    every = Counter(tuple(w[k : k + window]) for w in map(B.words, texts) for k in range(len(w) - window + 1))
    want = [(i, n, n - len(k), _digest(k), B.cut(t, window, every)) for (i, t, *_), (n, k) in zip(odd, B.repeats(texts, window))]
    assert _sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").collect()) == _sorted(want)
    if batches == 1:
        _kept_clashes(got)
        assert remove_repeats(odd_docs.limit(0)).count() == 0


def test_an_index_that_grows(spark, odd, tmp_path):
    """Batches added to an index that is opened again each time; old rows hear of new repeats."""
    rows = [(k, r[1]) for k, r in enumerate(odd)]
    parts = [rows[:7], rows[7:9], [], rows[9:13], rows[13:]]
    now = {}
    for n, part in enumerate(parts):
        index = RepeatIndex(spark, f"file://{tmp_path}/index", window=20, fanout=2)
        got = index.add(spark.createDataFrame(part, "doc_id long, text string").coalesce(1), with_text=n % 2 == 0)
        for r in got.collect():
            assert r["is_new"] == (r["doc_id"] in dict(part))
            now[r["doc_id"]] = (r["n_words"], r["n_removed"], r["kept_sha256"])
        known = [t for p in parts[: n + 1] for _, t in p]
        want = {i: (m, m - len(k), _digest(k)) for (i, (m, k)) in enumerate(B.repeats(known, 20))}
        assert now == want
    with pytest.raises(ValueError):
        RepeatIndex(spark, f"file://{tmp_path}/index", window=21)
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame(rows[:1], "id int, text string"))


# What all share --------------------------------------------------------------------


def test_words_and_blobs():
    import numpy as np
    import pyarrow as pa

    texts = ["a bb\x0bccc", None, "", " x ", "\x1cé ü z"]
    buf, offs = W.text_bytes(pa.array(texts))
    s, e, w = W.word_spans(buf, offs)
    got = [[buf[i:j].tobytes().decode() for i, j in zip(s[a:b], e[a:b])] for a, b in zip(w, w[1:])]
    assert got == [B.words(t) for t in texts]
    h = W.word_hashes(*W.text_bytes(pa.array(["Ab aB ab É é"]))[:1], *W.word_spans(*W.text_bytes(pa.array(["Ab aB ab É é"])))[:2], True)
    assert h[0] == h[1] == h[2] and h[3] != h[4]
    a = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (W.unpack_sorted(W.pack_sorted(a), len(a)) == a).all() and len(W.unpack_sorted(b"", 0)) == 0
