"""Benchmark decontamination with DataFrame functions only.

Words are runs of ASCII letters and digits and of all other non-ASCII
characters, with A-Z as a-z.  Every window of ``size`` item words gets an
anchor, its longest pair of neighbouring words; the anchors of the benchmark
form a hash set that is broadcast if its measured size allows (else anchors are
joined by a shuffle).  Texts are scanned once for anchors.  Around each hit the
words are compared with the item's: the run of equal words that holds the
anchor covers whole windows exactly if it is ``size`` words or longer, or, for
an item with fewer words, if it is the whole item.  Every window has an anchor,
so no window is missed, and nothing is a hit that was not compared word by word.

Definitions for odd input: null and empty texts have no words and no hits; an
item without words is never found; repeated items are found together, each
under its id (null ids are left out of the list); texts of any length are taken
whole; repeated rows are judged one by one; an empty table gives an empty
result, an empty benchmark no hits; other columns pass through unless they
clash with the names of the results, which win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._columns import DOC, bundle, col, unbundle
from ._store import materialise

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
_LEAD = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
#: The hash set goes into the plan up to this many anchors, the anchor table is broadcast up to this many bytes.
MOST_ANCHORS, MOST_BYTES = 50_000, 16 << 20


def words_of(text: Column) -> Column:
    plain = F.octet_length(text) == F.char_length(text)
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), _GAP), "")


def _word(words: Column, at: Column) -> Column:
    """The word at a place counted from 0, null outside."""
    return F.get(words, at)


def _pair(words: Column, at: Column) -> Column:
    return F.xxhash64(_word(words, at), F.coalesce(_word(words, at + 1), F.lit("")))


def _around(words: Column, at: Column, size: int) -> tuple[Column, Column]:
    """Words before ``at``, nearest first, and words from ``at`` on."""
    back = F.least(at, F.lit(size - 1))
    left = F.when(at > 0, F.reverse(F.slice(words, F.greatest(at - back, F.lit(0)) + 1, back))).otherwise(F.array().cast("array<string>"))
    return left, F.slice(words, at + 1, F.lit(size))


def _run(a: Column, b: Column) -> Column:
    """How many first elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first.cast("int") - 1).otherwise(F.size(same))


def anchor_table(benchmark: DataFrame, size: int, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``anchor, first_word, item_id, at, m, left, right``: the words around each anchor of each item."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("w")).withColumn("m", F.size("w")).where("m > 0")
    # each window is cut out before it gets a row of its own: a row holds the words around it, not the item
    start = F.sequence(F.lit(0), F.greatest(F.col("m") - size, F.lit(0)))
    reach = size - 1
    cut = F.transform(start, lambda k: F.struct(k.alias("start"), F.slice("w", F.greatest(k - reach, F.lit(0)) + 1, F.lit(3 * size)).alias("near"), F.least(k, F.lit(reach)).alias("k")))
    windows = items.select("item_id", "m", F.inline(cut))
    places = F.sequence(F.col("k"), F.greatest(F.col("k"), F.least(F.col("k") + size, F.col("k") + F.col("m") - F.col("start")) - 2))
    length = lambda p: F.char_length(_word(F.col("near"), p)) + F.coalesce(F.char_length(_word(F.col("near"), p + 1)), F.lit(0))
    best = F.array_max(F.transform(places, lambda p: F.struct(length(p).alias("n"), (-p).alias("p"))))
    placed = windows.withColumn("p", -best["p"]).withColumn("at", F.col("start") - F.col("k") + F.col("p"))
    left, right = _around(F.col("near"), F.col("p"), size)
    # an item of one word is known by the word alone
    anchor = F.when(F.col("m") == 1, F.xxhash64(_word(F.col("near"), F.col("p")))).otherwise(_pair(F.col("near"), F.col("p")))
    chosen = placed.select(anchor.alias("anchor"), _word(F.col("near"), F.col("p")).alias("first_word"), "item_id", "at", "m", left.alias("left"), right.alias("right"))
    return chosen.distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = 20, text: str = "text", item_id: str = "item_id", most_anchors: int = MOST_ANCHORS) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``items`` (sorted ids as strings), ``hits`` (word intervals) and ``contaminated``.

    Contaminated: some word is hit, and ``one_in`` times the hit words are at
    least all words.  The text itself is left out of the result.
    """
    results = {"n_words", "n_hit", "items", "hits", "contaminated"}
    kept = [c for c in docs.columns if c not in results and c != text]
    anchors, _ = materialise(anchor_table(benchmark, size, item_id=item_id), "anchors")
    shape = anchors.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("left", " ")) + F.octet_length(F.array_join("right", " ")) + 40), F.lit(0)).alias("bytes")).first()
    rows = docs.select(bundle(kept), words_of(col(text)).alias("__w")).withColumn("__row", F.monotonically_increasing_id())
    w = F.col("__w")
    if shape["n"] == 0:
        at = F.array().cast("array<int>")
    elif shape["n"] <= most_anchors:
        known = anchors.select("first_word", "anchor").distinct().collect()
        firsts, keys = sorted({r["first_word"] for r in known}), sorted({r["anchor"] for r in known})
        at = F.filter(F.transform(w, lambda x, i: F.when(x.isin(firsts), i)), lambda i: i.isNotNull())
        at = F.filter(at, lambda i: _pair(w, i).isin(keys) | F.xxhash64(_word(w, i)).isin(keys))
    else:
        at = F.transform(w, lambda x, i: i)
    rows = rows.withColumn("__at", F.explode_outer(at)).withColumn("n_words", F.size("__w"))
    left, right = _around(w, F.col("__at"), size)
    rows = rows.select(DOC, "__row", "n_words", "__at", left.alias("__left"), right.alias("__right"))
    both = F.array(F.xxhash64(F.get("__right", F.lit(0)), F.coalesce(F.get("__right", F.lit(1)), F.lit(""))), F.xxhash64(F.get("__right", F.lit(0))))
    rows = rows.withColumn("__key", F.explode_outer(F.when(F.col("__at").isNotNull(), both)))
    a = F.broadcast(anchors) if shape["bytes"] <= MOST_BYTES else anchors
    met = rows.join(a, F.col("__key") == F.col("anchor"), "left")
    l, r, p = _run(F.col("__left"), F.col("left")), _run(F.col("__right"), F.col("right")), F.col("__at")
    met = met.withColumn("l", F.when(F.col("anchor").isNotNull(), l)).withColumn("r", F.when(F.col("anchor").isNotNull(), r))
    long_ = (F.col("m") >= size) & (F.col("l") + F.col("r") >= size)
    short = (F.col("m") < size) & (F.col("l") >= F.col("at")) & (F.col("r") >= F.col("m") - F.col("at"))
    hit = F.when(long_ | short, F.struct((p - F.col("l")).cast("int").alias("first"), (p + F.col("r") - 1).cast("int").alias("last")))
    met = met.select(DOC, "__row", "n_words", hit.alias("hit"), F.when(hit.isNotNull(), F.col("item_id").cast("string")).alias("item"))
    out = met.groupBy("__row").agg(F.first(DOC).alias(DOC), F.first("n_words").cast("long").alias("n_words"), F.collect_set("hit").alias("hits"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["first"], x["last"]))))
    out = out.withColumn("n_hit", F.size(covered).cast("long"))
    return out.select(*unbundle(kept), "n_words", "n_hit", "items", "hits", ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, what: str = "documents", size: int = 13, one_in: int = 20, text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or with all hit words cut from the texts (``what='spans'``).

    Rows are matched by a hash of all they hold, so equal rows fare alike.
    """
    if what not in ("documents", "spans"):
        raise ValueError("what must be 'documents' or 'spans'")
    cells = [col(c) for c in docs.columns]
    key, again = F.xxhash64(*cells).alias("__a"), F.hash(*cells).alias("__b")
    judged = find_contamination(docs.select(col(text).alias("__t"), key, again), benchmark, size, one_in, text="__t")
    if what == "documents":
        bad, _ = materialise(judged.where("contaminated").select("__a", "__b").distinct(), "contaminated")
        return docs.withColumns({"__a": key, "__b": again}).join(bad, ["__a", "__b"], "left_anti").select(*cells)
    hits, _ = materialise(judged.where("n_hit > 0").groupBy("__a", "__b").agg(F.first("hits").alias("__hits")), "contaminated")
    joined = docs.withColumns({"__a": key, "__b": again}).join(hits, ["__a", "__b"], "left")
    pieces = F.regexp_extract_all(col(text), F.lit(_PIECE), F.lit(0))
    clean = F.transform(pieces, lambda x, i: F.when(F.exists("__hits", lambda h: (h["first"] <= i) & (i <= h["last"])), F.lit("")).otherwise(x))
    cut = F.concat(F.regexp_extract(col(text), _LEAD, 0), F.array_join(clean, ""))
    return joined.select(*(F.when(F.col("__hits").isNotNull(), cut).otherwise(col(c)).alias(c) if c == text else col(c) for c in docs.columns))
