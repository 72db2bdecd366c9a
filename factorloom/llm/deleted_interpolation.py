"""Language-model scoring by deleted interpolation.

Maximum-likelihood n-gram estimates of all orders are mixed, from the longest
context down::

    P_k(w | c_k) = l[k, b] * count(c_k w) / count(c_k) + (1 - l[k, b]) * P_{k-1}(w | c_{k-1})
    P_0(w) = 1 / (V + 1)

``b`` is the bucket of the context's count (its binary logarithm), so contexts
that were seen often trust their own counts more.  The weights l are learned by
expectation-maximisation on held-out counts: one part of the training texts
(``fold_of``) is deleted from the counts, its tokens are described by the
estimates that the rest gives, and EM runs over the histogram of these
descriptions; a bucket that the held-out part does not reach has the weight of
the nearest one that it reaches.  The histogram has a fixed grid (estimates to a quarter of a
decade, counts to a power of two), so its size does not grow with the corpus.
Final scores use the counts of all training texts with the learned weights.

Counts come through the packed chunk exchange, one order after the other: a
chunk asks about each of its distinct n-grams once and gets the counts in the
same order, so n-grams that are in every text cost one entry per chunk.  An
n-gram is known by a 64-bit hash of its words: two of them are counted as one
with a chance of 2^-64, so among 10^9 different words that happens to no pair
with 97 percent.

Definitions for odd input: a null or empty text has the end token alone; null
ids hash as the empty string; texts of any length are scored whole; repeated
rows are each learned from and scored; without training texts all counts are 0
and the score is that of P_0; an empty table gives an empty result; other
columns pass through unless they clash with the names of the results, which win.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _words as W
from ._chunks import ANSWER, ANSWER_ARROW, ask, bucket_bits, chunked, gathered, requests, resolve
from ._columns import DOC, bundle, col, unbundle
from ._store import materialise

_END = W.U(0x5851F42D4C957F2D)
_START = W.U(0x14057B7EF767814F)
#: Buckets of context counts: none, then powers of two.
BUCKETS = 24
#: Estimates are kept to a quarter of a decade, from 1 down; the last step is "never seen".
GRID, PER_DECADE = 49, 4
_PAIR = np.dtype([("c", np.uint64), ("d", np.uint64)])


class Grams:
    """Tokens (words, then one end for each text) and their n-gram hashes."""

    def __init__(self, rows: pa.Table, text: str, order: int):
        buf, offs = W.text_bytes(rows.column(text))
        starts, ends, word_offs = W.word_spans(buf, offs)
        h = W.word_hashes(buf, starts, ends, lower=True)
        docs = rows.num_rows
        n = np.diff(word_offs)
        self.offs = np.concatenate(([0], np.cumsum(n + 1)))
        self.doc = np.repeat(np.arange(docs), n + 1)
        token = np.empty(len(h) + docs, np.uint64)
        is_end = np.zeros(len(token), bool)
        is_end[self.offs[1:] - 1] = True
        token[~is_end], token[is_end] = h, _END
        place = np.arange(len(token)) - self.offs[self.doc]
        self.place = place
        # hash of the k tokens up to each, the start token before the first
        self.hash = [W.mix(token, 31)]
        acc = token.copy()
        for k in range(1, order):
            back = np.full(len(token), _START, np.uint64)
            ok = place >= k
            back[ok] = token[np.flatnonzero(ok) - k]
            acc = W.mix(acc * W.U(0xD1342543DE82EF95) + back, 32 + k)
            self.hash.append(acc)

    def context(self, counts: list[np.ndarray], texts: float, tokens: float) -> list[np.ndarray]:
        """Counts of each token's contexts of 0, 1, ... tokens, from the counts of n-grams."""
        out = [np.full(len(self.doc), tokens)]
        for c in counts[:-1]:
            before = np.empty(len(c))
            before[1:] = c[:-1]
            before[self.place == 0] = texts
            out.append(before)
        return out


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(BUCKETS - 1, np.floor(np.log2(np.maximum(count, 1))) + 1), 0).astype(np.int64)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def learn_weights(hist: list[tuple], order: int, uniform: float, rounds: int = 60) -> np.ndarray:
    """EM over rows of (bucket and grid step of each order, weight): an array of order x BUCKETS."""
    weights = np.full((order, BUCKETS), 0.5)
    if not hist:
        return weights
    a = np.array(hist, float)
    bucket = a[:, :order].astype(int)
    grid = a[:, order : 2 * order]
    est = np.where(grid >= GRID - 1, 0.0, 10.0 ** (-(grid + 0.5) / PER_DECADE))
    n = a[:, -1]
    seen = np.array([np.bincount(bucket[:, k], weights=n, minlength=BUCKETS) > 0 for k in range(order)])
    for _ in range(rounds):
        rest = np.ones(len(n))
        parts = []
        for k in range(order - 1, -1, -1):
            w = weights[k, bucket[:, k]]
            parts.append((k, rest * w * est[:, k], rest))
            rest = rest * (1 - w)
        total = sum(p for _, p, _ in parts) + rest * uniform
        left = total.copy()
        new = weights.copy()
        for k, p, _ in parts:
            took = np.bincount(bucket[:, k], weights=n * p / total, minlength=BUCKETS)
            of = np.bincount(bucket[:, k], weights=n * left / total, minlength=BUCKETS)
            new[k] = np.divide(took, of, out=weights[k].copy(), where=of > 0)
            left = np.maximum(left - p, 0)
        if np.abs(new - weights).max() < 1e-6:
            weights = new
            break
        weights = new
    for k in range(order):
        known = np.flatnonzero(seen[k])
        weights[k] = weights[k, known[np.abs(known[:, None] - np.arange(BUCKETS)).argmin(axis=0)]]
    return np.clip(weights, 0.0, 1 - 1e-6)


def score_texts(docs: DataFrame, training: Column, fold: Column, text: str = "text", order: int = 3, rounds: int = 60) -> DataFrame:
    """Adds the model's and the base's log10 probabilities of each text.

    ``training``: which rows to learn from.  ``fold``: which of these are the
    held-out part for the weights.  Adds ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` and ``score``; the text is left out.
    """
    results = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    kept = [c for c in docs.columns if c not in {n for n, _ in results} and c != text]
    role = F.when(F.coalesce(training, F.lit(False)), F.when(F.coalesce(fold, F.lit(False)), 2).otherwise(1)).otherwise(0)
    given = docs.select(bundle(kept), role.cast("int").alias("__role"), col(text).alias("__text"))
    # held-out texts are chunks of their own: only these are read to learn the weights
    held, held_total, _ = chunked(given.where("__role = 2"), "model-chunks", "__text", tag=1)
    other, total, _ = chunked(given.where("__role <> 2"), "model-chunks", "__text")
    chunks = other.unionByName(held)
    bits = bucket_bits(total["n_words"] + held_total["n_words"])
    low = W.U(2**32 - 1)

    def count(k: int):
        def ask_one(chunk: int, rows: pa.Table) -> Iterator[dict[str, list]]:
            g = Grams(rows, "__text", k + 1)
            role = rows.column("__role").to_numpy()[g.doc]
            keys, where = np.unique(g.hash[k], return_inverse=True)
            c = np.bincount(where, weights=role > 0, minlength=len(keys))
            d = np.bincount(where, weights=role == 2, minlength=len(keys))
            yield requests(chunk, keys, bits, c.astype(np.uint64) | d.astype(np.uint64) << W.U(32))

        return ask_one

    def tally(k: int):
        def of_bucket(table: pa.Table) -> pa.Table:
            W.lean()
            table = table.combine_chunks()
            n, bucket = table.column("n").to_pylist(), table.column("bucket")[0].as_py()
            keys = np.concatenate([W.unpack_sorted(x.as_py(), i) for x, i in zip(table.column("keys"), n)])
            vals = np.concatenate([W.unsqueeze(x.as_py(), i, np.uint64) for x, i in zip(table.column("vals"), n)])
            kinds, where = np.unique(keys, return_inverse=True)
            del keys
            c = np.bincount(where, weights=(vals & low).astype(np.float64), minlength=len(kinds))
            d = np.bincount(where, weights=(vals >> W.U(32)).astype(np.float64), minlength=len(kinds))
            both = np.empty((len(where), 2), np.uint64)
            both[:, 0], both[:, 1] = c[where], d[where]
            blobs = [W.squeeze(np.ascontiguousarray(x).view(_PAIR).reshape(-1)) for x in np.split(both, np.cumsum(n)[:-1])]
            sums = ",".join(str(int(x)) for x in ((c > 0).sum(), c.sum(), (c > d).sum(), (c - d).sum()))
            out = pa.table({"chunk": [*table.column("chunk").to_pylist(), -1], "bucket": [k << bits | bucket] * (len(n) + 1), "vals": [*blobs, sums.encode()]}, schema=ANSWER_ARROW)
            del where, vals, both, c, d, kinds, blobs
            W.trim()
            return out

        return of_bucket

    told = None
    for k in range(order):
        one, _ = materialise(ask(chunks, count(k)).groupBy("bucket").applyInArrow(tally(k), ANSWER), "model-counts", "none")
        if told is None:
            sums = one.where("chunk = -1").select(*(F.split(F.col("vals").cast("string"), ",")[i].cast("long").alias(f"s{i}") for i in range(4)))
            kinds, tokens, kept_kinds, kept_tokens = (int(x or 0) for x in sums.agg(*(F.sum(f"s{i}") for i in range(4))).first())
        told = one if told is None else told.unionByName(one)
    fold_texts = int(held_total["n_docs"])
    texts = fold_texts + int(given.agg(F.sum((F.col("__role") == 1).cast("long"))).first()[0] or 0)
    told = told.where("chunk <> -1")

    def counts(rows: pa.Table, got: pa.Table) -> tuple[Grams, list[np.ndarray], list[np.ndarray]]:
        g = Grams(rows, "__text", order)
        bucket = got.column("bucket").to_numpy()
        all_, fold_ = [], []
        for k in range(order):
            keys, where = np.unique(g.hash[k], return_inverse=True)
            own = got.filter(pa.array(bucket >> bits == k))
            both = gathered(own.set_column(1, "bucket", pa.array(own.column("bucket").to_numpy() & ((1 << bits) - 1))), keys, bits, _PAIR)
            all_.append(both["c"].astype(np.float64)[where])
            fold_.append(both["d"].astype(np.float64)[where])
        return g, all_, fold_

    # the held-out part, as the rest of the training texts sees it
    columns = [f"b{k}" for k in range(order)] + [f"q{k}" for k in range(order)]
    hist_schema = ", ".join(f"{c} int" for c in columns) + ", n long"

    def describe(chunk: int, rows: pa.Table, got: pa.Table) -> pa.Table:
        g, c, d = counts(rows, got)
        held = rows.column("__role").to_numpy()[g.doc] == 2
        rest = [a - b for a, b in zip(c, d)]
        context = g.context(rest, texts - fold_texts, kept_tokens)
        code = np.zeros(int(held.sum()), np.int64)
        for k in range(order):
            est = _ratio(rest[k][held], context[k][held])
            step = np.where(est > 0, np.minimum(GRID - 2, np.floor(-np.log10(np.maximum(est, 1e-300)) * PER_DECADE)), GRID - 1)
            code = (code * BUCKETS + _bucket(context[k][held])) * GRID + np.maximum(step, 0).astype(np.int64)
        code, n = np.unique(code, return_counts=True)
        out = {"n": n.astype(np.int64)}
        for k in range(order - 1, -1, -1):
            out[f"q{k}"] = (code % GRID).astype(np.int32)
            code = code // GRID
            out[f"b{k}"] = (code % BUCKETS).astype(np.int32)
            code = code // BUCKETS
        return pa.table({c: out[c] for c in [*columns, "n"]})

    hist = resolve(held, told.join(held.select("chunk"), "chunk", "left_semi"), describe, hist_schema).groupBy(*columns).agg(F.sum("n").alias("n"))
    weights = learn_weights([tuple(r) for r in hist.collect()], order, 1.0 / (kept_kinds + 1), rounds)

    schema = T.StructType([given.schema[DOC], *(T.StructField(n, t) for n, t in results)])
    arrow = to_arrow_schema(schema)

    def score(chunk: int, rows: pa.Table, got: pa.Table) -> pa.Table:
        g, c, _ = counts(rows, got)
        context = g.context(c, texts, tokens)
        p = np.full(len(g.doc), 1.0 / (kinds + 1))
        for k in range(order):
            w = weights[k, _bucket(context[k])]
            w = np.where(context[k] > 0, w, 0.0)
            p = w * _ratio(c[k], context[k]) + (1 - w) * p
        base = np.log10((c[0] + 1) / (tokens + (kinds + 1)))
        n = rows.num_rows
        sums = [np.add.reduceat(x.astype(np.float64), g.offs[:-1]) if n else np.zeros(0) for x in (c[0] > 0, base, np.log10(p))]
        out = [rows.column(DOC), np.diff(g.offs), sums[0].astype(np.int64), np.full(n, tokens, np.int64), sums[1], sums[2]]
        return pa.table([x.combine_chunks().cast(f.type) if isinstance(x, pa.ChunkedArray) else pa.array(x, f.type) for x, f in zip(out, arrow)], schema=arrow)

    return resolve(chunks, told, score, schema).select(*unbundle(kept), *(n for n, _ in results))

