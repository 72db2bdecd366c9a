"""Exact token counts at every prefix of a text, by dynamic programming.

A BPE encoding of a prefix is the encoding of a shorter prefix followed by one
more token, and a sequence of tokens is an encoding when every two neighbours
are.  So the last token of each prefix is the one that is compatible with the
last token of the prefix before it, and counts follow in one pass:
``count[i] = count[i - len(last)] + 1``.  No piece of the vocabulary holds a
space after another character (checked when the model is loaded), so texts fall
into units of spaces and one word, which are solved once and kept in a bounded
cache.  Only runs of spaces have pieces of equal score; a unit with such a run
is also counted by the library, and solved by encoding each of its prefixes if
the counts differ.

Definitions for odd input: a null or empty text has no bytes and no tokens;
texts of any length are taken whole (memory follows the longest text); repeated
rows give repeated results; other columns pass through unless they clash with
the names of the results, which win.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _words as W
from ._chunks import slices
from ._columns import DOC, bundle, col, unbundle
from ._ship import ship

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def changes_texts(pieces: Callable[[str], list[str]]) -> bool:
    """Whether a model folds characters, drops or turns white space, or puts no space before a text."""
    folds = any("".join(pieces(given)).endswith(folded) for given, folded in (("Ⅳ", "IV"), ("Ａ", "A"), ("A", "a")))
    return folds or "".join(pieces("  a")) != SPACE * 3 + "a" or "".join(pieces("a  ")) != SPACE + "a" + SPACE * 2 or SPACE in "".join(pieces("a\tb"))[1:]


class PrefixCounter:
    """Token counts of all prefixes under a sentencepiece BPE model."""

    def __init__(self, model: str, cache: int = 300_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        lib = self.library
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in range(lib.vocab_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("this vocabulary has pieces that run across a space")
        if changes_texts(lambda text: lib.encode(text, out_type=str)):
            raise ValueError("this model changes texts before it encodes them")
        self.joined = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.tails = {p[k:] for p in self.score for k in range(len(p) - 1)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.limit = cache
        self.parts: dict[str, tuple[int, ...]] = {}
        self.young: dict[str, bytes | np.ndarray] = {}
        self.old: dict[str, bytes | np.ndarray] = {}

    def merge(self, text: str) -> list[str]:
        """The encoding of a few characters, by merging the best neighbours first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        ok = self.pairs[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return ok

    def solve(self, unit: str) -> list[int]:
        """Counts at the prefixes of some characters, from no characters on; ``unit`` has all its spaces."""
        score, tails, pairs = self.score, self.tails, self.pairs
        count, last = [0], [""]
        for i in range(1, len(unit) + 1):
            one = piece = unit[i - 1]
            found = -1
            for j in range(i - 2, -1, -1):  # one piece at most is compatible; no longer one ends in what no piece ends in
                longer = unit[j:i]
                if longer not in tails:
                    break
                if longer in score:
                    ok = pairs.get((last[j], longer))
                    if ok or ok is None and self.fits(last[j], longer):
                        found, piece = j, longer
                        break
            last.append(piece)
            count.append(count[found] + 1 if found >= 0 else count[i - 1] + (1 if one in score else len(one.encode("utf-8", "surrogatepass"))))
        return count

    def whole(self, unit: str) -> bytes | np.ndarray:
        """Counts at the prefixes of a unit, the empty one left out.

        Two neighbours that no piece holds are never merged, so what lies
        between such places is solved alone, and kept for other units.
        """
        joined, parts = self.joined, self.parts
        count: list[int] = []
        a, total = 0, 0
        for k in range(1, len(unit) + 1):
            if k == len(unit) or unit[k - 1 : k + 1] not in joined:
                part = unit[a:k]
                got = parts.get(part)
                if got is None:
                    got = self.solve(part)
                    if len(part) <= 64:
                        if len(parts) >= self.limit:
                            parts.clear()
                        parts[part] = tuple(got)
                count += [total + c for c in got[1:]]
                total, a = count[-1], k
        if SPACE * 2 in unit and total != len(self.library.encode(unit[1:].replace(SPACE, " "), num_threads=1)):
            count = [len(self.library.encode(unit[1:k].replace(SPACE, " "), num_threads=1)) if k > 1 else 1 for k in range(1, len(unit) + 1)]
        return bytes(count) if count[-1] < 256 else np.array(count, np.int64)

    def unit(self, rest: str) -> bytes | np.ndarray:
        """Counts for a unit given without its first space."""
        got = self.young.get(rest)
        if got is None:
            got = self.old.get(rest)
            if got is None:
                got = self.whole(SPACE + rest)
            if len(rest) <= 64:
                if len(self.young) >= self.limit:
                    self.old, self.young = self.young, {}
                self.young[rest] = got
        return got

    def units(self, text: str) -> list[str]:
        """The units of a text, each without its first space."""
        if SPACE not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ") if text else []
        return [u[1:] for u in _UNITS.findall(SPACE + text.replace(" ", SPACE))] if text else []

    def total(self, text: str) -> int:
        young, n = self.young, 0
        for u in self.units(text):
            got = young.get(u)
            if got is None:
                got = self.unit(u)
                young = self.young
            n += got[-1]
        return int(n)

    def prefixes(self, text: str) -> np.ndarray:
        """The token count of each prefix, from no characters to all of them."""
        out = [np.zeros(1, np.int64)]
        base = 0
        for k, u in enumerate(self.units(text)):
            got = np.frombuffer(c, np.uint8).astype(np.int64) if isinstance(c := self.unit(u), bytes) else c
            out.append(base + (got[1:] if k == 0 else got))  # the first space is the library's own
            base += int(got[-1])
        return np.concatenate(out)

    def fit(self, text: str, budget: int) -> int:
        """The most characters of ``text`` that take no more than ``budget`` tokens."""
        counts = self.prefixes(text)
        return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


_counters: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    """The worker's counter for a model; its cache serves all tasks of the worker."""
    if model not in _counters:
        _counters[model] = PrefixCounter(model)
    return _counters[model]


def count_tokens(docs: DataFrame, model: str, text: str = "text", limit: int | None = None, budget: int | None = None, prefixes: bool = False) -> DataFrame:
    """Adds ``n_bytes`` and ``n_tokens``; by request more that the prefix counts answer.

    ``limit``: adds ``over_limit`` (more tokens than that).  ``budget``: adds
    ``fit_chars``, the longest prefix in characters within the budget.
    ``prefixes``: adds ``prefix_counts``, an array with the count at every prefix.
    """
    new = [("n_bytes", T.LongType()), ("n_tokens", T.LongType())]
    new += [("over_limit", T.BooleanType())] * (limit is not None) + [("fit_chars", T.LongType())] * (budget is not None) + [("prefix_counts", T.ArrayType(T.LongType()))] * prefixes
    names = {n for n, _ in new}
    kept = [c for c in docs.columns if c not in names]
    ship(docs.sparkSession)
    given = docs.select(bundle(kept), col(text).alias("__text"))
    schema = T.StructType([given.schema[DOC], *(T.StructField(n, t) for n, t in new)])
    names_ = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for t in slices(batches, "__text", 4 << 20):
            column = t.column("__text")
            _, offs = W.text_bytes(column)
            texts = [x or "" for x in column.to_pylist()]
            n = [c.total(x) for x in texts]
            out = [t.column(DOC), pa.array(np.diff(offs), pa.int64()), pa.array(n, pa.int64())]
            if limit is not None:
                out.append(pa.array([x > limit for x in n], pa.bool_()))
            if budget is not None:
                out.append(pa.array([c.fit(x, budget) for x in texts], pa.int64()))
            if prefixes:
                out.append(pa.array([c.prefixes(x) for x in texts], pa.list_(pa.int64())))
            yield from pa.table(out, names=names_).to_batches()

    return given.mapInArrow(run, schema).select(*unbundle(kept), *(n for n, _ in new))
