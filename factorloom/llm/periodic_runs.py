"""Maximal periodic runs of words, by heavy/light lag counting.

A run is a stretch of consecutive words whose smallest period is ``q`` (words
``q`` apart are identical), at least ``max(least, times * q)`` words long, that
no neighbouring word extends.  At lag ``q`` it is an island of at least
``max(least - q, (times - 1) * q)`` matches in a row, so only lags with as many
matches in all can have one.

Matches per lag are counted exactly for every text: rare words by the
differences of their places (all texts of a batch at once, step by step along
each word's places, no further than the largest period), frequent words by the
autocorrelation of their places with a fast Fourier transform.  A word is
frequent where its pairs would cost more than its transform.  Lags are then
looked at from 1 on.  Each run that is found takes its matches off the counts
of the multiples of its period, where it is an island too, so a text of one
repeated word has one lag to look at.  The island scan of a lag first follows
stretches of half an island's length word by word, which ends at once for most,
and looks at the whole text only where one of them holds out.

Rows are independent and nothing is shuffled; memory follows the longest text.
Words are compared by 64-bit hashes within their own text.

Definitions for odd input: a null or empty text has no words and no runs;
repeated rows give repeated results; texts of any length are taken whole; an
empty table gives an empty result; other columns pass through unless they clash
with the names of the results, which win.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W
from ._chunks import slices
from ._columns import DOC, bundle, col, unbundle
from ._ship import ship

#: Cost of a pair of places against one step of a transform, by measurement.
PAIR_COST = 1.0
#: Words whose stretches are followed one by one before the whole text is compared.
FOLLOW = 12


def island(q: int | np.ndarray, least: int, times: int):
    """Matches in a row that a run of period ``q`` has at least."""
    return np.maximum(least - q, (times - 1) * q)


def transform_size(n: int) -> int:
    """The least 2^a or 3 * 2^a from ``n`` on."""
    top = 1 << max(1, (n - 1).bit_length())
    return 3 * top // 4 if 3 * top // 4 >= n else top


def pair_counts(group_end: np.ndarray, at: np.ndarray, most: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
    """Pairs of places by lag: ``at`` is sorted within groups that end at ``group_end``.

    Place ``i`` is paired with those up to ``most[i]`` behind it; a pair of lag ``q`` counts in ``slot[i] + q``.
    """
    out = np.zeros(slots, np.int64)
    alive = np.flatnonzero(np.arange(1, len(at) + 1) < group_end)
    k, held, size = 1, [], 0
    while len(alive):
        lag = at[alive + k] - at[alive]
        near = lag <= most[alive]
        alive, lag = alive[near], lag[near]
        held.append(slot[alive] + lag)
        size += len(lag)
        if size > slots + (1 << 16):
            out += np.bincount(np.concatenate(held), minlength=slots)
            held, size = [], 0
        k += 1
        alive = alive[alive + k < group_end[alive]]
    return out + np.bincount(np.concatenate(held), minlength=slots) if held else out


def lag_counts(words: np.ndarray, offs: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Matches at every lag from 0 to a ``times``-th of each text, end to end, and where each text's begin (lag 0 is not counted)."""
    n = np.diff(offs)
    top = n // times
    base = np.concatenate(([0], np.cumsum(top + 1)))
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words, doc))  # stable: places stay in order
    w, d = words[order], doc[order]
    fresh = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (d[1:] != d[:-1]))) if len(w) else np.zeros(0, bool))
    end = np.concatenate((fresh[1:], [len(w)])) if len(w) else fresh
    times_seen = end - fresh
    width = np.array([transform_size(int(a + b + 1)) for a, b in zip(n, top)], np.int64) if len(n) else n
    cost = width * np.log2(np.maximum(width, 2))
    heavy = PAIR_COST * times_seen.astype(float) ** 2 > cost[d[fresh]] if len(w) else np.zeros(0, bool)
    light = np.repeat(~heavy, times_seen)
    place = (order - offs[d]).astype(np.int64)
    stop = np.repeat(np.cumsum(times_seen * ~heavy), times_seen)[light]
    counts = pair_counts(stop, place[light], top[d[light]], base[d[light]], int(base[-1]))
    by_doc: dict[int, list[int]] = {}
    for g in np.flatnonzero(heavy):
        by_doc.setdefault(int(d[fresh[g]]), []).append(int(g))
    for k, groups in by_doc.items():
        m, size = int(top[k]), int(width[k])
        power = np.zeros(size // 2 + 1)
        for g in groups:
            there = np.zeros(size)
            there[place[fresh[g] : end[g]]] = 1.0
            f = np.fft.rfft(there)
            power += f.real**2 + f.imag**2
        counts[base[k] : base[k] + m + 1] += np.rint(np.fft.irfft(power, size)[: m + 1]).astype(np.int64)
    return counts, base


def islands_at(words: np.ndarray, q: int, need: int) -> list[tuple[int, int]]:
    """First and past-the-end place of the stretches of ``need`` or more matches at lag ``q``."""
    m = len(words) - q
    half = (need + 1) // 2  # an island holds one of the stretches of this length, side by side, whole
    alive = np.arange(0, m - half + 1, half)
    for j in range(min(half, FOLLOW)):
        alive = alive[words[alive + j] == words[alive + j + q]]
        if not len(alive):
            return []
    same = np.zeros(m + 2, np.int8)
    np.equal(words[:m], words[q:], out=same[1:-1].view(bool))
    edge = np.diff(same)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= need
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def runs_of(words: np.ndarray, counts: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start, then period; ``counts`` (matches by lag) is used up."""
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()  # a stretch found again has a multiple of its period
    top = len(counts) - 1
    need = island(np.arange(top + 1), least, times)
    if not top or not (counts >= need)[1:].any():
        return found
    for q in np.flatnonzero(counts >= need).tolist():
        if q == 0 or counts[q] < need[q]:
            continue
        for s, e in islands_at(words, q, int(need[q])):
            length = e - s + q
            if (s, s + length) in known:
                continue
            known.add((s, s + length))
            found.append((s, length, q))
            # at multiples of its period the run is an island of its own
            lags = np.arange(2 * q, min(length - 1, top) + 1, q)
            counts[lags] -= length - lags
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words are in no run after its first period."""
    step = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        step[s + q] += 1
        step[s + length] -= 1
    return np.cumsum(step[:n]) == 0


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def find_runs(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """Adds ``n_words, runs`` (start, length, period; by start, then period) and ``collapsed``.

    ``collapsed``: the words, joined by a space, without those that a run holds after its first period.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    new = [("n_words", T.LongType()), ("runs", RUNS), ("collapsed", T.StringType())]
    kept = [c for c in docs.columns if c not in {n for n, _ in new}]
    ship(docs.sparkSession)
    given = docs.select(bundle(kept), col(text).alias("__text"))
    schema = T.StructType([given.schema[DOC], *(T.StructField(n, t) for n, t in new)])
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for t in slices(batches, "__text", 2 << 20):
            buf, offs = W.text_bytes(t.column("__text"))
            starts, ends, word_offs = W.word_spans(buf, offs)
            hashes = W.word_hashes(buf, starts, ends, lower=False)
            counts, base = lag_counts(hashes, word_offs, times)
            data, all_runs, shown = buf.tobytes(), [], []
            for k in range(t.num_rows):
                a, b = int(word_offs[k]), int(word_offs[k + 1])
                found = runs_of(hashes[a:b], counts[base[k] : base[k + 1]], least, times)
                words = data[int(offs[k]) : int(offs[k + 1])].split()
                if found:
                    words = [words[i] for i in np.flatnonzero(kept_words(b - a, found))]
                all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                shown.append(b" ".join(words).decode())
            columns = [t.column(DOC).combine_chunks(), pa.array(np.diff(word_offs), pa.int64()), pa.array(all_runs, arrow), pa.array(shown, pa.string())]
            yield from pa.table(columns, names=[DOC, *(n for n, _ in new)]).to_batches()
        W.trim()

    return given.mapInArrow(run, schema).select(*unbundle(kept), *(n for n, _ in new))


def strongest(runs: Column) -> Column:
    """The run with the greatest length/period, exactly; of equals the first by start, then period; null without runs."""
    none = F.lit(None).cast(RUNS.elementType)
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    return F.aggregate(runs, none, better)


def plant_period(text: Column, doc_id: Column) -> Column:
    """The text with a period in it, for a tenth of the ids (by crc32); other texts, and those of null ids, as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(given: Column) -> Column:
        n = F.size(given).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(given, (source(i) + 1).cast("int")))

    # the words once, not for each use
    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(repeated(w), " ")).otherwise(F.lit(""))), F.lit(0))
    return F.when((h % 10 == 0) & text.isNotNull(), made).otherwise(text)
