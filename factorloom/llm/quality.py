"""Quality rules: robust multivariate outliers for each language and source.

Each text gives a vector of transformed statistics.  For each (language,
source) the minimum-covariance-determinant estimate is sought: location and
scatter of the ``share`` of rows whose scatter has the least determinant.  It
starts from medians and median deviations and from seeded subsets of about
SUBSET rows each, takes two concentration steps from every start, keeps the
start of least determinant and goes on until its determinant no longer falls (or
for MOST_STEPS steps; an estimate that still falls then is used as it is, one
step short of the next).  The lowest bins hold somewhat more than the share.
The scatter is made consistent for a normal cloud (the factor follows from
``share``), and rows whose squared Mahalanobis distance exceeds the chi-square
quantile of ``quantile`` are rejected.

A step is one grouped pass: moments are summed by (group, start, distance bin),
and each group then keeps its lowest bins that together hold the share (bins
are 1/32 of a natural logarithm wide), so nothing but a few hundred bins of a
group ever meets in one task, however large the group is.  Statistics are
rounded to 1/1024 and moments are summed as whole numbers, so sums do not
depend on the order of rows and reruns agree.  Models have one row for each
group; Spark broadcasts them while they are small and else splits hot groups in
its joins.

Groups of fewer than ``min_rows`` rows are pooled by language, and what is
still fewer over all languages; with fewer than 16 rows there is no verdict and
rows are kept unless a base rule fails.

Base rules: fewer than ``min_words`` words, or more than ``max_repeat_percent``
percent of the words in 8-word windows that occur twice or more in the text.

Definitions for odd input: null and empty texts have no words, so they fail the
first rule; null languages and sources are groups of their own; texts of any
length are taken whole; repeated rows count each time; an empty table gives an
empty result; other columns pass through unless they clash with the names of
the results, which win.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _words as W
from ._chunks import slices
from ._columns import DOC, bundle, col, unbundle
from ._ship import ship
from ._store import materialise

WINDOW = 8
SCALE = 1024
STATS = ("mean_word", "marks", "repeated_lines", "variety", "capitals")
#: The scatter gets these standard deviations beside what was estimated, so that statistics without spread do no harm.
FLOOR = np.array([0.10, 0.10, 0.05, 0.01, 0.03])
#: Seeded starts beside the medians, rows that each of them has on average, and the most steps.
STARTS, SUBSET, MOST_STEPS = 4, 60, 40
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_kinds", "n_marks", "n_capitals")
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_MARK = _SYMBOL.copy()
_MARK[list(b"!")] = 1
_CAPITAL = np.zeros(256, np.uint8)
_CAPITAL[65:91] = 1
_LETTER = np.ones(256, np.uint8)
_LETTER[0x80:0xC0] = 0
_LETTER[W.SPACE] = 0


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    upto = np.zeros(len(flags) + 1, np.int32 if len(flags) < 2**31 else np.int64)
    np.cumsum(flags, dtype=upto.dtype, out=upto[1:])
    return np.diff(upto[offs]).astype(np.int64)


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text that rules and statistics are made of."""
    buf, offs = W.text_bytes(column)
    starts, ends, word_offs = W.word_spans(buf, offs)
    h = W.word_hashes(buf, starts, ends, lower=False)
    doc = W.doc_of(word_offs)
    own = W.mix(np.arange(len(offs) - 1, dtype=np.uint64), 77)
    out = {"n_words": np.diff(word_offs)}
    out["word_chars"] = _per_doc(_LETTER[buf], offs)
    out["n_symbols"] = _per_doc(_SYMBOL[buf], offs)
    out["n_marks"] = _per_doc(_MARK[buf], offs)
    upper = _CAPITAL[buf]
    if len(buf) > 1:  # the two-byte capitals from U+00C0 to U+00DE
        upper[1:] += (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    out["n_capitals"] = _per_doc(upper, offs)
    kinds = np.unique(h ^ own[doc], return_index=True)[1] if len(h) else np.zeros(0, np.int64)
    out["n_kinds"] = np.bincount(doc[kinds], minlength=len(offs) - 1)
    m = max(0, len(h) - WINDOW + 1)
    at = np.flatnonzero(W.inside_doc(word_offs, WINDOW, m))
    g = W.grams(h, WINDOW)[at] ^ own[doc[at]] if len(at) else np.zeros(0, np.uint64)
    _, where, count = np.unique(g, return_inverse=True, return_counts=True)
    again = W.covered(at[count[where] > 1] if len(at) else at, WINDOW, len(h))
    out["n_repeat_words"] = _per_doc(again.astype(np.int64), word_offs)
    data = buf.tobytes()
    dups, lines = np.zeros(len(offs) - 1, np.int64), np.zeros(len(offs) - 1, np.int64)
    for d in range(len(offs) - 1):
        full = [x for x in data[offs[d] : offs[d + 1]].split(b"\n") if x and not x.isspace()]
        lines[d], dups[d] = len(full), len(full) - len(set(full))
    return out | {"n_lines": lines, "n_dup_lines": dups}


def _stats() -> list[Column]:
    """Transformed statistics in units of 1/1024; short texts are drawn to ordinary values."""
    c = F.col
    raw = (
        (c("word_chars") + 250) / (c("n_words") + 50.0),
        F.sqrt(c("n_marks") / (c("n_words") + 50.0)),
        c("n_dup_lines") / (c("n_lines") + 5.0),
        F.log(c("n_kinds") + 50.0) / F.log(c("n_words") + 50.0),
        F.sqrt(c("n_capitals") / (c("word_chars") + 250.0)),
    )
    return [F.round(x * SCALE).cast("long").alias(n) for n, x in zip(STATS, raw)]


def _distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    d = [F.col(n) / float(SCALE) - F.col(mean)[i] for i, n in enumerate(STATS)]
    k = len(STATS)
    terms = [d[i] * d[j] * F.col(inverse)[i * k + j] * (1.0 if i == j else 2.0) for i in range(k) for j in range(i, k)]
    return F.greatest(F.lit(0.0), sum(terms[1:], terms[0]))


_PAIRS = [(i, j) for i in range(len(STATS)) for j in range(i, len(STATS))]
_BY = ["g_lang", "g_source", "level"]
_MODEL = "g_lang string, g_source string, level int, start int, mean array<double>, inverse array<double>, log_det double, settled boolean"
#: Products are summed in two whole parts.
_LOW = 20


def chi_square(df: int, x: float) -> float:
    """The chance that a chi-square variable is below ``x``."""
    a, x = df / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > 1e-17 * total:
        n += 1
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a))) if x > 0 else 0.0


def chi_square_quantile(df: int, p: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(df, middle) < p else (low, middle)
    return low


def consistency(share: float, df: int = len(STATS)) -> float:
    """What the scatter of the central ``share`` of a normal cloud is multiplied by."""
    return share / chi_square(df + 2, chi_square_quantile(df, share))


def _model_row(key: tuple, start: int, mean: np.ndarray, cov: np.ndarray, factor: float, settled: bool = False) -> dict:
    full = cov * factor + np.diag(FLOOR**2)
    return dict(zip(_BY, key)) | {"start": start, "mean": mean.tolist(), "inverse": np.linalg.inv(full).ravel().tolist(), "log_det": float(np.linalg.slogdet(full)[1]), "settled": settled}


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _MODEL.split(", ")])


def _clean(key: tuple) -> tuple:
    return tuple(None if x is None or x != x else x for x in key)


def _medians(factor: float):
    def start(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Medians and median deviations from histograms."""
        mean, sd = np.zeros(len(STATS)), np.zeros(len(STATS))

        def middle(values: np.ndarray, counts: np.ndarray) -> float:
            order = np.argsort(values, kind="stable")
            return values[order][np.searchsorted(np.cumsum(counts[order]), counts.sum() / 2)]

        for k in range(len(STATS)):
            part = pdf[pdf["stat"] == k]
            v, c = part["bin"].to_numpy() / 64.0, part["n"].to_numpy()
            mean[k] = middle(v, c)
            sd[k] = 1.4826 * middle(np.abs(v - mean[k]), c)
        return _frame([_model_row(_clean(key), 0, mean, np.diag(sd**2), factor)])

    return start


def _moments() -> list[Column]:
    out = [F.count("*").alias("n"), *(F.sum(n).alias(f"s{i}") for i, n in enumerate(STATS))]
    for i, j in _PAIRS:
        p = F.col(STATS[i]) * F.col(STATS[j])
        out += [F.sum(F.shiftright(p, _LOW)).alias(f"h{i}_{j}"), F.sum(p.bitwiseAND(F.lit((1 << _LOW) - 1))).alias(f"l{i}_{j}")]
    return out


def _estimate(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from rows of moments."""
    whole = lambda c: sum(int(x) for x in pdf[c])
    n = whole("n")
    s = [whole(f"s{i}") for i in range(len(STATS))]
    cov = np.zeros((len(STATS), len(STATS)))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = (n * ((whole(f"h{i}_{j}") << _LOW) + whole(f"l{i}_{j}")) - s[i] * s[j]) / (n * n) / SCALE**2
    return np.array(s) / n / SCALE, cov


def _subsets(factor: float):
    def start(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame([_model_row(_clean(key), int(s), *_estimate(part), factor) for s, part in pdf.groupby("start")])

    return start


def _concentrate(share: float, factor: float, best: bool):
    def step(key: tuple, sums: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        out = []
        for was in old.to_dict("records"):
            pdf = sums[sums["start"] == was["start"]].sort_values("bin", kind="stable")
            if not len(pdf):
                continue
            total = np.cumsum(pdf["n"].to_numpy())
            keep = pdf.iloc[: int(np.searchsorted(total, share * total[-1])) + 1]
            new = _model_row(_clean(key), int(was["start"]), *_estimate(keep), factor)
            if best and new["log_det"] >= was["log_det"] - 1e-9:  # it no longer falls
                new = was | dict(zip(_BY, _clean(key))) | {"settled": True}
            out.append(new)
        return _frame([min(out, key=lambda m: (m["log_det"], m["start"]))] if best and out else out)

    return step


def _same_group() -> Column:
    a, b = F.col("f.g_lang"), F.col("m.g_lang")
    return a.eqNullSafe(b) & F.col("f.g_source").eqNullSafe(F.col("m.g_source")) & (F.col("f.level") == F.col("m.level"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_words: int = 20, max_repeat_percent: int = 30, quantile: float = 0.9999, share: float = 0.75, min_rows: int = 200, with_text: bool = False) -> DataFrame:
    """Adds the base counts, ``base_failed``, ``distance`` (squared Mahalanobis) and ``kept``.

    ``quantile``: of a normal cloud such a share is kept.  The text itself is
    left out of the result unless ``with_text``.
    """
    kept = [c for c in docs.columns if c not in {*COUNTS, "base_failed", "distance", "kept"} and (with_text or c != text)]
    ship(docs.sparkSession)
    given = docs.select(bundle(kept), col(lang).cast("string").alias("__lang"), col(source).cast("string").alias("__source"), col(text).alias("__text"))
    names = [*COUNTS, *_MORE]
    schema = T.StructType([*given.drop("__text").schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    arrow = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches, "__text", 1 << 20):
            got = text_counts(t.column("__text"))
            out = [*(t.column(f.name).cast(f.type) for f in list(arrow)[: -len(names)]), *(pa.array(got[n], pa.int64()) for n in names)]
            yield from pa.table(out, schema=arrow).to_batches()
        W.trim()

    table, _ = materialise(given.mapInArrow(count, schema).select("*", *_stats()), "quality-stats")
    # groups that are large enough, and what small ones are pooled to
    sizes = table.groupBy("__lang", "__source").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < min_rows).groupBy("__lang").agg(F.sum("n").alias("pooled"))
    s, p = sizes.alias("s"), small.alias("p")
    level = F.when(F.col("s.n") >= min_rows, 0).when(F.col("p.pooled") >= min_rows, 1).otherwise(2)
    groups = s.join(p, F.col("s.__lang").eqNullSafe(F.col("p.__lang")), "left").select(F.col("s.__lang").alias("lang_"), F.col("s.__source").alias("source_"), level.alias("level"))
    groups, _ = materialise(groups.select("lang_", "source_", "level", F.when(F.col("level") < 2, F.col("lang_")).alias("g_lang"), F.when(F.col("level") < 1, F.col("source_")).alias("g_source")), "quality-groups")
    rows = table.join(groups, table["__lang"].eqNullSafe(groups["lang_"]) & table["__source"].eqNullSafe(groups["source_"])).drop("lang_", "source_")
    rows, _ = materialise(rows.withColumn("__known", F.lit(True)), "quality-rows")
    factor = consistency(share)
    bins = F.explode(F.array(*(F.struct(F.lit(i).alias("stat"), F.floor(F.col(n) * 64 / SCALE).cast("long").alias("bin")) for i, n in enumerate(STATS)))).alias("x")
    hist = rows.select(*_BY, bins).groupBy(*_BY, "x.stat", "x.bin").agg(F.count("*").alias("n"))
    totals = rows.groupBy(*_BY).agg(F.count("*").alias("total")).where(F.col("total") >= 16)
    totals, _ = materialise(totals, "quality-totals")
    same = lambda a, b: F.col(f"{a}.g_lang").eqNullSafe(F.col(f"{b}.g_lang")) & F.col(f"{a}.g_source").eqNullSafe(F.col(f"{b}.g_source")) & (F.col(f"{a}.level") == F.col(f"{b}.level"))
    middle = hist.alias("h").join(totals.alias("t"), same("h", "t"), "left_semi").groupBy(*_BY).applyInPandas(_medians(factor), _MODEL)
    drawn = F.filter(F.array(*(F.when(F.pmod(F.xxhash64(*STATS, F.lit(k)), F.lit(2**31)) * F.col("total") < SUBSET * 2**31, k) for k in range(1, STARTS + 1))), lambda k: k.isNotNull())
    picked = rows.alias("r").join(totals.alias("t"), same("r", "t")).select(*(F.col(f"r.{c}") for c in _BY), *STATS, F.explode(drawn).alias("start"))
    seeded = picked.groupBy(*_BY, "start").agg(*_moments()).groupBy(*_BY).applyInPandas(_subsets(factor), _MODEL)
    model, _ = materialise(middle.unionByName(seeded), "quality-model")
    for k in range(MOST_STEPS):
        active = model.where(~F.col("settled"))
        if k > 2 and active.isEmpty():
            break
        f, m = rows.alias("f"), active.alias("m")
        near = f.join(m, _same_group()).select(*(F.col(f"f.{c}") for c in _BY), F.col("m.start").alias("start"), *STATS, F.floor(F.log(_distance() + F.lit(1e-6)) * 32).cast("long").alias("bin"))
        sums = near.groupBy(*_BY, "start", "bin").agg(*_moments())
        was = active.select(*(F.col(c).alias(c) for c in active.columns))
        new = sums.groupBy(*_BY).cogroup(was.groupBy(*_BY)).applyInPandas(_concentrate(share, factor, k > 1), _MODEL)
        model, _ = materialise(new.unionByName(model.where("settled")), "quality-model")
    cutoff = chi_square_quantile(len(STATS), quantile)
    f, m = rows.alias("f"), model.alias("m")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = f.join(m, _same_group(), "left").select(*unbundle(kept, f"f.{DOC}"), *COUNTS, failed.alias("base_failed"), _distance().alias("distance"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff))

