"""Expressions as Spark columns over a long panel.

Four rules, all over one partitioning (asset) and order (ts):

1. an array whose elements are values of their own rows (fields, element-wise
   functions of fields of one length, differences of those) is reduced by a
   native window aggregate over that value; ``zscore`` and ``normalize`` of it
   are the same values moved and scaled by two scalars of the row of evaluation,
   and so are its reductions;
2. of an array root only the last element is needed, so element-wise functions
   work on row values and window scalars, without arrays;
3. the last ``ema`` and ``rank`` of such an array are one scan along the asset
   (``functions.sliding``), which keeps one window and not one for each row;
4. what is left builds the window as an array and uses higher-order functions.

Differences and scans are columns that must be there before the others: a
``Prepared`` collects them while expressions are compiled and adds them to the
panel.  Without one, rule 4 does their work.

Missing values are NULL.  A window counts rows, missing ones included.  Arrays
of different lengths combine as length 1 or not at all; lengths are those at
the row (shorter at the start of an asset), and what does not combine is
missing.  ``arrays_only`` forces rule 4, which tests hold against the others.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.guarded import EPS, INF, covariance, divide, finite, is_finite, pearson
from ..functions.sliding import Scan, scan_columns
from . import expr as X

_EMPTY = "array<double>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: higher-order functions would compute it for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _known(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v)


def _null() -> Column:
    return F.lit(None).cast("double")


@dataclass(frozen=True)
class Given:
    """A subtree that is a column already: a double, or the array of a window's values (NULL: none)."""

    column: str
    kind: str


@dataclass
class Prepared:
    """Columns that compiled expressions need beside the panel's: row values, then scans along them."""

    values: dict[X.Node, tuple[str, Column]] = field(default_factory=dict)
    scans: dict[Scan, str] = field(default_factory=dict)

    def value(self, node: X.Node, column: Column) -> str:
        return self.values.setdefault(node, (f"__value{len(self.values)}", column))[0]

    def scan(self, scan: Scan) -> str:
        return self.scans.setdefault(scan, f"__scan{len(self.scans)}")

    def add_to(self, panel: DataFrame, compiler: Compiler) -> DataFrame:
        for name, column in self.values.values():  # a difference may be of a difference
            panel = panel.withColumn(name, column)
        if not self.scans:
            return panel
        keys = [compiler.asset, *([compiler.block] if compiler.block else [])]
        return scan_columns(panel, [(s, n) for s, n in self.scans.items()], keys, compiler.ts, compiler.place)


@dataclass(frozen=True)
class Affine:
    """Values of rule 1 (``base`` is their tree), moved and scaled by columns of the row of evaluation; a missing scale makes all missing."""

    base: X.Node
    value: Column
    rows: int
    lost: int
    shift: Column | None = None
    scale: Column | None = None

    def apply(self, c: Column, times: Column | float = 1.0) -> Column:
        """What is ``c`` of the values, of the array; ``times``: how often the shift is in it."""
        moved = c if self.shift is None or isinstance(times, float) and times == 0.0 else c - times * self.shift
        return moved if self.scale is None else F.try_divide(moved, self.scale)


@dataclass(frozen=True)
class Compiler:
    """Compiles trees for one panel: its asset and time columns, and the column of each field.

    ``block`` and ``place`` are columns of a panel cut into blocks of time (see
    ``operators.blocks``): windows stay in a block, which has the rows they
    reach back to, and the row number of an asset is the one given.
    """

    columns: Mapping[str, str]
    asset: str = "asset"
    ts: str = "ts"
    arrays_only: bool = False
    block: str | None = None
    place: str | None = None
    prepared: Prepared | None = None

    # frames
    def over(self):
        return W.partitionBy(self.asset, *([self.block] if self.block else [])).orderBy(self.ts)

    def frame(self, n: int):
        return self.over().rowsBetween(-(n - 1), 0)

    def row(self) -> Column:
        return F.col(self.place) if self.place else F.row_number().over(self.over())

    def value(self, w: X.Window) -> Column:
        name = self.columns.get(w.full_name.lower())
        if name is None:
            raise X.LimitProblem(f"the panel has no {w.full_name}")
        return F.col(name)

    def by_row(self, node: X.Node) -> tuple[Column, int, int] | None:
        """(value, n, d) if the array has the values of the last n rows so far but the asset's first d ones, else None."""
        if self.arrays_only or isinstance(node, (Given, X.Number)) or node.kind != X.ARRAY:
            return None
        if isinstance(node, X.Window):
            return self.value(node), node.length, 0
        name, args = X.ALIASES.get(node.name, node.name), node.args
        if name in X.ARITHMETIC:
            if any(not isinstance(a, X.Number) and a.kind == X.SCALAR for a in args):
                return None  # a scalar belongs to the row of evaluation
            sides = [F.lit(float(a.value)) if isinstance(a, X.Number) else self.by_row(a) for a in args]
            arrays = [s for s in sides if not isinstance(s, Column)]
            if None in arrays or len({s[1:] for s in arrays}) != 1:
                return None
            return _binary(name, *(s if isinstance(s, Column) else s[0] for s in sides)), *arrays[0][1:]
        if name not in X.ELEMENT and name not in ("log", "diff"):
            return None
        inner = self.by_row(args[0])
        if inner is None:
            return None
        value, n, d = inner
        if name == "diff":
            if self.prepared is None:
                return None
            return F.col(self.prepared.value(node, value - F.lag(value).over(self.over()))), n, d + 1
        return _log(value) if name == "log" else _unary(name, value), n, d

    def affine(self, node: X.Node) -> "Affine | None":
        """An array that is ``(value - shift) / scale`` with shift and scale of the row of evaluation: ``zscore`` and ``normalize`` of rule 1."""
        rows = self.by_row(node)
        if rows:
            return Affine(node, *rows)
        if self.arrays_only or not isinstance(node, X.Apply) or node.name not in ("zscore", "normalize"):
            return None
        inner = self.affine(node.args[0])
        if inner is None or inner.rows <= inner.lost or (node.name == "normalize" and inner.shift is not None):
            return None
        x = inner.value if isinstance(inner.base, X.Window) else F.when(_known(inner.value), inner.value)
        frame = self.frame(inner.rows - inner.lost)
        if node.name == "zscore":
            shift, scale = F.avg(x).over(frame), F.stddev_pop(x).over(frame)
        else:
            shift, scale = None, F.sum(F.abs(x)).over(frame)
        seen = scale if inner.scale is None else F.try_divide(scale, inner.scale)  # as the values themselves have it
        return Affine(inner.base, x, inner.rows, inner.lost, shift, F.when((seen > EPS) & (seen < INF), scale))

    # lengths of arrays at a row: (n, d) is min(n, rows so far) - d
    def span(self, node: X.Node) -> tuple[int, int] | None:
        if isinstance(node, X.Window):
            return node.length, 0
        if isinstance(node, X.Apply) and node.kind == X.ARRAY:
            if node.name in X.ARITHMETIC:
                spans = [self.span(a) for a in node.args if a.kind == X.ARRAY]
                return spans[0] if len(set(spans)) == 1 else None
            inner = self.span(node.args[0])
            return (inner[0], inner[1] + 1) if inner and node.name == "diff" else inner
        return None

    def length(self, node: X.Node) -> Column:
        if isinstance(node, Given):
            return F.size(node.column)
        known = self.span(node)
        if known:
            return F.greatest(F.least(F.lit(known[0]), self.row()) - F.lit(known[1]), F.lit(0))
        if node.name == "diff":
            return F.greatest(self.length(node.args[0]) - 1, F.lit(0))
        if node.name in X.ARITHMETIC:
            arrays = [a for a in node.args if a.kind == X.ARRAY]
            if len(arrays) == 1:
                return self.length(arrays[0])
            a, b = (self.length(x) for x in arrays)
            return F.when(a == 1, b).otherwise(a)
        return self.length(node.args[0])

    # values of scalars
    def scalar(self, node: X.Node) -> Column:
        if isinstance(node, X.Number):
            return F.lit(float(node.value))
        if isinstance(node, Given):
            return F.col(node.column)
        name, args = X.ALIASES.get(node.name, node.name), node.args
        if name in X.ARITHMETIC:
            return _binary(name, self.scalar(args[0]), self.scalar(args[1]))
        if name in X.ELEMENT:
            return _unary(name, self.scalar(args[0]))
        if name in X.PAIR:
            sides = [self.affine(a) for a in args]
            if all(sides):
                size = min(x.rows - x.lost for x in sides)
                if size < 1:
                    return _null()
                return _affine_pair(name, *sides, self.frame(size))
            return _let(self.array(args[0]), lambda a: _let(self.array(args[1]), lambda b: _pair(name, a, b)))
        source = args[0]
        if name == "last" and not self.arrays_only:
            return self.last(source)
        rows = self.affine(source)
        if rows and rows.rows <= rows.lost:
            return _null()
        if rows and (name != "first" or rows.lost == 0):
            x, frame = finite(rows.value), self.frame(rows.rows - rows.lost)
            if name == "first":
                return rows.apply(F.first_value(rows.value).over(frame))
            if name == "ts_std":
                return rows.apply(F.stddev_pop(x).over(frame), 0.0)
            if name == "ts_sum":
                return rows.apply(F.sum(x).over(frame), F.count(x).over(frame))
            fn = {"ts_mean": F.avg, "ts_min": F.min, "ts_max": F.max}[name]
            return rows.apply(fn(x).over(frame))
        return _let(self.array(source), lambda a: _reduce(name, a))

    # the last element of an array
    def last(self, node: X.Node) -> Column:
        if self.arrays_only or isinstance(node, Given):
            return F.try_element_at(self.array(node), F.lit(-1))
        if isinstance(node, X.Window):
            return self.value(node)
        name, args = X.ALIASES.get(node.name, node.name), node.args
        if name in X.ELEMENT:
            return _unary(name, self.last(args[0]))
        if name == "log":
            return _log(self.last(args[0]))
        if name in X.ARITHMETIC:
            if X.SCALAR in (args[0].kind, args[1].kind):
                a, b = (self.last(x) if x.kind == X.ARRAY else self.scalar(x) for x in args)
                return _binary(name, a, b)
            out = _binary(name, self.last(args[0]), self.last(args[1]))
            if self.span(args[0]) == self.span(args[1]) and self.span(args[0]):
                return out
            a, b = self.length(args[0]), self.length(args[1])
            return F.when(((a == b) | (a == 1) | (b == 1)) & (a > 0) & (b > 0), out)
        source = args[0]
        if isinstance(source, X.Window) and name == "diff":
            x = self.value(source)
            return x - F.lag(x).over(self.over()) if source.length > 1 else _null()
        if name == "diff":
            rows = self.by_row(node)
            if rows:
                return rows[0] if rows[1] > rows[2] else _null()
        elif name in ("zscore", "normalize"):
            rows = self.affine(node)
            if rows:
                return rows.apply(rows.value)
        elif self.prepared is not None:
            rows = self.affine(source)
            if rows and rows.rows <= rows.lost:
                return _null()
            if rows:
                found = F.col(self.prepared.scan(Scan(name, self.prepared.value(rows.base, rows.value), rows.rows, rows.lost)))
                # moving and scaling leaves places as they are, and is the same before a weighted mean and after it
                return rows.apply(found) if name == "ema" else found if rows.scale is None else F.when(rows.scale.isNotNull(), found)
        if name == "ema":
            return _let(self.array(source), _ema_last)
        if name == "rank":
            return _let(self.array(source), _rank_last)
        return F.try_element_at(self.array(node), F.lit(-1))

    # whole arrays; a NULL array is what could not be combined
    def array(self, node: X.Node) -> Column:
        if isinstance(node, Given):
            return F.col(node.column)
        if isinstance(node, X.Window):
            return F.collect_list(F.struct(self.value(node).alias("v"))).over(self.frame(node.length)).getField("v")
        name, args = X.ALIASES.get(node.name, node.name), node.args
        if name in X.ELEMENT:
            return F.transform(self.array(args[0]), lambda v: _unary(name, v))
        if name in X.ARITHMETIC:
            if args[0].kind == X.SCALAR:
                s = self.scalar(args[0])
                return F.transform(self.array(args[1]), lambda v: _binary(name, s, v))
            if args[1].kind == X.SCALAR:
                s = self.scalar(args[1])
                return F.transform(self.array(args[0]), lambda v: _binary(name, v, s))
            equal = self.span(args[0]) == self.span(args[1]) and self.span(args[0]) is not None
            return _let(self.array(args[0]), lambda a: _let(self.array(args[1]), lambda b: _combine(name, a, b, equal)))
        return _let(self.array(args[0]), lambda a: _map(name, a))

    def root(self, node: X.Node) -> Column:
        """One double for each row: the scalar, or the last element; infinities are missing."""
        return finite(self.scalar(node) if node.kind == X.SCALAR else self.last(node))


def _binary(name: str, a: Column, b: Column) -> Column:
    return {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: divide(a, b)}[name]()


def _affine_pair(name: str, a: Affine, b: Affine, frame) -> Column:
    """corr and cov over the rows where both are known; moving and scaling only matters to what counts as no spread."""
    if name == "cov":
        return b.apply(a.apply(covariance(a.value, b.value, frame), 0.0), 0.0)
    if a.scale is None and b.scale is None:
        return pearson(a.value, b.value, frame)
    both = is_finite(a.value) & is_finite(b.value)
    x, y = F.when(both, a.value), F.when(both, b.value)
    sx, sy = F.stddev_pop(x).over(frame), F.stddev_pop(y).over(frame)
    spread = (F.count(x).over(frame) >= 2) & (a.apply(sx, 0.0) > EPS) & (b.apply(sy, 0.0) > EPS)
    return F.when(spread, finite(F.try_divide(F.covar_pop(x, y).over(frame), sx * sy)))


def _unary(name: str, a: Column) -> Column:
    return {"neg": lambda: -a, "abs": lambda: F.abs(a), "tanh": lambda: F.tanh(a), "sign": lambda: _sign(a)}[name]()


def _sign(a: Column) -> Column:
    """What is all but zero has no sign: a sum in another order would give it another one."""
    return F.when(F.abs(a) < EPS, F.lit(0.0)).otherwise(F.signum(a))


def _log(v: Column) -> Column:
    return F.when((v > 0) & ~F.isnan(v), F.ln(v))


def _combine(name: str, a: Column, b: Column, equal: bool) -> Column:
    """Two arrays element by element; of unequal lengths only if one has a single element."""
    same = F.zip_with(a, b, lambda x, y: _binary(name, x, y))
    if equal:
        return same
    one_a = F.transform(b, lambda y: _binary(name, F.try_element_at(a, F.lit(1)), y))
    one_b = F.transform(a, lambda x: _binary(name, x, F.try_element_at(b, F.lit(1))))
    return F.when(F.size(a) == F.size(b), same).when(F.size(a) == 1, one_a).when(F.size(b) == 1, one_b)


def _map(name: str, a: Column) -> Column:
    """A function from array to array."""
    if name == "log":
        return F.transform(a, _log)
    if name == "diff":
        k = F.greatest(F.size(a) - 1, F.lit(0))
        step = F.zip_with(F.slice(a, F.lit(2), k), F.slice(a, F.lit(1), k), lambda p, q: p - q)
        return F.when(F.size(a) > 1, step).when(a.isNotNull(), F.array().cast(_EMPTY))
    if name == "normalize":
        total = F.aggregate(F.filter(a, _known), F.lit(0.0), lambda s, v: s + F.abs(v))
        return _let(total, lambda t: F.transform(a, lambda v: F.when((t > EPS) & (t < INF), F.try_divide(v, t))))
    if name == "zscore":
        scaled = lambda m, s: F.transform(a, lambda v: F.when((s > EPS) & (s < INF), F.try_divide(v - m, s)))
        return _let(F.filter(a, _known), lambda k: _let(_mean(k), lambda m: _let(_spread(k, m), lambda s: scaled(m, s))))
    if name == "rank":
        place = F.transform(a, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
        below = lambda p, q: is_finite(q["v"]) & ((q["v"] < p["v"]) | ((q["v"] == p["v"]) & (q["i"] <= p["i"])))
        return _let(place, lambda ps: F.transform(ps, lambda p: F.when(is_finite(p["v"]), F.size(F.filter(ps, lambda q: below(p, q))).cast("double"))))
    if name == "ema":
        alpha = F.try_divide(F.lit(2.0), F.size(a) + F.lit(1.0))
        step = lambda acc, v: F.concat(acc, F.array(_ema_step(F.try_element_at(acc, F.lit(-1)), v, alpha)))
        return F.when(a.isNotNull(), F.aggregate(a, F.array().cast(_EMPTY), step))
    raise X.LimitProblem(f"{name} gives no array")


def _rank_last(a: Column) -> Column:
    below = lambda v: F.size(F.filter(a, lambda u: is_finite(u) & (u <= v))).cast("double")
    return _let(F.try_element_at(a, F.lit(-1)), lambda v: F.when(is_finite(v), below(v)))


def _mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), F.size(a).cast("double")))


def _spread(a: Column, mean: Column) -> Column:
    """Population standard deviation around a known mean."""
    squares = F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
    return F.when(F.size(a) > 0, F.sqrt(F.try_divide(squares, F.size(a).cast("double"))))


def _reduce(name: str, a: Column) -> Column:
    if name in ("first", "last"):
        return F.try_element_at(a, F.lit(1 if name == "first" else -1))
    return _let(F.filter(a, is_finite), lambda f: _reduce_finite(name, f))


def _reduce_finite(name: str, f: Column) -> Column:
    if name == "ts_mean":
        return _mean(f)
    if name == "ts_std":
        return _let(_mean(f), lambda m: _spread(f, m))
    if name == "ts_sum":
        return F.when(F.size(f) > 0, F.aggregate(f, F.lit(0.0), lambda s, v: s + v))
    return F.array_min(f) if name == "ts_min" else F.array_max(f)


def _pair(name: str, a: Column, b: Column) -> Column:
    """corr and cov of two arrays, aligned at their ends."""

    def tail(x: Column, n: Column) -> Column:
        return F.when(n > 0, F.slice(x, -n, n)).when(x.isNotNull(), F.array().cast(_EMPTY))

    def of_pairs(pairs: Column) -> Column:
        return _let(F.transform(pairs, lambda p: p["x"]), lambda x: _let(F.transform(pairs, lambda p: p["y"]), lambda y: of_sides(pairs, x, y)))

    def of_sides(pairs: Column, x: Column, y: Column) -> Column:
        return _let(_mean(x), lambda mx: _let(_mean(y), lambda my: of_means(pairs, x, y, mx, my)))

    def of_means(pairs: Column, x: Column, y: Column, mx: Column, my: Column) -> Column:
        sums = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["x"] - mx) * (p["y"] - my))
        cov = F.try_divide(sums, F.size(pairs).cast("double"))
        if name == "cov":
            return F.when(F.size(pairs) >= 2, cov)
        return _let(_spread(x, mx), lambda sx: _let(_spread(y, my), lambda sy: F.when((F.size(pairs) >= 2) & (sx > EPS) & (sy > EPS), F.try_divide(cov, sx * sy))))

    def aligned(n: Column) -> Column:
        zipped = F.zip_with(tail(a, n), tail(b, n), lambda p, q: F.struct(p.alias("x"), q.alias("y")))
        return _let(F.filter(zipped, lambda p: is_finite(p["x"]) & is_finite(p["y"])), of_pairs)

    return _let(F.least(F.size(a), F.size(b)), aligned)


def _ema_step(acc: Column, v: Column, alpha: Column) -> Column:
    return F.when(~F.coalesce(is_finite(v), F.lit(False)), acc).when(acc.isNull(), v).otherwise(alpha * v + (1 - alpha) * acc)


def _ema_last(a: Column) -> Column:
    alpha = F.try_divide(F.lit(2.0), F.size(a) + F.lit(1.0))
    return F.aggregate(a, _null(), lambda acc, v: _ema_step(acc, v, alpha))
