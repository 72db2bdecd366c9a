"""Expressions over several namespaces, each with rows and times of its own.

A window counts the rows of its own namespace up to the time of evaluation.  So
an expression is cut into its largest parts that use one namespace only; each
part is computed where its rows are (a scalar, or the array of a window) and
travels to the rows of evaluation as the last value at or before them.  What is
above the parts is then put together there.  One shuffle by asset for each
panel and one for the union that carries the parts; no range join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import expr as X
from ..plans import registry
from ..plans.compiler import Compiler, Given, Prepared
from ..sources.panels import field_columns
from .factors import forward_return, lengthen


class Parts:
    """The one-namespace parts of some trees, each with the column that it becomes."""

    def __init__(self) -> None:
        self.columns: dict[tuple[str, X.Node], str] = {}

    def cut(self, node: X.Node) -> X.Node | Given:
        """The tree with its parts replaced; equal parts share a column."""
        spaces = {w.space for w in X.windows(node)}
        if not spaces:
            return node
        if len(spaces) == 1:
            name = self.columns.setdefault((spaces.pop(), node), f"__part{len(self.columns)}")
            return Given(name, node.kind)
        return X.Apply(node.name, tuple(self.cut(a) for a in node.args), node.kind)

    def of(self, space: str) -> dict[str, X.Node]:
        return {name: node for (s, node), name in self.columns.items() if s == space}


def _usable(texts: Sequence[str], loaded: set[str], limits: X.Limits) -> list[X.Node | None]:
    """The trees of expressions; None for what cannot be read, breaks a limit or needs a namespace that is not loaded."""
    out: list[X.Node | None] = []
    for text in texts:
        try:
            node = X.validate(text, limits)
            out.append(node if {registry.space(w.space).name for w in X.windows(node)} <= loaded else None)
        except (X.ExpressionError, ValueError):
            out.append(None)
    return out


def _part(compiler: Compiler, node: X.Node) -> Column:
    return compiler.array(node) if node.kind == X.ARRAY else compiler.scalar(node)


def across_frame(panels: Mapping[str, DataFrame], exprs: Sequence[str], base: str, min_history: int = 1, price: str | None = None, horizon: int = 1, limits: X.Limits = X.Limits()) -> DataFrame:
    """``asset, ts, f0, f1, ...`` (and ``fwd`` with ``price``) at the rows of the namespace ``base``.

    ``panels``: a panel for each namespace, over the same assets.  Rows of another namespace at the
    very time of evaluation are visible.  ``min_history`` counts rows of ``base``.  An asset that
    another namespace does not have, or not yet, has no values there.
    """
    loaded = {registry.space(n).name: p for n, p in panels.items()}
    base = registry.space(base).name
    if base not in loaded:
        raise ValueError(f"the namespace {base} is not loaded")
    parts = Parts()
    trees = [t and parts.cut(t) for t in _usable(exprs, set(loaded), limits)]
    everywhere = Window.partitionBy("asset").orderBy("ts")
    rows = None
    for name, panel in loaded.items():
        own = parts.of(name)
        if not own and name != base:
            continue
        compiler = Compiler({k.lower(): v for k, v in field_columns(name).items()}, prepared=Prepared())
        cells = [_part(compiler, node).alias(c) for c, node in own.items()] or [F.lit(1).alias("__one")]
        panel = compiler.prepared.add_to(panel, compiler)
        more = []
        if name == base:
            more = [F.row_number().over(everywhere).alias("__row"), *([forward_return(price, horizon).alias("fwd")] if price else [])]
        here = panel.select("asset", "ts", F.struct(*cells).alias(f"__{name}"), F.lit(int(name == base)).alias("__side"), *more)
        rows = here if rows is None else rows.unionByName(here, allowMissingColumns=True)
    order = Window.partitionBy("asset").orderBy("ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    others = [n for n in loaded if n != base and parts.of(n)]
    if others:
        # the base's own rows come last of their time, so they see all of it
        rows = rows.select("*", *(F.last(f"__{n}", ignorenulls=True).over(order).alias(f"__last_{n}") for n in others)).where("__side = 1")
    flat = [F.col(f"__{'' if n == base else 'last_'}{n}").getField(c).alias(c) for n in loaded for c in parts.of(n)]
    met = rows.where(F.col("__row") >= min_history).select("asset", "ts", *(["fwd"] if price else []), *flat)
    joint = Compiler({})
    values = [F.lit(None).cast("double") if t is None else joint.root(t) for t in trees]
    return met.select("asset", "ts", *(v.alias(f"f{i}") for i, v in enumerate(values)), *(["fwd"] if price else []))


def across_long(panels: Mapping[str, DataFrame], exprs: Sequence[str], base: str, min_history: int = 1, price: str | None = None, horizon: int = 1) -> DataFrame:
    """``expr_id, ts, asset, factor`` (and ``fwd``), as ``factors.factor_long`` has it for one namespace."""
    return lengthen(across_frame(panels, exprs, base, min_history, price, horizon), len(exprs))
