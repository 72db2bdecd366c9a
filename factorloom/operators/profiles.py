"""The closest archived metric profile of each candidate, by an exact pruned index.

Closeness is the absolute Pearson correlation over the finite metrics that two
profiles share.  On a fixed set of metrics it is the cosine between lines, so
the angle ``acos |corr|`` is a metric.  For each set of metrics that a kind of
candidate shares with a kind of record (kind: which metrics are finite), the
archived profiles become unit vectors and go to the nearest of some pivots.  A
candidate first meets its nearest cell, which gives a lower bound of its
result, then the cells that the triangle inequality cannot rule out:
``corr <= cos(angle to the pivot - radius of the cell)``.  Cells meet candidates
in blocks by equi-joins, as products of two small matrices; nothing is joined
without a key, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guarded import is_finite
from ..workers import cut, ship

#: Added to bounds, so that rounding of angles rules nothing out.
SLACK = 1e-6
#: The spread at or under which a profile has no direction.
FLAT = 1e-12


def _known(metrics: Column) -> Column:
    return F.map_filter(metrics, lambda _, v: F.coalesce(is_finite(v.cast("double")), F.lit(False)))


def _unit(known: Column, shared: Column) -> Column:
    """The profile over the shared metrics as a unit vector around its mean; missing without spread."""
    one = lambda c, body: F.get(F.transform(F.array(c), body), F.lit(0))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))

    def centred(x: Column) -> Column:
        return one(total(x, lambda v: v) / F.size(x), lambda m: F.transform(x, lambda v: v - m))

    def scaled(x: Column) -> Column:
        n2 = total(x, lambda v: v * v)
        return one(n2, lambda s: F.when(F.sqrt(s / F.size(x)) > FLAT, F.transform(x, lambda v: v / F.sqrt(s))))

    return one(F.transform(shared, lambda k: F.try_element_at(known, k).cast("double")), lambda x: one(centred(x), scaled))


def _spaces(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """``c_kind, r_kind, space``: a kind of record, and the metrics (two at least) that a kind of candidate shares with it."""
    side = lambda df, name: df.select(F.col("kind").alias(name)).distinct().select(name, F.explode(name).alias("metric"))
    met = side(candidates, "c_kind").join(side(records, "r_kind"), "metric").groupBy("c_kind", "r_kind").agg(F.array_sort(F.collect_list("metric")).alias("shared"))
    return met.where(F.size("shared") >= 2).select("c_kind", "r_kind", F.struct("shared", "r_kind").alias("space"))


def _vectors(rows: DataFrame, spaces: DataFrame, kind: str, *carry: str) -> DataFrame:
    found = rows.join(spaces.select(F.col(kind).alias("kind"), "space").distinct(), "kind")
    return found.select(*carry, "space", _unit(F.col("known"), F.col("space.shared")).alias("u")).where(F.col("u").isNotNull())


def _blocks(rows: DataFrame, by: Sequence[str], most: int, *carry: str) -> DataFrame:
    """``by, part, held``: the ``carry`` columns of about ``most`` rows of one key as an array, however many a key has."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64(*carry), F.ceil(F.col("n") / most)).alias("part")
    return rows.join(counts, list(by)).groupBy(*by, part).agg(F.collect_list(F.struct(*carry)).alias("held"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """An array of equal lists of doubles, one of them in a row."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _angles(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.arccos(np.minimum(1.0, np.abs(u @ v.T)))


def _placed(blocks: DataFrame, schema: str) -> DataFrame:
    """Each vector of ``space, held, pivots`` rows with its nearest pivot and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = batch.column("held")[i].values
                angles = _angles(_matrix(held.field("u")), _matrix(batch.column("pivots")[i].values))
                cell = angles.argmin(axis=1)
                columns = [batch.column("space").take(pa.array([i] * len(held))), held.field("u"), pa.array(cell, pa.int32()), pa.array(angles[np.arange(len(held)), cell])]
                yield pa.RecordBatch.from_arrays(columns, names=["space", "u", "cell", "angle"])

    return blocks.select("space", "held", "pivots").mapInArrow(run, schema)


def _asked(blocks: DataFrame, schema: str, rest: bool) -> DataFrame:
    """``ordinal, space, u, cell`` of the candidates of ``space, held, pivots, radii`` rows.

    The cell is the one with the least lower bound of the angle or, with ``rest``, each other one
    that may hold a closer profile than ``c`` is.  A profile of a cell is at least the angle to the
    pivot less the radius away, and, as no pivot is nearer to it than its own, at least half of what
    its own pivot is farther away than the nearest one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, radii = batch.column("held")[i].values, batch.column("radii")[i].values
                pivots, cells = _matrix(batch.column("pivots")[i].values), radii.field("cell").to_numpy()
                angles = _angles(_matrix(held.field("u")), pivots)
                farther = (angles - angles.min(axis=1, keepdims=True)) / 2
                least = np.maximum(np.maximum(angles[:, cells] - radii.field("radius").to_numpy(), farther[:, cells]) - SLACK, 0.0)
                first = least.argmin(axis=1)
                if rest:
                    open_ = np.cos(least) > held.field("c").to_numpy()[:, None]
                    open_[np.arange(len(held)), first] = False
                    rows, at = np.nonzero(open_)
                else:
                    rows, at = np.arange(len(held)), first
                chosen = pa.array(rows)
                columns = [held.field("ordinal").take(chosen), batch.column("space").take(pa.array([i] * len(rows), pa.int32())), held.field("u").take(chosen), pa.array(cells[at], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["ordinal", "space", "u", "cell"])

    return blocks.select("space", "held", "pivots", "radii").mapInArrow(run, schema)


def _met(blocks: DataFrame, schema: str) -> DataFrame:
    """``ordinal, space, u, c, k``: the closest of the ``records`` of a row for each candidate that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, records = batch.column("held")[i].values, _matrix(batch.column("records")[i].values.field("u"))
                most = np.minimum(1.0, np.abs(_matrix(held.field("u")) @ records.T).max(axis=1))
                columns = [held.field("ordinal"), batch.column("space").take(pa.array([i] * len(held))), held.field("u"), pa.array(most), pa.array([len(records)] * len(held), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["ordinal", "space", "u", "c", "k"])

    return blocks.select("space", "held", "records").mapInArrow(run, schema)


def closest_profiles(candidates: DataFrame, archive: DataFrame, pivots: int = 64, block: int = 1024, compared: bool = False) -> DataFrame:
    """``ordinal, closest`` for the ``ordinal, metrics`` rows that share metrics with some of ``archive`` (``metrics``).

    ``pivots``: cells of each set of metrics, at least; there are as many as the square root of its
    profiles if that is more.  ``block``: the profiles or candidates that meet at once, about.
    ``compared``: adds the number of profiles that each candidate met.
    """
    ship(candidates.sparkSession)
    kinds = lambda df, *more: df.where(F.col("metrics").isNotNull()).select(*more, _known(F.col("metrics")).alias("known")).withColumn("kind", F.array_sort(F.map_keys("known")))
    asked, records = kinds(candidates, "ordinal"), kinds(archive)
    spaces = _spaces(asked, records)
    vectors = cut(_vectors(records, spaces, "r_kind").distinct())
    # one vector for each hash of as many as there are pivots; which ones they are changes only the work
    wanted = vectors.groupBy("space").agg(F.greatest(F.lit(pivots), F.ceil(F.sqrt(F.count("*")))).alias("m"))
    spread = vectors.join(wanted, "space").groupBy("space", F.pmod(F.xxhash64("u"), F.col("m")).alias("h")).agg(F.min("u").alias("u"))
    chosen = spread.groupBy("space").agg(F.sort_array(F.collect_list("u")).alias("pivots"))

    space = f"space {vectors.schema['space'].dataType.simpleString()}, u array<double>"
    ordinal = f"ordinal {candidates.schema['ordinal'].dataType.simpleString()}"
    placed = cut(_placed(_blocks(vectors, ["space"], block, "u").join(chosen, "space"), f"{space}, cell int, angle double"))
    radii = placed.groupBy("space", "cell").agg(F.max("angle").alias("radius")).groupBy("space").agg(F.collect_list(F.struct("cell", "radius")).alias("radii"))
    index = chosen.join(radii, "space")
    parts = cut(_blocks(placed, ["space", "cell"], block, "u").withColumnRenamed("held", "records"))
    numbers = parts.groupBy("space", "cell").agg(F.collect_list("part").alias("parts"))

    def meet(rows: DataFrame) -> DataFrame:
        # blocks of candidates go to each part of their cell; what meets is bounded on both sides
        blocks = _blocks(rows, ["space", "cell"], block, "ordinal", "u").withColumnRenamed("part", "queries")
        to = blocks.join(numbers, ["space", "cell"]).select("space", "cell", "queries", "held", F.explode("parts").alias("part"))
        return _met(to.join(parts, ["space", "cell", "part"]), f"{ordinal}, {space}, c double, k long")

    # a candidate of two spaces asks in both; bounds hold in each on its own
    queries = cut(_vectors(asked, spaces, "c_kind", "ordinal"))
    first = _asked(_blocks(queries, ["space"], block, "ordinal", "u").join(index, "space"), f"{ordinal}, {space}, cell int", False)
    start = cut(meet(first).groupBy("ordinal", "space", "u").agg(F.max("c").alias("c"), F.sum("k").alias("k")))
    rest = meet(_asked(_blocks(start, ["space"], block, "ordinal", "u", "c").join(index, "space"), f"{ordinal}, {space}, cell int", True))
    out = start.unionByName(rest).groupBy("ordinal").agg(F.max("c").alias("closest"), F.sum("k").alias("compared"))
    return out if compared else out.drop("compared")
