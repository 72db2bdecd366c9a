"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations.

Documents of a source are shuffled by a hash of their id and queue for
``max_repeats`` rounds.  A copy's virtual finish time is the number of source
words up to its end divided by the source's target, and the mix is the start of
the global order of finish times that fits the total budget.  No sort sees a
whole source: words are summed by (source, hash bucket), offsets come from the
bucket sums and are merged in on the partitioning that the buckets have, and
exact order is only made inside buckets.  The place where the budget ends is
found in a histogram of finish times, whose bin is cut into 4,096 again while
it holds more than ``most_edge`` copies, then exactly in that bin.

Targets: the budget is shared by weight; a source cannot give more than
``max_repeats`` times its size, and what is over goes to the others by weight.

Definitions for odd input: a null or empty text has size 0 and nothing taken; a
null source is a source of its own, last in order; null ids are shuffled as the
empty string; repeated rows (equal id, source and size) queue one after the other, so each is
taken for itself, and which of them is taken is all the same; ties in finish time are broken by source, hash, id and
round; an empty table, or one without words, takes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._columns import col
from ._store import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a level of the histogram of finish times, and its levels at most.
BITS, LEVELS = 12, 4


def shuffle_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeats: int) -> DataFrame:
    """``source, rank, source_size, target`` for ``source, source_size``: sources are few, one row each."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int") + 1)
    ranked = sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # the level at which the first source has enough; as if later ones were capped too, levels only fall
    open_ = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))
    found = ranked.withColumn("level", level).withColumn("final", F.max(open_).over(every))
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("final"), F.col("cap")))
    return found.select("source", "rank", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2, seed: str = "mix", text: str = "text", doc_id: str = "doc_id", source: str = "source", bucket_digits: int = 3, most_edge: int = 200_000) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for each row of ``docs``.

    ``bucket_digits``: a source is cut into 16 to this power buckets; raise it
    where a bucket of the largest source would not fit a task.
    """
    size = F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long")
    narrow = docs.select(col(doc_id).alias("doc_id"), col(source).cast("string").alias("source"), size.alias("size"))
    narrow = narrow.withColumn("key", shuffle_key(F.col("doc_id"), seed))
    queue = F.concat_ws("", F.when(F.col("source").isNull(), "n").otherwise("s"), "source")  # never null, so that windows and joins agree
    rows, _ = materialise(narrow.withColumns({"bucket": F.substring("key", 1, bucket_digits), "queue": queue}), "mix-sizes")
    sums = rows.groupBy("queue", "bucket").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    sums, _ = materialise(sums, "mix-sums")
    wanted, _ = materialise(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_repeats), "mix-targets")
    before = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).alias("o")
    offsets = offsets.join(wanted.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("queue", "bucket", "offset", "rank", "source_size", "target")
    offsets, _ = materialise(offsets, "mix-offsets")
    inside = Window.partitionBy("queue", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("within", F.sum("size").over(inside))
    placed = summed.join(offsets.hint("merge"), ["queue", "bucket"]).select("doc_id", "source", "size", "key", "rank", "source_size", "target", (F.col("offset") + F.col("within")).alias("upto"))
    placed, _ = materialise(placed, "mix-placed")

    def finish(k: int) -> Column:
        done = (F.col("upto") + F.lit(k) * F.col("source_size")).cast("double")
        return F.when(F.col("target") > 0, done / F.when(F.col("target") > 0, F.col("target"))).otherwise(F.lit(0.0))

    def bin_(at: Column, level: int) -> Column:
        """Bins of one level are exact parts of those of the level before."""
        return F.floor(at * float(1 << (BITS * level))).cast("long")

    copies = F.explode(F.array(*(F.struct(finish(k).alias("finish"), F.lit(k).alias("round")) for k in range(max_repeats)))).alias("c")
    copy = placed.select("*", copies)
    budget = F.lit(float(share)) * F.lit(float(wanted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]))
    edge, spent, lower = copy, 0, 0.0
    for level in range(1, LEVELS + 1):
        bins = edge.groupBy(bin_(F.col("c.finish"), level).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("copies"))
        upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = bins.withColumn("words_upto", F.sum("words").over(upto) + F.lit(spent)).where(F.col("words_upto") > budget).orderBy("bin").first()
        if last is None:  # all is taken
            break
        spent, lower = last["words_upto"] - last["words"], last["bin"] / float(1 << (BITS * level))
        edge = edge.where(bin_(F.col("c.finish"), level) == last["bin"])
        if last["copies"] <= most_edge:
            break

    def place(round_: Column, at: Column) -> Column:
        return F.struct(at.alias("finish"), F.col("rank").alias("rank"), F.col("key").alias("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("size").alias("size"), round_.alias("round"))

    if last is None:
        counted = [F.lit(1)] * max_repeats
    else:
        # inside the bin where the budget ends: the exact order
        ends = edge.withColumn("place", place(F.col("c.round"), F.col("c.finish")))
        run = F.sum("size").over(Window.orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        fits = ends.withColumn("run", run + F.lit(spent)).where(F.col("run") <= budget).agg(F.max("place").alias("p")).first()["p"]
        counted = []
        for k in range(max_repeats):
            early = finish(k) < lower
            if fits is not None:
                end = F.struct(F.lit(fits["finish"]).alias("finish"), F.lit(fits["rank"]).alias("rank"), F.lit(fits["key"]).alias("key"), F.lit(fits["id"]).alias("id"), F.lit(fits["size"]).alias("size"), F.lit(fits["round"]).alias("round"))
                early = early | (place(F.lit(k), finish(k)) <= end)
            counted.append(early.cast("int"))
    taken = (F.col("size") * sum(counted[1:], counted[0])).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def oracle(weights: Sequence[float], share: float, max_repeats: int, seed: str, docs: str = "documents") -> str:
    """The same mix with plain windows, for DuckDB."""
    cases = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(weights))
    rounds = ", ".join(f"({k})" for k in range(max_repeats))
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS key FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, (CASE rank % {len(weights)} {cases} END)::DOUBLE AS weight, {float(max_repeats)}::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, ({float(share)}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(cap, coalesce(weight * max(CASE WHEN cap / weight > level THEN level END) OVER (), cap)) AS target FROM l),
p AS (SELECT d.*, t.rank, t.source_size, t.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT p.*, x.round, CASE WHEN target > 0 THEN (upto + x.round * source_size)::DOUBLE / target ELSE 0 END AS finish
    FROM p, (VALUES {rounds}) AS x(round)),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, key, coalesce(doc_id::VARCHAR, ''), size, round RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM c)
SELECT doc_id, any_value(source) AS source, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
    sum(CASE WHEN run <= {float(share)}::DOUBLE * (SELECT sum(size) FROM d) THEN size ELSE 0 END)::BIGINT AS taken
FROM o GROUP BY doc_id"""
