"""Prefix trie of conversations, built level by level.

A node of depth ``d`` is a distinct sequence of ``d`` first turns; it is named by
its depth and its smallest conversation, since a conversation is in one node of
each depth.  Going down, the live conversations are joined with their next turn
and grouped by (node, turn), which gives the children, their smallest
conversations and sizes; a conversation alone in its node has no branch below,
so its further turns are nodes without any more grouping, and it leaves the
levels.  The number of rounds is the longest prefix that two conversations
share, not the longest conversation.  Going up, each level's nodes are joined
with the sums of their children.

Turns are compared by 128-bit digests.  Groups are sums and minima, made
partially before the shuffle; conversations get the name of their group by an
equi-join on group and salt, so a group that a third of all rows share is many
keys, each with one row on the other side.
Each level is a table in the shared folder, so a lost executor costs a level's
task and lineage stays short.

The digest of the conversations that end in a node takes them in order: they
are put together in blocks of 256 consecutive numbers, and the blocks of a node
are hashed as a sorted stream, so no task holds the conversations of a node.

Definitions for odd input: null roles and texts are empty; of a conversation's
turns, nulls come first, and equal ones follow by role, then text, so repeated
rows are turns of their own; rows of a null conversation id belong to no
conversation and are left out; conversations without turns are members of the
root; texts of any length are taken whole; an empty table has no nodes; other
columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._ship import ship
from ._store import materialise

#: Bits of the turn numbers that are numbered together, and of the ids that are put together.
TURN_BITS, ID_BITS = 9, 8
#: Parts of a group that get its name in tasks of their own.
SALTS = 64


def number_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos, role, text``: the turns of each conversation, from 1 on.

    A long conversation is numbered in blocks of turn numbers, whose sizes are added up first.
    """
    given = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    given = given.withColumn("block", F.coalesce(F.shiftright("turn", TURN_BITS), F.lit(-(1 << 62))))
    sizes = given.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = given.withColumn("k", F.row_number().over(inside))
    return numbered.join(firsts, ["conv_id", "block"]).select("conv_id", (F.col("first") + F.col("k")).alias("pos"), "role", "text")


def share_openings(turns: DataFrame, hundred: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that open like the first of their hundred: rebuilt turns, and all conversations.

    The first ``h = crc32(id) % most`` turns are those of conversation ``id - id % hundred``.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    base = F.col("conv_id") - F.col("conv_id") % hundred
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h.alias("h"), base.alias("base"))
    convs, _ = materialise(convs, "trie-conversations")
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    shared = convs.join(sizes, "base", "left").select("conv_id", "base", "h", F.least(F.col("h"), F.coalesce("n_base", F.lit(0))).alias("given"))
    own = turns.join(shared, "conv_id").where(F.col("pos") > F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "role", "text")
    opening = turns.where((F.col("pos") < most) & (F.col("conv_id") % hundred == 0)).withColumnRenamed("conv_id", "base")
    first = shared.where("given > 0").join(opening, "base").where(F.col("pos") <= F.col("given")).select("conv_id", "pos", "role", "text")
    return own.unionByName(first), convs.select("conv_id")


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def _ends(ends: DataFrame) -> DataFrame:
    """``depth, node, ends_sha256`` for ``depth, node, conv_id``."""
    blocks = ends.groupBy("depth", "node", F.shiftright("conv_id", ID_BITS).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    blocks = blocks.repartition("depth", "node").sortWithinPartitions("depth", "node", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["depth", "node", "ends_sha256"]
        at, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids"))):
                if (depth, node) == at:
                    state.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = (depth, node), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
                done = []
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, state.hexdigest())], names=names)

    return blocks.select("depth", "node", "ids").mapInArrow(run, "depth long, node long, ends_sha256 string")


def build_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns`` (``conv_id, pos, role, text``; ``pos`` from 1 on without gaps).

    ``conversations``: all ``conv_id``, those without turns too.  Returns ``conv_id`` (smallest
    member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens`` (over the
    node's subtree: code points of a node's last text, times members but one) and
    ``ends_sha256`` (members that end here, ascending, comma-joined).
    """
    spark = turns.sparkSession
    ship(spark)
    members = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("pos").cast("long").alias("depth"), _digest(role, text).alias("turn"), F.char_length(text).cast("long").alias("chars"))
    # by depth inside a file, so that a level reads its own pages
    told, _ = materialise(narrow.sortWithinPartitions("depth"), "trie-turns")
    sizes = told.groupBy("conv_id").agg(F.max("depth").alias("n_turns"))
    least, n_convs = members.agg(F.min("conv_id"), F.count("*")).first()
    everyone = members.join(sizes, "conv_id", "left").select("conv_id", F.coalesce("n_turns", F.lit(0)).cast("long").alias("n_turns"))
    root = [F.lit(None).cast("long").alias("parent"), F.lit(least).cast("long").alias("node"), F.lit(n_convs).cast("long").alias("n_convs")]
    level, _ = materialise(everyone.select("conv_id", *root, "n_turns", F.lit(0).cast("long").alias("chars")), "trie-level")
    levels = [level]
    while True:
        live = level.where((F.col("n_convs") > 1) & (F.col("n_turns") >= len(levels)))
        if live.isEmpty():
            break
        step = live.select("conv_id", F.col("node").alias("parent"), "n_turns").join(told.where(F.col("depth") == len(levels)).drop("depth"), "conv_id")
        step = step.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
        salted = step.groupBy("parent", "turn", "salt").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"))
        groups = salted.groupBy("parent", "turn").agg(F.min("node").alias("node"), F.sum("n_convs").alias("n_convs"))
        names = salted.select("parent", "turn", "salt").join(groups, ["parent", "turn"])
        level, _ = materialise(step.join(names, ["parent", "turn", "salt"]).select("conv_id", "parent", "node", "n_convs", "n_turns", "chars"), "trie-level")
        levels.append(level)
    # up again: from the children's sums to the parents
    nodes, below = [], None
    for depth in range(len(levels) - 1, -1, -1):
        here = levels[depth].where(F.col("conv_id") == F.col("node"))
        own = (F.col("n_convs") - 1) * F.col("chars")
        if below is None:
            # members that are alone go on in a chain of their own
            sums = here.select("node", "parent", "n_convs", (F.col("n_turns") > depth).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), own.alias("saved"))
        else:
            children = below.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
            chain = F.when((F.col("n_convs") == 1) & (F.col("n_turns") > depth), 1).otherwise(0)
            sums = here.join(children, "node", "left").select(
                "node",
                "parent",
                "n_convs",
                F.coalesce("c", chain).cast("long").alias("n_children"),
                F.coalesce("l", F.lit(1)).cast("long").alias("n_leaves"),
                (own + F.coalesce("s", F.lit(0))).alias("saved"),
            )
        below, _ = materialise(sums, "trie-sums")
        nodes.append(below.withColumn("depth", F.lit(depth).cast("long")))
    ending = [t.where(F.col("n_turns") == d).select(F.lit(d).cast("long").alias("depth"), "node", "conv_id") for d, t in enumerate(levels)]
    ends = _ends(reduce(DataFrame.unionByName, ending))
    shared = reduce(DataFrame.unionByName, nodes).join(ends, ["depth", "node"], "left")
    alone = reduce(DataFrame.unionByName, [t.where("n_convs = 1").select("conv_id", "n_turns", F.lit(d).cast("long").alias("from")) for d, t in enumerate(levels)])
    chain = alone.where(F.col("n_turns") > F.col("from")).withColumn("depth", F.explode(F.sequence(F.col("from") + 1, F.col("n_turns"))))
    last = F.col("depth") == F.col("n_turns")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = chain.select(
        "conv_id",
        "depth",
        F.col("conv_id").alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(last, none).otherwise(one).alias("n_children"),
        one.alias("n_leaves"),
        none.alias("saved_tokens"),
        F.sha2(F.when(last, F.col("conv_id").cast("string")).otherwise(F.lit("")), 256).alias("ends_sha256"),
    )
    top = shared.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    return top.unionByName(tails)
