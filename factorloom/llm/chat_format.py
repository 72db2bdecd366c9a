"""Reply trees as training conversations, with DataFrame functions only.

Messages form trees by their parents.  Iterative self-joins double the known
part of every way to the root in each round (the table of 2^k-th ancestors is
joined with itself, scores are summed on the way), so a path of n messages
takes log2(n) rounds.  Branches are ranked within their tree by the sum of
their messages' scores before any path is written out; the paths of the chosen
leaves are then enumerated by joins with the same tables, so their number does
not grow with branches that are not chosen.  Each chosen path is formatted as
one conversation::

    <|im_start|>role\\ntext<|im_end|>\\n

Control strings inside texts are escaped reversibly: wherever "<", any number
of backslashes and "|" meet, one more backslash goes in, so no text holds "<|".
Roles have "%", line feeds and "<" as %25, %0A and %3C.  The loss mask is an
array of (start, end) places, in code points of the formatted string, of the
texts of the roles to learn.

Definitions for odd input: null roles and texts are empty; a null tree id is a
tree of its own; a message whose parent is missing is a root; messages on a
cycle are on no path; turns of one number follow each other by role and text,
and repeated turns are turns of their own (``from_turns`` numbers them); rows of
messages that are equal in all columns are one message; of different messages
under one id, replies belong to the one with the highest score (then by parent,
role and text), and the others, like every message without an id, are branches
without replies (``copy`` is 0 for the first and no other); equal scores are
decided by the smaller leaf id, then copy; texts of any length are taken whole; an empty table gives an empty
result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialise

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def from_turns(rows: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages ``tree, id, parent, role, text, score`` of conversations whose turns follow each other."""
    order = Window.partitionBy(tree).orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    k = F.row_number().over(order).cast("long")
    return rows.select(F.col(tree).alias("tree"), k.alias("id"), F.when(k > 1, k - 1).alias("parent"), F.col(role).alias("role"), F.col(text).alias("text"), F.lit(0.0).alias("score"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))


def clean_messages(messages: DataFrame) -> DataFrame:
    """Different messages, null roles and texts empty, null scores 0; ``id`` is (id, copy), ``parent`` the first message of its id."""
    long = lambda c: F.col(c).cast("long")
    cells = F.struct(long("parent").alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = messages.select("tree", long("id").alias("id"), cells.alias("c")).distinct()
    first = rows.where("id is not null").groupBy("tree", "id").agg(F.min_by("c", F.struct(-F.col("c.score"), "c.parent", "c.role", "c.text")).alias("first"))
    r, f = rows.alias("r"), first.alias("f")
    met = r.join(f, _same("r", "f") & (F.col("r.id") == F.col("f.id")), "left")
    # copies are numbered by what they hold, so that no task counts them
    copy = F.when(F.col("c") == F.col("first"), F.lit(0).cast("long")).otherwise(F.xxhash64("c.parent", "c.role", "c.text", "c.score").bitwiseOR(F.lit(1)))
    key = lambda i, k: F.struct(i.alias("id"), k.alias("copy"))
    parent = F.when(F.col("c.parent").isNotNull(), key(F.col("c.parent"), F.lit(0).cast("long")))
    return met.select("r.tree", key(F.col("r.id"), copy).alias("id"), parent.alias("parent"), "c.role", "c.text", "c.score")


def ways_up(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``tree, leaf, score`` of all branches, and the tables of 2^k-th ancestors (``tree, node, above``)."""
    a, b = nodes.select("tree", "id", "parent", "score").alias("a"), nodes.select("tree", F.col("id").alias("above")).alias("b")
    linked = a.join(b, _same("a", "b") & (F.col("a.parent") == F.col("b.above")), "left")
    state, _ = materialise(linked.select("a.tree", F.col("a.id").alias("node"), "above", F.col("a.score").alias("sum")), "tree-ways")
    first, jumps = state, []
    most = state.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(most.bit_length() + 1):
        open_ = state.where(F.col("above").isNotNull())
        if open_.isEmpty():
            break
        jumps.append(open_.select("tree", "node", "above"))
        # ways that have reached a root are not joined again
        x, y = open_.alias("x"), state.alias("y")
        further = x.join(y, _same("x", "y") & (F.col("x.above") == F.col("y.node"))).select("x.tree", "x.node", "y.above", (F.col("x.sum") + F.col("y.sum")).alias("sum"))
        state, _ = materialise(further.unionByName(state.where(F.col("above").isNull())), "tree-ways")
    # after as many rounds as the largest tree could take, what still goes up goes round
    done = state.where(F.col("above").isNull()).alias("d")
    leaf = done.join(first.alias("f"), _same("d", "f") & (F.col("d.node") == F.col("f.above")), "left_anti")
    return leaf.select("tree", F.col("node").alias("leaf"), F.col("sum").alias("score")), jumps


def paths_of(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """``tree, leaf, node, up``: the messages of the paths of some leaves, ``up`` steps above the leaf."""
    paths = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, jump in enumerate(jumps):
        p, j = paths.alias("p"), jump.alias("j")
        longer = p.join(j, _same("p", "j") & (F.col("p.node") == F.col("j.node"))).select("p.tree", "leaf", F.col("above").alias("node"), (F.col("up") + 2**k).alias("up"))
        paths, _ = materialise(paths.unionByName(longer), "tree-paths")
    return paths


def tree_paths(messages: DataFrame) -> DataFrame:
    """``tree, leaf, node, up, leaf_copy, node_copy``: every message of every root-to-leaf path."""
    nodes, _ = materialise(clean_messages(messages.withColumns({c: F.lit(None) for c in ("role", "text", "score") if c not in messages.columns})), "messages")
    found = paths_of(*ways_up(nodes))
    return found.select("tree", F.col("leaf.id").alias("leaf"), F.col("node.id").alias("node"), "up", F.col("leaf.copy").alias("leaf_copy"), F.col("node.copy").alias("node_copy"))


def format_trees(messages: DataFrame, best: int = 1, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """``tree, leaf, copy, score, formatted, loss_spans``: the ``best`` paths of each tree, by score."""
    nodes, _ = materialise(clean_messages(messages), "messages")
    leaves, jumps = ways_up(nodes)
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    chosen, _ = materialise(leaves.withColumn("rank", rank).where(F.col("rank") <= best).select("tree", "leaf", F.col("score").alias("path_score")), "tree-chosen")
    c, w = chosen.alias("c"), paths_of(chosen, jumps).alias("w")
    picked = w.join(c, _same("w", "c") & (F.col("w.leaf") == F.col("c.leaf"))).select("w.tree", "w.leaf", "node", "up", "path_score")
    same = F.col("p.tree").eqNullSafe(F.col("n.tree")) & (F.col("p.node") == F.col("n.id"))
    rows = picked.alias("p").join(nodes.alias("n"), same).select("p.tree", "leaf", "path_score", "up", "role", escape_role(F.col("role")).alias("r"), escape(F.col("text")).alias("t"))
    piece = F.concat(F.lit(START), F.col("r"), F.lit("\n"), F.col("t"), F.lit(END))
    rows = rows.withColumn("piece", piece)
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    upto = F.sum(F.char_length("piece")).over(before)
    end = upto - len(END)
    span = F.when(F.col("role").isin(list(learn)), F.struct((end - F.char_length("t")).alias("start"), end.alias("end")))
    turns = rows.withColumn("span", span).groupBy("tree", "leaf").agg(F.first("path_score").alias("score"), F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "piece", "span"))).alias("x"))
    spans = F.filter(F.transform("x", lambda s: s["span"]), lambda s: s.isNotNull())
    return turns.select("tree", F.col("leaf.id").alias("leaf"), F.col("leaf.copy").alias("copy"), "score", F.array_join(F.transform("x", lambda s: s["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    parts = F.split(formatted, r"<\|im_start\|>")
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        begin = F.char_length(role) + 2
        text = F.substring(x, begin, F.char_length(x) - begin + 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under a loss mask, unescaped, end to end."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
