"""Near duplicates by the Jaccard similarity of word shingles, exactly.

Token-combination prefixes.  The shingles of a text are put in one global
order, rare ones first.  A text of n shingles can lack at most
``delta = floor((1 - t) n)`` of them in a partner.  If a prefix is extended
until its classes of shingles hold ``delta + 1`` more than they may share
without sharing a combination, two linked texts share a combination: a rare
shingle alone, or for frequent shingles two that fall in the same of M
sub-classes (each sub-class absorbs one shingle, so the prefix is extended by
their number).  M follows the length, so frequent parts are indexed for a
length band and the next one up; linked texts are at most one band apart.
A shingle that one text alone has counts in the prefix but is not indexed.

Hot groups.  Texts with the same shingle set are one node.  Each posting list
first sends its members to its most common member (a star, linear in the list),
pairs are verified on the whole sets, and linked nodes become components.  Only
members of different components are compared further (unless their sizes or
bitmaps rule a link out): all at once in lists of
up to ``rare`` members, with a growing number of further stars in longer ones,
until no list holds an untested pair of different components.  No link between
components is lost, and copies are never expanded into pairs.

What is compared.  A shingle is known by a 64-bit hash of the bytes of its
words; two given shingles of different words count as one with a chance of
2^-64.  Pairs are verified on these hashes.  Sets are taken as equal by 128
bits, 64 from each of two independent hashes of their shingles.

Definitions for odd input: null and empty texts, and texts without words, have
no shingles and are linked with nothing, not even with each other; a text of
fewer words than a shingle has its whole sequence as the only shingle; texts of
any length are taken whole; repeated rows are equal sets and so linked; the
component of rows whose ids are all null is null; an empty table gives an empty
result; other columns pass through unless they clash with the names of the
results, which win.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _words as W
from ._chunks import answers, ask, bucket_bits, chunked, gathered, requests, resolve
from ._columns import DOC, bundle, col, unbundle
from ._components import components
from ._store import materialise

#: Frequency keys keep this many leading bits; a clash only changes the order, for all texts alike.
KEY_MASK = W.U(2**64 - 2**24)
#: Frequencies are kept in eighths of a binary logarithm.
STEP = 8


class Shingles:
    """Distinct shingles of the texts of one chunk: ``doc`` and ``hash``, sorted by both; ``other``: a second hash, by request."""

    def __init__(self, rows: pa.Table, text: str, size: int, lanes: int = 1):
        buf, offs = W.text_bytes(rows.column(text))
        starts, ends, word_offs = W.word_spans(buf, offs)
        doc, n = W.doc_of(word_offs), np.diff(word_offs)
        found, docs = [], []
        for lane in range(lanes):
            h = W.word_hashes(buf, starts, ends, lower=True, lane=lane)
            at = np.flatnonzero(W.inside_doc(word_offs, size, max(0, len(h) - size + 1)))
            hashes, docs = [W.grams(h, size, salt=5 + lane)[at]], [doc[at]]
            for k in range(1, size):
                short = np.flatnonzero(n == k)
                if len(short):
                    docs.append(short)
                    hashes.append(W.grams(h, k, salt=5 + lane)[word_offs[short]])
            found.append(np.concatenate(hashes))
        doc, h = np.concatenate(docs), found[0]
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        self.doc, self.hash = doc[new], h[new]
        self.other = found[-1][order][new]
        self.offs = np.searchsorted(self.doc, np.arange(rows.num_rows + 1))
        self.n = np.diff(self.offs)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set, in two halves; needs both lanes."""
        out = []
        for salt, h in ((11, self.hash), (12, self.other)):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mix(h, salt))))
            out.append(W.mix(sums[self.offs[1:]] - sums[self.offs[:-1]], salt).view(np.int64))
        return out[0], out[1]


def node_ids(chunk: int, row: np.ndarray) -> np.ndarray:
    return ((chunk >> 32) << 43 | (chunk & 0xFFFFF) << 23) + row.astype(np.int64)


def delta_of(n: int, percent: int) -> int:
    """How many of ``n`` shingles a linked text can lack."""
    return n - -(-percent * n // 100)


class Prefixes:
    """Which combinations a text is indexed under."""

    def __init__(self, percent: int, rare: int):
        self.percent = percent
        self.rare = math.floor(STEP * math.log2(rare))
        self.ratio = math.log(100 / (percent - 0.1))

    def classes(self, scheme: int) -> int:
        return max(1, int((1 - self.percent / 100) * math.exp(scheme * self.ratio)) // 2)

    def of(self, h: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Signatures of one text whose shingles are sorted by level and hash; ``level`` 0: no other text has it."""
        n = len(h)
        delta = delta_of(n, self.percent)
        few = int(np.searchsorted(level, self.rare))
        take = min(few, delta + 1)
        out = [W.mix(h[:take][level[:take] > 0], 21)]
        need = delta + 1 - take
        if need > 0:
            often = h[few:]
            band = int(math.log(n) / self.ratio)
            for scheme in (band, band + 1):
                kind = (W.mix(often, 22) % W.U(self.classes(scheme))).astype(np.int64)
                again = np.ones(len(often), bool)
                again[np.unique(kind, return_index=True)[1]] = False
                upto = int(np.searchsorted(np.cumsum(again), need)) + 1
                order = np.argsort(kind[:upto], kind="stable")
                k, t = kind[:upto][order], often[:upto][order]
                for step in range(1, upto):
                    same = k[step:] == k[:-step]
                    if not same.any():
                        break
                    a, b = t[step:][same], t[:-step][same]
                    out.append(W.mix(np.maximum(a, b) * W.U(3) + np.minimum(a, b), 100 + scheme))
        return np.unique(np.concatenate(out))


def parity_bits(h: np.ndarray) -> np.ndarray:
    """A bitmap in which each shingle turns one bit over, as 64-bit words.

    Two sets differ in at least as many shingles as their bitmaps in bits.
    """
    odd = np.bincount((W.mix(h, 41) >> W.U(54)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_link(percent: int) -> Column:
    """Whether sizes and bitmaps of ``x`` and ``y`` allow a link."""
    differ = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(1, 16)), F.bit_count(F.col("x.bits")[0].bitwiseXOR(F.col("y.bits")[0])))
    n = F.col("x.n") + F.col("y.n")
    return (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & ((n - differ) * (100 + percent) >= 2 * percent * n)


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    W.lean()
    for t in batches:
        keep = np.zeros(t.num_rows, bool)
        n_a, n_b = t.column("n_a").to_pylist(), t.column("n_b").to_pylist()
        last, a = None, None
        for i in range(t.num_rows):
            if t.column("a")[i] != last:
                last, a = t.column("a")[i], W.unpack_sorted(t.column("set_a")[i].as_py(), n_a[i])
            b = W.unpack_sorted(t.column("set_b")[i].as_py(), n_b[i])
            both = np.concatenate((a, b))
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep[i] = 100 * shared >= percent * (n_a[i] + n_b[i] - shared)
        yield t.select(["a", "b"]).filter(pa.array(keep))
        W.trim()


def link_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 4, percent: int = 85, rare: int = 32) -> DataFrame:
    """Adds ``n_shingles``, ``component_id`` (least id reachable by links) and ``is_first`` (one row of each component).

    The text itself is left out of the result.
    """
    return _link(docs, text, doc_id, size, percent, rare)[0].drop("__node")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 4, percent: int = 85, rare: int = 32) -> DataFrame:
    """``docs`` with one row of each component, the one with the least id; rows without words all stay."""
    linked, chunks = _link(docs, text, doc_id, size, percent, rare)
    schema, names = docs.schema, docs.columns
    arrow = to_arrow_schema(schema)
    own = [c for c in names if c != text]

    def pick(chunk: int, t: pa.Table, got: pa.Table) -> pa.Table:
        at = pa.array(np.sort(got.column("row").to_numpy()), pa.int64())
        t = t.take(at).combine_chunks()
        doc = t.column(DOC).combine_chunks()
        doc = doc if isinstance(doc, pa.StructArray) else doc.chunk(0) if doc.num_chunks else pa.array([], doc.type)
        return pa.table([t.column("__text") if c == text else doc.field(own.index(c)) for c in names], names=names).cast(arrow)

    return resolve(chunks, _places(linked.where("is_first").select(F.col("__node").alias("node"))), pick, schema)


def _places(nodes: DataFrame) -> DataFrame:
    """``chunk, row`` of nodes."""
    chunk = F.shiftleft(F.shiftright("node", 43), 32).bitwiseOR(F.shiftright("node", 23).bitwiseAND(0xFFFFF))
    return nodes.select(chunk.alias("chunk"), F.col("node").bitwiseAND(0x7FFFFF).cast("int").alias("row"))


def _link(docs: DataFrame, text: str, doc_id: str, size: int, percent: int, rare: int) -> tuple[DataFrame, DataFrame]:
    if not 50 <= percent < 100:
        raise ValueError("percent must be from 50 to 99")
    kept = [c for c in docs.columns if c not in {"n_shingles", "component_id", "is_first"} and c != text]
    given = docs.select(bundle([c for c in docs.columns if c != text]), col(doc_id).cast("long").alias("__id"), col(text).alias("__text"))
    chunks, total, _ = chunked(given, "jaccard-chunks", "__text")
    bits = bucket_bits(total["n_words"])

    # 1. one row for each text: its set in 128 bits
    fields = [given.schema[DOC]] + [T.StructField(c, T.LongType()) for c in ("__id", "node", "n_shingles", "d1", "d2")]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for batch in batches:
            for i in range(batch.num_rows):
                rows = W.unpack_table(batch.column("data")[i].as_py())
                s = Shingles(rows, "__text", size, lanes=2)
                nodes = node_ids(batch.column("chunk")[i].as_py(), np.arange(rows.num_rows))
                out = [rows.column(DOC), rows.column("__id"), nodes, s.n.astype(np.int64), *s.digests()]
                yield from pa.table(out, schema=arrow).to_batches()
                W.trim()

    rows, _ = materialise(chunks.select("chunk", "data").mapInArrow(sets, schema), "jaccard-rows")
    classes = rows.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("node").alias("node"), F.min("__id").alias("least"), F.min(F.struct(F.coalesce("__id", F.lit(2**63 - 1)).alias("id"), F.col("node"))).alias("best"))
    classes, _ = materialise(classes, "jaccard-classes")

    # 2. how many texts have each shingle
    def count(chunk: int, t: pa.Table) -> Iterator[dict[str, list]]:
        s = Shingles(t, "__text", size)
        keys, n = np.unique(s.hash & KEY_MASK, return_counts=True)
        yield requests(chunk, keys, bits, n.astype(np.uint32))

    def level(keys: list[np.ndarray], vals: list[np.ndarray]) -> list[np.ndarray]:
        every = np.concatenate(keys)
        _, where = np.unique(every, return_inverse=True)
        n = np.bincount(where, weights=np.concatenate(vals))
        got = np.minimum(255, np.floor(STEP * np.log2(n)))[where].astype(np.uint8)
        return np.split(got, np.cumsum([len(k) for k in keys])[:-1])

    levels = answers(ask(chunks, count), level, np.uint32)

    # 3. signatures of one text of each set
    prefixes = Prefixes(percent, rare)
    first = _places(classes.select("node")).select("chunk", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("vals"), "row")
    told = levels.withColumn("row", F.lit(None).cast("int")).unionByName(first)

    def sign(chunk: int, t: pa.Table, got: pa.Table) -> pa.Table:
        own = got.column("bucket").to_numpy() < 0
        wanted = np.sort(got.filter(pa.array(own)).column("row").to_numpy().astype(np.int64))
        s = Shingles(t, "__text", size)
        keys, where = np.unique(s.hash & KEY_MASK, return_inverse=True)
        lev = gathered(got.filter(pa.array(~own)), keys, bits, np.uint8)[where]
        order = np.lexsort((s.hash, lev, s.doc))
        h, lev = s.hash[order], lev[order]
        alone = np.concatenate(([0], np.cumsum(lev == 0)))
        sig, node, n_, pop = [], [], [], []
        ids = node_ids(chunk, np.arange(t.num_rows))
        for d in wanted:
            i, j = s.offs[d], s.offs[d + 1]
            delta = delta_of(int(j - i), percent)
            if alone[j] - alone[i] > delta:
                continue
            got_ = prefixes.of(h[i:j], lev[i:j])
            sig.append(got_.view(np.int64))
            node.append(np.full(len(got_), ids[d]))
            n_.append(np.full(len(got_), j - i, np.int32))
            pop.append(np.full(len(got_), int(lev[i:j].mean() * 100), np.int32))
        cat = lambda x, dt: np.concatenate(x).astype(dt) if x else np.zeros(0, dt)
        return pa.table({"sig": cat(sig, np.int64), "node": cat(node, np.int64), "n": cat(n_, np.int32), "pop": cat(pop, np.int32)})

    signed, _ = materialise(resolve(chunks, told, sign, "sig long, node long, n int, pop int"), "jaccard-signatures")
    lists = signed.groupBy("sig").agg(F.count("*").alias("members"), F.max(F.struct("pop", (-F.col("node")).alias("first"), "n")).alias("top")).where("members > 1")
    listed, _ = materialise(signed.join(lists, "sig").select("sig", "node", "n", "pop", "members", (-F.col("top.first")).alias("pivot"), F.col("top.n").alias("pivot_n")), "jaccard-lists")

    # 4. whole sets of the nodes in lists
    def pack(chunk: int, t: pa.Table, got: pa.Table) -> pa.Table:
        wanted = np.unique(got.column("row").to_numpy().astype(np.int64))
        s = Shingles(t, "__text", size) if len(wanted) else None
        each = [s.hash[s.offs[d] : s.offs[d + 1]] for d in wanted]
        blobs = [W.pack_sorted(h) for h in each]
        return pa.table({"node": node_ids(chunk, wanted), "n": s.n[wanted].astype(np.int32) if s else np.zeros(0, np.int32), "shingles": pa.array(blobs, pa.binary()), "bits": pa.array([parity_bits(h) for h in each], pa.list_(pa.int64()))})

    nodes = _places(listed.select("node").distinct())
    packed, _ = materialise(resolve(chunks, nodes, pack, "node long, n int, shingles binary, bits array<long>"), "jaccard-sets")

    def linked(pairs: DataFrame) -> DataFrame:
        near = pairs.where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))).select("a", "b", "n_a", "n_b").distinct()
        one = packed.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
        two = packed.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
        return near.join(two, "b").join(one, "a").select("a", "b", "n_a", "n_b", "set_a", "set_b").mapInArrow(lambda it: _verify(it, percent), "a long, b long")

    # 5. stars, then what stars left apart
    star = listed.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), F.col("pivot_n").alias("n_a"), F.col("n").alias("n_b"))
    edges, _ = materialise(linked(star), "jaccard-edges")
    everyone = listed.select("node").distinct()
    first_roots = components(edges)
    roots, _ = materialise(everyone.join(first_roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "jaccard-roots")

    def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
        """Roots after further links: only the links between roots are looked at."""
        a = more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        moved = components(a.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("to"))
        return roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))

    place = Window.partitionBy("sig").orderBy(F.desc("pop"), "node")
    done, width = 1, 4
    while True:
        found = listed.join(roots, "node")
        mixed = found.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("sig")
        open_ = found.join(mixed, "sig").withColumn("place", F.row_number().over(place))
        open_ = open_.where((F.col("members") > max(done, rare)) if done > 1 else F.lit(True)).join(packed.select("node", "bits"), "node")
        open_, _ = materialise(open_.select("sig", "node", "n", "members", "root", "place", "bits"), "jaccard-open")
        if open_.isEmpty():
            break
        head = open_.where((F.col("place") > done - (done == 1)) & ((F.col("place") <= done + width) | (F.col("members") <= rare)))
        a, b = head.alias("x"), open_.alias("y")
        pairs = a.join(b, "sig").where((F.col("x.place") < F.col("y.place")) & (F.col("x.root") != F.col("y.root")) & _may_link(percent))
        pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
        more, _ = materialise(linked(pairs), "jaccard-edges")
        done, width = done + width, width * 4
        if not more.isEmpty():
            roots, _ = materialise(joined(roots, more), "jaccard-roots")

    # 6. back to the rows
    own = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"), F.min("best").alias("best"))
    final = own.select("root", "d1", "d2", F.col("n_shingles").alias("n_")).join(least, "root").alias("c")
    r = rows.alias("r")
    same = (F.col("r.d1") == F.col("c.d1")) & (F.col("r.d2") == F.col("c.d2")) & (F.col("r.n_shingles") == F.col("c.n_"))
    some = F.col("n_shingles") > 0
    component = F.when(some, F.col("component_id")).otherwise(F.col("__id"))
    out = r.join(final, same, "left").select(*unbundle(kept, f"r.{DOC}"), "n_shingles", component.alias("component_id"), (~some | (F.col("node") == F.col("best.node"))).alias("is_first"), F.col("node").alias("__node"))
    return out, chunks
