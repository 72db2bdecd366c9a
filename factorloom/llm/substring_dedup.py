"""Removes word windows that repeat anywhere, with a log-structured fingerprint index.

Fingerprints.  Each window of ``window`` words is represented by the smallest
hash among its short word grams (about a tenth of all positions are chosen), so
two equal windows always share a fingerprint.  The index holds them in sorted
immutable runs, one for each batch: a new batch is merge-joined, bucket by
bucket, with the runs before it.  What is found again is reported to the new
chunk and, the first time, to the chunk that owned the key; from then on the
key needs no owner.  Runs are compacted when there are too many.

Verification.  Windows whose fingerprint was reported are hashed whole, to 128
bits of all their words in order (two independent lanes from the bytes of the
words on), and these digests go through runs of the same kind.  Windows of
equal digests are taken as equal; 2^-128 is the chance for a given pair that is
not.  Words inside such windows are removed, first occurrences included.

Incremental use.  A ``RepeatIndex`` lives in a folder: chunks of texts, runs of
fingerprints and digests, and the repeats found for each chunk.  It is opened
by its path; adding a batch reads the runs, the batch, and the old chunks that
the batch touches, and returns decisions for these.  Compaction also deals the
keys to more buckets when the index has grown.

Definitions for odd input: null and empty texts have no words and nothing
removed; texts shorter than a window keep all words; repeated rows count as
occurrences of their own, so a repeated text of a window or more goes; an
empty table gives an empty result; other columns pass through unless they
clash with the names of the results, which win.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _store
from . import _words as W
from ._chunks import ask, bucket_bits, chunked, resolve
from ._columns import DOC, bundle, col, unbundle

_REPEATED = -1
_RUN = "kind int, bucket int, chunk long, n int, keys binary, rest binary, vals binary"
_RUN_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("rest", pa.binary()), ("vals", pa.binary())])
_IS_RUN, _IS_REPORT = 0, 1
_BATCH = 52


def gram_size(window: int) -> int:
    return max(1, min(16, window // 2))


def _sliding(h: np.ndarray, w: int, fn) -> np.ndarray:
    """``fn`` over each ``w`` consecutive values."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = fn(out[: len(out) - step], out[step:])
        have += step
    return out


class Windows:
    """The windows of the texts of one chunk."""

    def __init__(self, rows: pa.Table, text: str, window: int):
        self.buf, offs = W.text_bytes(rows.column(text))
        self.starts, self.ends, self.offs = W.word_spans(self.buf, offs)
        self.texts = offs
        self.hash = W.word_hashes(self.buf, self.starts, self.ends, lower=False)
        self.window = window
        n = max(0, len(self.hash) - window + 1)
        self.valid = W.inside_doc(self.offs, window, n)

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprint of each window start, and the hashes of the chosen positions."""
        k = gram_size(self.window)
        span = self.window - k + 1
        g = W.grams(self.hash, k, salt=1)
        if not self.valid.any():
            return np.zeros(len(self.valid), np.uint64), np.zeros(0, np.uint64)
        low = _sliding(g, span, np.minimum)[: len(self.valid)]
        best = np.where(self.valid, low, W.U(0))
        padded = np.concatenate((np.zeros(span - 1, np.uint64), best, np.zeros(span - 1, np.uint64)))
        chosen = _sliding(padded, span, np.maximum)[: len(g)] == g
        return low, g[chosen]

    def digests(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the windows that start at ``at``."""
        first = W.grams(self.hash, self.window, salt=2)[at]
        other = W.word_hashes(self.buf, self.starts, self.ends, lower=False, lane=1)
        return first, W.grams(other, self.window, salt=3)[at]


def _groups(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by key, and where each key begins."""
    order = np.argsort(a, kind="stable") if b is None else np.lexsort((b, a))
    new = np.ones(len(a), bool)
    sa = a[order]
    new[1:] = sa[1:] != sa[:-1]
    if b is not None:
        sb = b[order]
        new[1:] |= sb[1:] != sb[:-1]
    return order, new


def _rows(kind: int, chunk: int, a: np.ndarray, b: np.ndarray | None, vals: np.ndarray | None, bits: int) -> dict[str, list]:
    """Rows of _RUN for keys sorted by ``a``, one for each bucket."""
    edges = np.concatenate(([0], np.searchsorted(a, np.arange(1, 1 << bits, dtype=np.uint64) << W.U(64 - bits)), [len(a)]))
    out: dict[str, list] = {c: [] for c in _RUN_ARROW.names}
    for k in np.flatnonzero(np.diff(edges)):
        i, j = edges[k], edges[k + 1]
        cells = (kind, int(k), chunk, int(j - i), W.pack_sorted(a[i:j]), None if b is None else W.squeeze(b[i:j].copy()), None if vals is None else W.squeeze(vals[i:j].copy()))
        for c, v in zip(out, cells, strict=True):
            out[c].append(v)
    return out


def _read(table: pa.Table, wide: bool) -> tuple[list[int], np.ndarray, np.ndarray | None]:
    n = table.column("n").to_pylist()
    a = np.concatenate([W.unpack_sorted(x.as_py(), k) for x, k in zip(table.column("keys"), n)])
    return n, a, np.concatenate([W.unsqueeze(x.as_py(), k, np.uint64) for x, k in zip(table.column("rest"), n)]) if wide else None


def _merge(wide: bool):
    def merge(table: pa.Table) -> pa.Table:
        """One bucket: runs (kind 0) against a new batch's requests (kind 1); the new run and reports."""
        W.lean()
        table = table.combine_chunks()
        kinds, chunk, bucket = table.column("kind").to_pylist(), table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
        n, a, b = _read(table, wide)
        owner, twice = [], []
        for kind, c, k, v in zip(kinds, chunk, n, table.column("vals")):
            owner.append(W.unsqueeze(v.as_py(), k, np.int64) if kind == _IS_RUN else np.full(k, c, np.int64))
            twice.append(owner[-1] == _REPEATED if kind == _IS_RUN else W.unsqueeze(v.as_py(), k, np.uint8) > 1)
        owner, twice = np.concatenate(owner), np.concatenate(twice)
        new = np.repeat(np.array(kinds) != _IS_RUN, n)
        order, first = _groups(a, b)
        key = np.empty(len(a), np.int64)
        key[order] = np.cumsum(first) - 1
        head = order[first]
        size = len(head)
        again = (np.bincount(key, minlength=size) > 1) | (np.bincount(key, weights=twice, minlength=size) > 0)
        fresh = np.bincount(key, weights=new, minlength=size) > 0
        known = np.bincount(key, weights=twice & ~new, minlength=size) > 0
        out: dict[str, list] = {c: [] for c in _RUN_ARROW.names}

        def put(kind: int, chunk_: int, at: np.ndarray, vals: np.ndarray | None) -> None:
            cells = (kind, bucket, chunk_, len(at), W.pack_sorted(a[at]), None if b is None else W.squeeze(b[at]), None if vals is None else W.squeeze(vals))
            for c, v in zip(out, cells, strict=True):
                out[c].append(v)

        if fresh.any():  # the new run: what this batch holds, older keys with their new state
            put(_IS_RUN, 0, head[fresh], np.where(again, _REPEATED, owner[head])[fresh])
        edge = np.concatenate(([0], np.cumsum(n)))
        for i, kind in enumerate(kinds):
            if kind != _IS_RUN:
                told = edge[i] + np.flatnonzero(again[key[edge[i] : edge[i + 1]]])
                if len(told):
                    put(_IS_REPORT, chunk[i], told, None)
        # owners that learn of a second occurrence, once
        late = np.flatnonzero(~new & (owner != _REPEATED) & (fresh & ~known)[key])
        late = late[np.lexsort((a[late], owner[late]))]
        for part in np.split(late, np.flatnonzero(np.diff(owner[late])) + 1) if len(late) else []:
            put(_IS_REPORT, int(owner[part[0]]), part, None)
        del a, b, owner, twice, new, order, key
        W.trim()
        return pa.table(out, schema=_RUN_ARROW)

    return merge


def _compact(wide: bool, bits: int):
    def compact(table: pa.Table) -> pa.Table:
        """The runs of one bucket as one run, dealt to 2^bits buckets."""
        W.lean()
        table = table.combine_chunks()
        n, a, b = _read(table, wide)
        owner = np.concatenate([W.unsqueeze(x.as_py(), k, np.int64) for x, k in zip(table.column("vals"), n)])
        order, first = _groups(a, b)
        state = np.minimum.reduceat(owner[order], np.flatnonzero(first))  # repeated wins
        head = order[first]
        out = pa.table(_rows(_IS_RUN, 0, a[head], None if b is None else b[head], state, bits), schema=_RUN_ARROW)
        W.trim()
        return out

    return compact


class Runs:
    """Sorted immutable runs of keys in the shared folder; ``state``: their paths and the number of buckets, as kept in the manifest."""

    def __init__(self, spark: SparkSession, folder: str, state: dict, wide: bool, fanout: int):
        self.spark, self.folder, self.state, self.wide, self.fanout = spark, folder, state, wide, fanout

    def _path(self) -> str:
        self.state["made"] = self.state.get("made", 0) + 1
        return f"{self.folder}/run-{self.state['made']:06d}"

    def _open(self, path: str) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(path)

    def history(self) -> DataFrame | None:
        out = None
        for path in self.state["runs"]:
            run = self._open(path).where(F.col("kind") == _IS_RUN)
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, asked: DataFrame) -> DataFrame:
        """Merge-join a batch of requests with the runs, keep its run, return its reports.

        The reports are read from the run's folder until ``taken`` moves or removes them.
        """
        old = self.history()
        rows = asked if old is None else asked.unionByName(old)
        path = self._path()
        _store.write(rows.groupBy("bucket").applyInArrow(_merge(self.wide), _RUN), path, "none", by="kind", mode="overwrite")
        self.state["runs"].append(path)
        return self._open(path).where(F.col("kind") == _IS_REPORT)

    def taken(self, to: str | None = None) -> bool:
        """Move the last batch's reports out of its run's folder, or remove them; false if there are none to move."""
        reports = f"{self.state['runs'][-1]}/kind={_IS_REPORT}"
        if to is not None:
            return _store.move(self.spark, reports, to)
        _store.remove(self.spark, reports)
        return False

    def compact(self, bits: int) -> list[str]:
        """One run in place of all, in 2^bits buckets; returns the folders that are no longer needed."""
        old = self.state["runs"]
        path = self._path()
        _store.write(self.history().groupBy("bucket").applyInArrow(_compact(self.wide, bits), _RUN), path, "none", by="kind", mode="overwrite")
        self.state.update(runs=[path], bits=bits)
        return old


class RepeatIndex:
    """A persistent index of the windows of all texts that were added.

    The manifest names what counts; it is replaced last, so that a call that
    died leaves the index as it was, and its files are written over.
    """

    def __init__(self, spark: SparkSession, path: str, text: str = "text", window: int = 35, fanout: int = 4):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        held = _store.read_text(spark, f"{self.path}/manifest.json")
        self.state = json.loads(held) if held else {"text": text, "window": window, "words": 0, "batches": 0, "chunks": [], "folds": 0, "hits": [], "schema": None, "keys": {"runs": [], "bits": 0}, "digests": {"runs": [], "bits": 0}}
        if (self.state["text"], self.state["window"]) != (text, window):
            raise ValueError(f"this index holds windows of {self.state['window']} words of {self.state['text']}")
        self.window = window

    def _save(self) -> None:
        _store.write_text(self.spark, f"{self.path}/manifest.json", json.dumps(self.state))

    def _runs(self, name: str) -> Runs:
        return Runs(self.spark, f"{self.path}/{name}", self.state[name], name == "digests", self.fanout)

    def _chunks(self) -> DataFrame:
        return self.spark.read.schema("chunk long, n_docs long, n_bytes long, n_words long, data binary").parquet(*self.state["chunks"])

    def store(self, docs: DataFrame) -> tuple[DataFrame, dict]:
        """The chunks of a batch, kept in the index's folder."""
        given = docs.select(bundle([c for c in docs.columns if c != self.state["text"]]), col(self.state["text"]).alias("__text"))
        schema = given.schema[DOC].dataType.json()
        if self.state["schema"] not in (None, schema):
            raise ValueError("the batches of an index have the same columns")
        number = self.state["batches"] + 1
        path = f"{self.path}/chunks-{number:06d}"
        table, total, _ = chunked(given, path, "__text", offset=number << _BATCH, at=path)
        self.state.update(schema=schema, batches=number, chunks=[*self.state["chunks"], path], words=self.state["words"] + total["n_words"])
        return table, total

    def fold(self, chunks: DataFrame) -> None:
        """Find what ``chunks`` (stored, not folded in yet) share with each other and with the index."""
        gone: list[str] = []
        for name, per in (("keys", 8), ("digests", 2)):
            runs, bits = self._runs(name), bucket_bits(self.state["words"] // per)
            if not runs.state["runs"]:
                runs.state["bits"] = bits
            elif bits > runs.state["bits"] or len(runs.state["runs"]) >= self.fanout:
                gone += runs.compact(max(bits, runs.state["bits"]))
        window, key_bits, digest_bits = self.window, self.state["keys"]["bits"], self.state["digests"]["bits"]

        def fingerprints(chunk: int, rows: pa.Table) -> Iterator[dict[str, list]]:
            keys, count = np.unique(Windows(rows, "__text", window).fingerprints()[1], return_counts=True)
            yield _rows(_IS_REPORT, chunk, keys, None, np.minimum(count, 2).astype(np.uint8), key_bits)

        def whole(chunk: int, rows: pa.Table, told: pa.Table) -> pa.Table:
            if not told.num_rows:
                return _RUN_ARROW.empty_table()
            w = Windows(rows, "__text", window)
            low, _ = w.fingerprints()
            known = np.unique(np.concatenate([W.unpack_sorted(k.as_py(), n) for k, n in zip(told.column("keys"), told.column("n").to_pylist())]))
            at = np.minimum(np.searchsorted(known, low), len(known) - 1)
            a, b = w.digests(np.flatnonzero(w.valid & (known[at] == low)))
            order, first = _groups(a, b)
            head = order[first]
            count = np.diff(np.concatenate((np.flatnonzero(first), [len(a)])))
            return pa.table(_rows(_IS_REPORT, chunk, a[head], b[head], np.minimum(count, 2).astype(np.uint8), digest_bits), schema=_RUN_ARROW)

        keys, digests = self._runs("keys"), self._runs("digests")
        told = keys.add(ask(chunks, fingerprints, _RUN))
        held = self._chunks() if len(self.state["chunks"]) > 1 or self.state["folds"] else chunks
        wanted = held.join(told.select("chunk").distinct(), "chunk", "left_semi")
        digests.add(resolve(wanted, told, whole, _RUN))
        keys.taken()
        path = f"{self.path}/hits-{self.state['folds'] + 1:06d}"
        found = digests.taken(path)
        self.state.update(folds=self.state["folds"] + 1, hits=self.state["hits"] + [path] * found)
        self._save()
        for p in gone:
            _store.remove(self.spark, p)

    def _hits(self, paths: list[str]) -> DataFrame:
        schema = "chunk long, n int, keys binary, rest binary"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def decide(self, chunks: DataFrame, kept: list[str], with_text: bool = False) -> DataFrame:
        """Decisions on the rows of ``chunks``, from all that the index has found."""
        window = self.window
        fields = [("__chunk", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())] + [("kept_text", T.StringType())] * with_text
        doc = T.StructType.fromJson(json.loads(self.state["schema"]))
        schema = T.StructType([T.StructField(DOC, doc), *(T.StructField(n, t) for n, t in fields)])
        arrow = to_arrow_schema(schema)

        def finish(chunk: int, rows: pa.Table, hits: pa.Table) -> pa.Table:
            w = Windows(rows, "__text", window)
            gone = np.zeros(len(w.hash), bool)
            if hits.num_rows and len(w.valid):
                known_a, known_b = (np.concatenate(x) for x in zip(*((W.unpack_sorted(k.as_py(), n), W.unsqueeze(r.as_py(), n, np.uint64)) for k, r, n in zip(hits.column("keys"), hits.column("rest"), hits.column("n").to_pylist()))))
                start = np.flatnonzero(w.valid)
                a, b = w.digests(start)
                maybe = np.isin(a, known_a)
                start, a, b = start[maybe], a[maybe], b[maybe]
                # a window counts if both lanes agree with one known digest
                order, first = _groups(np.concatenate((known_a, a)), np.concatenate((known_b, b)))
                group = np.empty(len(order), np.int64)
                group[order] = np.cumsum(first) - 1
                is_known = np.zeros(len(order) and group.max() + 1, bool)
                is_known[group[: len(known_a)]] = True
                gone = W.covered(start[is_known[group[len(known_a) :]]], window, len(w.hash))
            n_words = np.diff(w.offs)
            n_gone = np.diff(np.concatenate(([0], np.cumsum(gone)))[w.offs])
            data = w.buf.tobytes()
            digest, texts = [], []
            missing = rows.column("__text").is_null().to_pylist()
            for d in range(rows.num_rows):
                i, j = w.offs[d], w.offs[d + 1]
                keep = np.flatnonzero(~gone[i:j]) + i if n_gone[d] else None
                words = b" ".join([data[s:e] for s, e in zip(w.starts[keep], w.ends[keep])]) if n_gone[d] else b" ".join(data[w.starts[i] : w.ends[j - 1]].split()) if j > i else b""
                digest.append(hashlib.sha256(words).hexdigest())
                if with_text:
                    begin, end = w.texts[d], w.texts[d + 1]
                    if n_gone[d]:  # each word goes with the white space behind it
                        stop = np.append(w.starts[i + 1 : j], end)[keep - i]
                        texts.append((data[begin : w.starts[i]] + b"".join([data[s:e] for s, e in zip(w.starts[keep], stop)])).decode("utf-8", "replace"))
                    else:
                        texts.append(None if missing[d] else data[begin:end].decode("utf-8", "replace"))
            out = [rows.column(DOC), pa.array(np.full(rows.num_rows, chunk), pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digest, pa.string())]
            if with_text:
                out.append(pa.array(texts, pa.string()))
            return pa.table([c.combine_chunks().cast(f.type) if isinstance(c, pa.ChunkedArray) else c.cast(f.type) for c, f in zip(out, arrow)], schema=arrow)

        return resolve(chunks, self._hits(self.state["hits"]), finish, schema).select(*unbundle(kept), *(n for n, _ in fields))

    def add(self, docs: DataFrame, with_text: bool = False) -> DataFrame:
        """Fold a batch in; decisions on its rows, and again on older rows of the chunks that it touches (``is_new`` false)."""
        chunks, _ = self.store(docs)
        before = len(self.state["hits"])
        self.fold(chunks)
        touched = self._hits(self.state["hits"][before:]).select("chunk").unionByName(chunks.select("chunk")).distinct()
        names = {"n_words", "n_removed", "kept_sha256", "kept_text", "is_new", self.state["text"]}
        out = self.decide(self._chunks().join(touched, "chunk", "left_semi"), [c for c in docs.columns if c not in names], with_text)
        return out.withColumn("is_new", F.shiftright("__chunk", _BATCH) == self.state["batches"]).drop("__chunk")


def remove_repeats(docs: DataFrame, text: str = "text", window: int = 35, batches: int = 2, fanout: int = 4, with_text: bool = False) -> DataFrame:
    """Adds ``n_words``, ``n_removed`` and ``kept_sha256`` (kept words joined by a space), and by request ``kept_text``.

    ``kept_text`` has the removed words cut out, each with the white space
    behind it, and all other bytes as they were (null for a null text).  The
    text itself is left out.  ``batches``: the chunks are added to a new index in so many batches.
    """
    names = {"n_words", "n_removed", "kept_sha256", text} | ({"kept_text"} if with_text else set())
    kept = [c for c in docs.columns if c not in names]
    spark = docs.sparkSession
    index = RepeatIndex(spark, _store.new_path(spark, "repeats"), "__text", window, fanout)
    given = docs.select(*(col(c).alias(f"c{i}") for i, c in enumerate(kept)), col(text).alias("__text"))
    chunks, _ = index.store(given)
    for b in range(batches):
        index.fold(chunks.where(F.pmod(F.col("chunk"), F.lit(batches)) == b))
    out = index.decide(chunks, [f"c{i}" for i in range(len(kept))], with_text)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text)
