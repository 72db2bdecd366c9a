"""Texts in chunks, and a packed exchange of hash keys between chunks and buckets.

A per-word shuffle row costs far more than the word itself.  Documents are
therefore first written as chunks of a few megabytes; a chunk asks about all
its keys at once, one compressed blob of sorted hashes for each bucket of the
hash space, and gets an answer aligned with what it asked.  Every key counts
once per chunk, so a key that a third of all rows share costs a bucket one
entry per chunk.  Chunks and buckets both grow with the square root of the
input, so that the blobs between them keep their size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from . import _words as W
from ._ship import ship
from ._store import materialise, write

#: A chunk's bytes, and the rows it holds at most (node ids have 23 bits for them).
CHUNK_BYTES, CHUNK_ROWS = 3 << 20, 1 << 20
#: Words behind one bucket of the hash space, before chunks drop repeats.
BUCKET_WORDS = 2 << 20
#: Above this input both grow, up to sixteen times.
ROOT_BYTES = 32 << 30
REQUEST = "bucket int, chunk long, n int, keys binary, vals binary"
ANSWER = "chunk long, bucket int, vals binary"


def growth(size: float) -> float:
    """The factor for chunks and buckets at an input of ``size`` bytes."""
    return min(16.0, max(1.0, size / ROOT_BYTES) ** 0.5)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """The rows regrouped to about ``limit`` bytes each, ``column`` in full and a share of the others; a longer row stands alone."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        _, offs = W.text_bytes(batch.column(column))
        rest = max(0, batch.nbytes - int(offs[-1])) // max(1, batch.num_rows)
        cost = offs + rest * np.arange(len(offs))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(cost, cost[a] + limit - size, "right")) - 1)
            if size and size + cost[b] - cost[a] > limit:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
                continue
            b = min(b, batch.num_rows, a + CHUNK_ROWS - rows)
            held.append(batch.slice(a, b - a))
            size, rows = size + int(cost[b] - cost[a]), rows + b - a
            a = b
            if size >= limit or rows >= CHUNK_ROWS:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def chunked(docs: DataFrame, name: str, text: str = "text", tag: int = 0, offset: int = 0, at: str | None = None) -> tuple[DataFrame, dict, str]:
    """Write ``docs`` as chunks: ``chunk, n_docs, n_bytes, n_words, data`` (the rows, compressed).

    Returns the table, its totals (docs, bytes, words, chunks) and its path.
    Chunk numbers of another ``tag`` or ``offset`` are other numbers.  ``at``: the path, else one for ``name``.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        part = TaskContext.get().partitionId()
        for k, t in enumerate(slices(batches, text, limit)):
            buf, offs = W.text_bytes(t.column(text))
            n = len(W.word_spans(buf, offs)[0])
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([offset + (part << 32 | tag << 30 | k)], pa.int64()),
                    "n_docs": pa.array([t.num_rows], pa.int64()),
                    "n_bytes": pa.array([len(buf)], pa.int64()),
                    "n_words": pa.array([n], pa.int64()),
                    "data": pa.array([W.pack_table(t)], pa.binary()),
                }
            )
        W.trim()

    limit = int(CHUNK_BYTES * growth(float(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))))
    ship(docs.sparkSession)
    rows = docs.mapInArrow(build, "chunk long, n_docs long, n_bytes long, n_words long, data binary")
    if at is None:
        table, path = materialise(rows, name, "none")
    else:
        write(rows, at, "none", mode="overwrite")
        table, path = docs.sparkSession.read.schema(rows.schema).parquet(at), at
    got = table.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_bytes", "n_words")), F.count("*").alias("chunks")).first()
    return table, got.asDict(), path


def bucket_bits(words: int) -> int:
    return max(6, int(np.ceil(np.log2(max(1, words) / (BUCKET_WORDS * growth(8.0 * words))))) + 1)


def requests(chunk: int, keys: np.ndarray, bits: int, vals: np.ndarray | None = None) -> dict[str, list]:
    """Rows of REQUEST for sorted ``keys``; ``vals`` is aligned with them."""
    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << W.U(64 - bits))
    edges = np.concatenate(([0], cuts, [len(keys)]))
    out: dict[str, list] = {"bucket": [], "chunk": [], "n": [], "keys": [], "vals": []}
    for b in np.flatnonzero(np.diff(edges)):
        i, j = edges[b], edges[b + 1]
        out["bucket"].append(int(b))
        out["chunk"].append(chunk)
        out["n"].append(int(j - i))
        out["keys"].append(W.pack_sorted(keys[i:j]))
        out["vals"].append(None if vals is None else W.squeeze(np.ascontiguousarray(vals[i:j])))
    return out


REQUEST_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])
ANSWER_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("vals", pa.binary())])


def ask(chunks: DataFrame, fn: Callable[[int, pa.Table], Iterator[dict[str, list]]], schema: str = REQUEST) -> DataFrame:
    """Rows (of REQUEST) that ``fn(chunk, rows)`` makes for each chunk."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for batch in batches:
            for i in range(batch.num_rows):
                for rows in fn(batch.column("chunk")[i].as_py(), W.unpack_table(batch.column("data")[i].as_py())):
                    yield pa.RecordBatch.from_pydict(rows, schema=arrow)
                W.trim()

    return chunks.select("chunk", "data").mapInArrow(run, schema)


def answers(asked: DataFrame, fn: Callable[[list[np.ndarray], list[np.ndarray | None]], list[np.ndarray]], dtype=None) -> DataFrame:
    """ANSWER rows: ``fn`` gets the keys (and vals of ``dtype``) of every chunk in one bucket.

    It returns an array aligned with the keys for each chunk.
    """

    def run(table: pa.Table) -> pa.Table:
        W.lean()
        table = table.combine_chunks()
        n = table.column("n").to_pylist()
        keys = [W.unpack_sorted(x.as_py(), k) for x, k in zip(table.column("keys"), n)]
        vals = [W.unsqueeze(x.as_py(), k, dtype) if dtype is not None else None for x, k in zip(table.column("vals"), n)]
        out = [W.squeeze(np.ascontiguousarray(x)) for x in fn(keys, vals)]
        del keys, vals
        W.trim()
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "vals": pa.array(out, pa.binary())}, schema=ANSWER_ARROW)

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def gathered(answer: pa.Table, keys: np.ndarray, bits: int, dtype, columns: int = 0) -> np.ndarray:
    """The answers of one chunk put together in the order of its sorted ``keys``."""
    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << W.U(64 - bits))
    edges = np.concatenate(([0], cuts, [len(keys)]))
    out = np.zeros(len(keys), dtype)
    for b, v in zip(answer.column("bucket").to_pylist(), answer.column("vals")):
        i, j = edges[b], edges[b + 1]
        out[i:j] = W.unsqueeze(v.as_py(), int(j - i), dtype)
    return out


def resolve(chunks: DataFrame, answer: DataFrame, fn: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """``fn(chunk, rows, answers)`` for each chunk, with the answers it got (none: an empty table)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        W.lean()
        out = [fn(left.column("chunk")[i].as_py(), W.unpack_table(left.column("data")[i].as_py()), right) for i in range(left.num_rows)]
        W.trim()
        return pa.concat_tables(out) if out else empty

    empty = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema).empty_table()
    return chunks.select("chunk", "data").groupBy("chunk").cogroup(answer.groupBy("chunk")).applyInArrow(run, schema)
