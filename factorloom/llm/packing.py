"""Sum-of-squares packing of token ids into sequences of one length.

Every task packs the documents it reads, in order, and nothing is shuffled.  A
document is its ids and one end id.  Stretches that fill a sequence alone are
sequences; the rest (less than a sequence) is placed online: an array holds the
number of open sequences at each fill level, and a piece of ``s`` ids goes to
the level ``h`` that leaves the least sum of squares of that array,
``2 * (open[h + s] - open[h]) + 2`` more than before (a full sequence leaves the
array, a new one comes from no level).  Of equal choices the fullest sequence
is taken, and of its level the youngest.

Open sequences are bounded.  When there are ``most_open`` of them, and when a
task ends, they are closed: their pieces, least filled sequences first, are cut
to fill up the others, and what is then left (less than one sequence) is cut at
the powers of two that it is the sum of, which need no padding.  So padding is
nothing at all, for two cuts at most for each open sequence and ten more.

A task that runs again reads the same rows in the same order and numbers its
sequences by its partition, so results agree; sequence ids have gaps.

Definitions for odd input: a null or empty text is one end id; texts of any
length are taken whole (memory follows the longest text); repeated rows are
packed as often as they occur; a null id stays null; an empty table gives no
pieces; other columns are left out, but for those named in ``keep``, which win
over results of the same name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._chunks import slices
from ._columns import DOC, bundle, col, unbundle
from ._ship import ship

#: The pattern by which byte-level BPE of this family cuts texts.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of texts under a tokenizer file, as the ``tokenizers`` library gives them.

    Plain byte-level BPE whose ids follow its merges is encoded by ``tiktoken``
    with the vocabulary of the same file, several times faster; other models by
    the library itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        self.fast = self._fast(given)
        if self.fast is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()

    @staticmethod
    def _fast(given: dict):
        model, before = given["model"], given.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and given.get("normalizer") is None and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain = plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        added = given.get("added_tokens") or []
        if not plain or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            return None
        # bytes that print stand for themselves, the others for what follows 255
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {a["content"]: a["id"] for a in added}
        ranks = {bytes(byte[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in merges]
        if ids != sorted(ids) or len(merges) + 256 != len(ranks) or (ids and max(ranks[bytes([b])] for b in range(256)) > ids[0]):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.fast is not None:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


class Packer:
    """Places pieces (document number, start, ids) online; ``done`` gets each finished sequence as a list of pieces."""

    def __init__(self, length: int, done, most_open: int = 4096):
        self.length, self.done, self.most = length, done, most_open
        self.levels = np.zeros(length + 1, np.int64)  # open sequences at each level; none at 0 or full
        self.held: list[list[list]] = [[] for _ in range(length)]
        self.open = 0

    def level_for(self, s: int) -> int:
        """The level (0: a new sequence) at which ``s`` more ids leave the least sum of squares."""
        n, x = self.length, self.levels
        change = 2 * (x[s:] - x[: n + 1 - s]) + 2
        change[n - s] -= 1  # a full sequence is in no level: -2 x + 1
        change[x[: n + 1 - s] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * x[s] + 1
        return n - s - int(np.argmin(change[::-1]))

    def add(self, doc: int, ids: np.ndarray) -> None:
        n, at = self.length, 0
        while len(ids) - at >= n:
            self.done([(doc, at, ids[at : at + n])])
            at += n
        s = len(ids) - at
        if not s:
            return
        h = self.level_for(s)
        pieces = self.held[h].pop() if h else []
        self.levels[h] -= h > 0
        self.open -= h > 0
        pieces.append((doc, at, ids[at:]))
        if h + s == n:
            self.done(pieces)
            return
        self.held[h + s].append(pieces)
        self.levels[h + s] += 1
        self.open += 1
        if self.open >= self.most:
            self.close()

    def close(self) -> None:
        """Finish all open sequences without padding."""
        n = self.length
        left = [(h, p) for h in range(n) for p in self.held[h]]  # least filled first
        self.held = [[] for _ in range(n)]
        self.levels[:] = 0
        self.open = 0
        spare: list[tuple] = []  # pieces to fill up with, the next one last
        first, last = 0, len(left) - 1
        while first <= last:
            h, pieces = left[last]
            last -= 1
            while h < n and (spare or first <= last):
                if not spare:
                    spare = left[first][1][::-1]
                    first += 1
                doc, at, ids = spare.pop()
                take = min(len(ids), n - h)
                pieces.append((doc, at, ids[:take]))
                if take < len(ids):
                    spare.append((doc, at + take, ids[take:]))
                h += take
            if h == n:
                self.done(pieces)
            else:
                spare = pieces[::-1]
        # what is left is less than two sequences: one perhaps, then powers of two
        rest = sum(len(p[2]) for p in spare)
        while rest:
            size = min(n, 1 << (rest.bit_length() - 1))
            out, need = [], size
            while need:
                doc, at, ids = spare.pop()
                take = min(len(ids), need)
                out.append((doc, at, ids[:take]))
                if take < len(ids):
                    spare.append((doc, at + take, ids[take:]))
                need -= take
            self.done(out)
            rest -= size


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, text: str = "text", keep: Sequence[str] = ("doc_id",), most_open: int = 4096) -> DataFrame:
    """One row for each piece: ``keep``, ``start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` is binary: little-endian unsigned 32-bit ids.  ``start`` counts the
    ids of the document before the piece, ``offset`` those of the sequence.
    """
    new = [("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    kept = list(keep)
    ship(docs.sparkSession)
    given = docs.select(bundle(kept), col(text).alias("__text"))
    schema = T.StructType([given.schema[DOC], *(T.StructField(n, t) for n, t in new)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        rows: dict[int, list] = {}  # documents with open pieces or rows not yet handed on: [cells, ids in all, ids not handed on]
        out: list[tuple] = []
        size = sequence = 0

        def done(pieces: list[tuple]) -> None:
            nonlocal sequence, size
            at = 0
            for doc, start, ids in pieces:
                out.append((doc, start, ids.tobytes(), part << 32 | sequence, at))
                at += len(ids)
            size += at
            sequence += 1

        def handed() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if out:
                doc, start, ids, seq, at = zip(*out)
                cells = pa.concat_arrays([rows[d][0] for d in doc])
                longs = lambda x: pa.array(x, pa.int64())
                table = [cells, longs(start), longs([len(b) // 4 for b in ids]), pa.array(ids, pa.binary()), longs([rows[d][1] for d in doc]), longs(seq), longs(at)]
                for d, b in zip(doc, ids):
                    rows[d][2] -= len(b) // 4
                    if not rows[d][2]:
                        del rows[d]
                out.clear()
                size = 0
                yield pa.RecordBatch.from_arrays(table, names=names)

        packer = Packer(length, done, most_open)
        number = 0
        for t in slices(batches, "__text", 4 << 20):
            cells, texts = t.column(DOC).combine_chunks(), t.column("__text")
            for i in range(t.num_rows):
                ids = np.append(encode(texts[i].as_py() or ""), np.array([end_id], "<u4"))
                # a copy, so that one open piece does not hold the whole batch
                rows[number] = [pa.array([cells[i].as_py()], cells.type), len(ids), len(ids)]
                packer.add(number, ids)
                number += 1
                if size > 1 << 20:
                    yield from handed()
            yield from handed()
        packer.close()
        yield from handed()

    return given.mapInArrow(run, schema).select(*unbundle(kept), *(n for n, _ in new if n not in kept))
