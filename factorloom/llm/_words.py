"""Vectorised words, hashes and packed blobs (numpy over Arrow buffers).

A word is a maximal run of bytes other than the six ASCII white-space bytes,
i.e. ``[^\\x20\\x09-\\x0D]+``.  Word hashes take the bytes in blocks of eight, each
scrambled into the state that the blocks before it left (a word of up to eight
bytes has a hash that no other word of its length has); words of more than
LONG_WORD bytes go through BLAKE2b.  Two lanes of 64 bits with different
constants make 128 bits where a digest needs them.  Windows are hashed by
pairing, with a scrambling at every step, so neither words nor windows of
regular patterns meet by construction.  Hashes are the same in every process.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim, _libc.mallopt
except (OSError, AttributeError):  # another C library
    _libc = None
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LONG_WORD = 256
_ODD = U(0xD6E8FEB86659FD93)
_STEP = U(0x9E3779B97F4A7C15)
#: Which bytes of a block belong to a word of 0 to 8 more bytes.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (distinct values stay distinct)."""
    h = h + U(salt * 0x9E3779B97F4A7C15 % 2**64)
    t = h >> U(30)
    h ^= t
    h *= U(0xBF58476D1CE4E5B9)
    np.right_shift(h, U(27), out=t)
    h ^= t
    h *= U(0x94D049BB133111EB)
    np.right_shift(h, U(31), out=t)
    h ^= t
    return h


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offsets of the texts (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-end byte of each word, and the index of each text's first word."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.empty(len(buf), bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z if ``lower``; the lanes are two different hashes."""
    data = np.zeros(len(buf) + 8, np.uint8)
    data[: len(buf)] = _LOWER[buf] if lower else buf
    blocks = np.ndarray(len(buf) + 1, "<u8", data, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64), 1000 + lane)
    out ^= blocks[starts] & _MASK[np.minimum(size, 8)]
    out = mix(out, 2000 + lane)
    more = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    at = 8
    while len(more):
        h = out[more] * _ODD
        h ^= blocks[starts[more] + at] & _MASK[np.minimum(size[more] - at, 8)]
        out[more] = mix(h, 3000 + lane)
        at += 8
        more = more[size[more] > at]
    for k in np.flatnonzero(size > LONG_WORD):
        digest = hashlib.blake2b(data[starts[k] : ends[k]], digest_size=16).digest()
        out[k] = int.from_bytes(digest[8 * lane : 8 * lane + 8], "little")
    return out


def grams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every ``n`` consecutive values (``len(h) - n + 1`` of them), put together from windows of 1, 2, 4, ..."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, have, level, width = None, 0, h, 1
    while True:
        if n & width:
            part = level[have : have + m]
            out = mix(part, 100 + salt) if out is None else mix(out * _ODD + part, 100 + salt)
            have += width
        if 2 * width > n:
            return out
        level = mix(level[:-width] * _STEP + level[width:], width)
        width *= 2


def inside_doc(word_offs: np.ndarray, n: int, m: int) -> np.ndarray:
    """Which of ``m`` window starts have ``n`` words of one text."""
    ok = np.zeros(m, bool)
    if m > 0:
        step = np.zeros(m + 1, np.int32)
        first, last = word_offs[:-1], word_offs[1:] - n + 1
        some = last > first
        np.add.at(step, first[some], 1)
        np.add.at(step, np.minimum(last[some], m), -1)
        ok = np.cumsum(step[:m]) > 0
    return ok


def covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which of ``words`` positions lie in a window of ``n`` that begins at one of ``starts``."""
    step = np.zeros(words + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + n, words), -1)
    return np.cumsum(step[:words]) > 0


def doc_of(word_offs: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(word_offs) - 1), np.diff(word_offs))


def lean() -> None:
    """Worker settings: large arrays go back to the system as soon as they are free, and small ones soon."""
    global _lean
    if not _lean:
        _lean = True
        pa.set_memory_pool(pa.system_memory_pool())
        if _libc is not None:
            for option, value in ((-3, 8 << 20), (-1, 32 << 20), (-8, 2)):  # thresholds for mmap and trimming, arenas
                _libc.mallopt(option, value)


def trim() -> None:
    """Hand freed memory back to the system, so that an idle worker does not keep its peak."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


_lean = False

# Packed blobs -----------------------------------------------------------------

def squeeze(a: np.ndarray) -> bytes:
    """An integer array as bytes: byte planes, zstd."""
    if not len(a):
        return b""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueeze(blob: bytes, n: int, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    if not n:
        return np.zeros(0, dtype)
    raw = pa.decompress(blob, decompressed_size=n * dtype.itemsize, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(n)


def pack_sorted(a: np.ndarray) -> bytes:
    """A sorted uint64 array as deltas."""
    d = a.copy()
    d[1:] -= a[:-1]
    return squeeze(d)


def unpack_sorted(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unsqueeze(blob, n, np.uint64), dtype=np.uint64)


def pack_table(batch: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(batch)
    return sink.getvalue().to_pybytes()


def unpack_table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def blob_of(column: pa.Array, i: int) -> bytes:
    return column[i].as_py()
