"""Candidates from templates, files of text, or a function, all with one schema.

A Python data source (``candidates``): templates are one partition, each file of
texts is one, and a function is called once for each of its partitions, on the
executors, so a slow generator runs in as many tasks as it has partitions.
Files are read as streams: a task keeps a piece of its file, not all of it.
"""

from __future__ import annotations

import codecs
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans import registry
from ..workers import ship
from . import store

SCHEMA = "source string, origin string, place long, expr string"
KINDS = ("template", "file", "function")


class _Part(InputPartition):
    def __init__(self, kind: str, origin: str, number: int):
        super().__init__(f"{kind}:{origin}:{number}")
        self.kind, self.origin, self.number = kind, origin, number


#: Bytes of a file that are read at once, and rows that are handed on at once.
CHUNK, ROWS = 1 << 20, 4096
_OPEN, _CLOSED = re.compile("<expr>", re.I), re.compile("</expr>", re.I)


def _pieces(path: str) -> Iterator[str]:
    """A text file, by URI or local path, piece by piece."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    decoder = codecs.getincrementaldecoder("utf-8")()
    with where.open_input_stream(name) as f:
        while data := f.read(CHUNK):
            yield decoder.decode(data)
    yield decoder.decode(b"", True)


def tagged_in(pieces: Iterable[str]) -> Iterator[str]:
    """What is between the tags of a text that comes in pieces; no more is kept than a piece and what is open."""
    held, inside, seen = "", False, 0
    for piece in pieces:
        held += piece
        at = 0
        while True:
            # of what is held already, a tag can only be in the last few characters
            found = (_CLOSED if inside else _OPEN).search(held, max(at, seen))
            if not found:
                break
            if inside:
                yield held[at : found.start()].strip()
            at, inside = found.end(), not inside
        held = held[at:] if inside else held[max(at, len(held) - len("<expr")) :]
        seen = max(0, len(held) - len("</expr")) if inside else 0


def lines_in(pieces: Iterable[str]) -> Iterator[str]:
    """The lines of a text that comes in pieces; an end of line of two characters may give an empty one more."""
    held: list[str] = []
    for piece in pieces:
        for line in piece.splitlines(keepends=True):
            held.append(line)
            if line.splitlines()[0] != line:
                yield "".join(held).strip()
                held = []
    yield "".join(held).strip()


def file_expressions(path: str) -> Iterator[str]:
    """The expressions of a file (tagged ones, else lines), as ``expressions_in`` finds them, without the file as a whole."""
    tags = False
    for text in tagged_in(_pieces(path)):
        tags = True
        if text:
            yield text
    if not tags:
        yield from filter(None, lines_in(_pieces(path)))


class _Reader(DataSourceReader):
    def __init__(self, parts: list[_Part], surface: str, make: Callable[[int], Iterable[str]] | None):
        self.parts, self.surface, self.make = parts, surface, make

    def partitions(self) -> list[InputPartition]:
        return self.parts

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        from factorloom.operators.candidates import expressions_in

        if part.kind == "template":
            found: Iterable[str] = registry.templates(self.surface)
        elif part.kind == "file":
            found = file_expressions(part.origin)
        else:
            found = (e for text in self.make(part.number) for e in expressions_in(text))
        found, place = iter(found), 0
        while some := list(itertools.islice(found, ROWS)):
            n = len(some)
            columns = [pa.array([part.kind] * n), pa.array([part.origin] * n), pa.array(range(place, place + n), pa.int64()), pa.array(some, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["source", "origin", "place", "expr"])
            place += n


def _source(parts: list[_Part], surface: str, make: Callable[[int], Iterable[str]] | None) -> type[DataSource]:
    class Candidates(DataSource):
        @classmethod
        def name(cls) -> str:
            return "candidates"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(parts, surface, make)

    return Candidates


def read_candidates(spark: SparkSession, kind: str, surface: str = registry.CROSS_SECTION, path: str | None = None, make: Callable[[int], Iterable[str]] | None = None, partitions: int = 1) -> DataFrame:
    """``source, origin, place, expr`` of one kind of source.

    ``template``: those of a benchmark ``surface``.  ``file``: the expressions of a text file, or of
    each file of a folder (tagged ones, else lines).  ``function``: those in the completions that
    ``make(number)`` gives for each of ``partitions`` numbers; it is sent to the executors.
    """
    if kind == "template":
        parts = [_Part(kind, registry.surface(surface).name, 0)]
    elif kind == "file":
        if not path or not store.exists(spark, path):
            raise ValueError(f"there are no candidates at {path!r}")
        inside = [n for n in store.names_in(spark, path) if not n.startswith((".", "_"))]
        single = inside == [path.rstrip("/").rpartition("/")[2]]
        parts = [_Part(kind, path if single else f"{path.rstrip('/')}/{n}", k) for k, n in enumerate(inside)]
    elif kind == "function":
        if make is None:
            raise ValueError("a function source needs a function")
        parts = [_Part(kind, getattr(make, "__name__", "function"), k) for k in range(max(1, int(partitions)))]
    else:
        raise ValueError(f"unknown candidate source {kind!r}; known: {', '.join(KINDS)}")
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    ship(spark)
    spark.dataSource.register(_source(parts, surface, make))
    return spark.read.format("candidates").load()
