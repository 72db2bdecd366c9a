"""Web archives with an index: records are written once and read by byte ranges.

Each task writes one archive of gzip members in the shared folder and returns
an index row (file, offset, length, url, digest) for every record.  A task that
runs again writes another file under its own attempt's name, and only the rows
of the attempt that counted are in the index, so lost executors do no harm.
Equal payloads are stored once: the record with the largest page_id is the
response, the others are revisit records that refer to it.

Reading starts from index rows: they are sorted by file and offset, neighbours
are joined to one ranged read if little lies between them, and records are cut
out, unpacked and held against their digests.

Definitions for odd input: a null or empty page has an empty payload; a null
url is left out of the record; repeated rows of one id and payload are all
responses; a null page_id counts below all others; pages of any length are
taken whole; an empty table gives an empty archive and result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._ship import ship
from ._store import materialise, new_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("page_id", T.LongType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record."""
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~^`{|}\\\"<>")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to, digest))]
    # extension fields: ids and the payload's length, which a revisit record does not show otherwise
    head += [("X-Payload-Length", str(len(payload)))] + [("X-Page-Id", str(page_id))] * (page_id is not None) + [("X-Refers-To-Page", str(refers_to))] * (revisit and refers_to is not None)
    block = _HTTP + (b"" if revisit else payload)
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; a response's payload is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record ends in the wrong place")
    revisit = field["WARC-Type"] == "revisit"
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
    if not revisit and sha1_base32(payload) != digest:
        raise ValueError(f"payload and digest {digest} differ")
    number = lambda k: int(field[k]) if k in field else None
    uri = field.get("WARC-Target-URI")
    return {
        "page_id": number("X-Page-Id"),
        "url": uri,
        "payload_bytes": number("X-Payload-Length") if revisit else len(payload),
        "payload_digest": digest,
        "record_type": field["WARC-Type"],
        "refers_to": number("X-Refers-To-Page"),
        "payload": payload,
    }


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0, path: str | None = None, date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, str]:
    """Write ``pages`` as archives; returns the index, which is a table beside them, and the folder."""
    spark = pages.sparkSession
    ship(spark)
    folder = path or new_path(spark, "archive")
    given = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"))
    given = given.withColumn("sha1", F.sha1("payload"))
    long_enough = F.octet_length("payload") >= revisit_from
    copies = given.where(long_enough).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select(F.col("sha1").alias("copied"), "first")
    copies, _ = materialise(copies, "archive-copies")
    decided = given.join(copies, (F.col("sha1") == F.col("copied")) & long_enough, "left")
    decided = decided.select("page_id", "url", "payload", "first", (F.col("copied").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/data/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        store, place = _filesystem(name)
        out, offset = None, 0
        done: list[pa.RecordBatch] = []  # shown when the file is complete
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(place.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(place, compression=None)
            rows = []
            for r in batch.to_pylist():
                payload = r["payload"].encode()
                digest = sha1_base32(payload)
                member = gzip.compress(record(r["page_id"], r["url"], payload, digest, r["first"], r["revisit"], date), 6, mtime=0)
                out.write(member)
                rows.append((name, offset, len(member), r["url"], digest, r["page_id"]))
                offset += len(member)
            done.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), index_arrow)], schema=index_arrow))
        if out is not None:
            out.close()
            if store.get_file_info(place).size != offset:
                raise OSError(f"{name} is not whole")
        yield from done

    index_arrow = to_arrow_schema(INDEX)
    decided.mapInArrow(write, INDEX).write.option("compression", "zstd").parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index"), folder


def read_records(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20, stretch: int = 16 << 20) -> DataFrame:
    """RECORD rows for the selected rows of an index.

    Ranges of one file are joined if at most ``gap`` bytes lie between them and
    the read stays under ``most`` bytes; a task reads a ``stretch`` of a file.
    """
    ship(index.sparkSession)
    spots = index.select("file", "offset", "length").withColumn("stretch", F.floor(F.col("offset") / stretch))
    # by the bytes to read: the index rows themselves are so few that Spark would give them one task
    selected = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()["bytes"]
    tasks = max(2 * -(-selected // stretch), index.sparkSession.sparkContext.defaultParallelism)
    sorted_ = spots.repartition(int(tasks), "file", "stretch").sortWithinPartitions("file", "offset")
    arrow = to_arrow_schema(RECORD)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, int]] = []
        handle: list = [None, None]

        def fetch() -> Iterator[pa.RecordBatch]:
            if handle[0] != held[0][0]:
                store, place = _filesystem(held[0][0])
                handle[:] = held[0][0], store.open_input_file(place)
            begin = held[0][1]
            data = handle[1].read_at(held[-1][1] + held[-1][2] - begin, begin)
            rows = [parse_record(gzip.decompress(data[o - begin : o - begin + n])) for _, o, n in held]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if held and (file != held[0][0] or offset - (held[-1][1] + held[-1][2]) > gap or offset + length - held[0][1] > most):
                    yield from fetch()
                    held = []
                held.append((file, offset, length))
        if held:
            yield from fetch()

    return sorted_.mapInArrow(read, RECORD)
