"""WARC archives, written index first and read back by coalesced byte ranges.

Every record is a gzip member of its own. Writing gives an index row per record: file, offset, length, URL
and digest. Reading selects index rows, sorts them by file and offset, joins neighbouring byte ranges into
one read, and cuts the records out of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, text_bytes, written

INDEX = (
    "file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long,"
    " record_type string, refers_to long"
)
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Ranges with a gap of at most GAP bytes are read together, up to READ bytes at once.
GAP, READ = 64 << 10, 8 << 20
#: Bytes of archives that one task reads, about; a small selection is still dealt to all cores.
STRETCH = 64 << 20
SOFTWARE = "WARC/1.1"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(uri: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(page_id, url, payload: bytes, digest_: str, refers_to) -> bytes:
    """A record's bytes; a revisit, which has no payload, if refers_to isn't null."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head.encode() + (payload if refers_to is None else b"")
    lines = [
        SOFTWARE,
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest_}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub("[\r\n]", lambda m: "%%%02X" % ord(m[0]), url))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(member: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of a record; a response's payload must fit its digest."""
    data = zlib.decompress(member, 31)
    end = data.index(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in data[:end].decode().split("\r\n")[1:])
    kind, said = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    n = int(head["X-Payload-Length"])
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if len(payload) != n or digest(payload) != said:
            raise ValueError(f"record of page {head.get('X-Page')} is damaged")
    page, to = head.get("X-Page"), head.get("X-Refers-To-Page")
    return page and int(page), head.get("WARC-Target-URI"), n, said, kind, to and int(to)


def _payloads(batches):
    """page_id, url, payload, digest and size of each page."""
    for b in batches:
        html = text_bytes(b.column(2))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(html, pa.binary()), pa.array([digest(x) for x in html]), pa.array([len(x) for x in html], pa.int64())],
            ["page_id", "url", "payload", "payload_digest", "payload_bytes"],
        )


def _digests(batches):
    for b in _payloads(batches):
        yield b.select([0, 3, 4])


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, level: int = 4) -> DataFrame:
    """Writes the pages (page_id, url, html; others are ignored) as archives in folder and returns the index.

    Of pages with equal payloads of at least min_bytes bytes that with the smallest page_id is a response and
    the others revisit it; a null html is an empty payload; a null page_id is never the one referred to
    unless the whole group has none (then all are responses). Repeated rows give a record each. folder is a
    URI that executors and driver share, by default below spark.checkpoint.dir. The index is written there
    before it is returned: a task that is run again writes a file of another name, and only files of tasks
    that ended are in the index. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    source = pages.select("page_id", "url", "html")
    same = ["payload_digest", "payload_bytes"]
    few = source.mapInArrow(_digests, "page_id long, payload_digest string, payload_bytes long").filter(F.col("payload_bytes") >= min_bytes)
    first = few.groupBy(*same).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = written(first, "first-payloads")  # so that the join deals both sides out and can split a payload that is common
    rows = source.mapInArrow(_payloads, "page_id long, url string, payload binary, payload_digest string, payload_bytes long")
    told = rows.join(first, same, "left").select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )

    def run(batches):
        fs, at = _filesystem(folder)
        fs.create_dir(f"{at}/archives", recursive=True)
        name = f"archives/{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        for b in batches:
            rows = []
            for page, url, payload, dig, n, to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                member = gzip.compress(record(page, url, payload, dig, to), level, mtime=0)
                out.write(member)
                rows.append((name, offset, len(member), page, url, dig, n, "response" if to is None else "revisit", to))
                offset += len(member)
            yield _rows(rows, INDEX)
        if out is not None:
            out.close()

    told.mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index").withColumn("folder", F.lit(folder))


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def read_records(index: DataFrame) -> DataFrame:
    """The records of index rows (folder, file, offset, length; any selection of them), read in byte order.

    The rows are sorted by file and offset and cut into ranges; their number follows from the bytes to read, so
    each task reads about STRETCH bytes of neighbouring records. An empty selection gives no rows.
    """

    def run(batches):
        opened, waiting, start, end = None, [], 0, 0

        def read():
            (folder, file), cuts = opened, waiting
            fs, at = _filesystem(folder)
            with fs.open_input_file(f"{at}/{file}") as f:
                f.seek(start)
                data = f.read(end - start)
            return _rows([parse(data[o - start : o - start + n]) for o, n in cuts], RECORDS)

        for b in batches:
            for folder, file, offset, n in zip(*(b.column(c).to_pylist() for c in ("folder", "file", "offset", "length"))):
                if waiting and ((folder, file) != opened or offset > end + GAP or offset + n - start > READ):
                    yield read()
                    waiting = []
                if not waiting:
                    opened, start = (folder, file), offset
                waiting.append((offset, n))
                end = offset + n
        if waiting:
            yield read()

    placed, by = index.select("folder", "file", "offset", "length"), ["folder", "file", "offset"]
    size = placed.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-size // STRETCH), index.sparkSession.sparkContext.defaultParallelism)
    return placed.repartitionByRange(tasks, *by).sortWithinPartitions(*by).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes archives of all pages and reads every record back: RECORDS."""
    return read_records(write_archives(pages, min_bytes=min_bytes))
