"""WARC archives: written by tasks in the shared folder, read back by a Python data source.

Every record is a gzip member of its own whose extra field holds its compressed and plain size, so a
reader that does not want a record goes on after its header block. The source plans one partition per
file (files roll at a bounded size), takes filters on ``record_type``, ``page_id`` and ``url``, parses the
header block first and inflates a payload only for records that pass and only if the column is asked for.

Defined results: a null html is an empty payload; of rows with equal payloads the largest page_id is the
response and equal ids are all responses; a null id is the smallest and is written as an absent header;
null urls are absent headers; a url that no header line can hold as it is (line breaks, white space at its
ends) is written percent-encoded, with a header that says so, and read back as it was; a file that was cut
raises; an empty table gives an archive without files; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from topicloom.llm.text import steps
from topicloom.session import RunFolder

FILE_BYTES = 32 << 20
LEVEL = 1
_SCHEMA = (
    "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint,"
    " payload binary"
)
# Header lines and the columns they fill; the last three are this library's own.
_HEADERS = {
    "WARC-Type": "record_type",
    "WARC-Target-URI": "url",
    "WARC-Payload-Digest": "payload_digest",
    "X-Page-Id": "page_id",
    "X-Payload-Length": "payload_bytes",
    "X-Refers-To-Page-Id": "refers_to",
}
_NUMBERS = {"page_id", "payload_bytes", "refers_to"}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


_ENCODED = "X-Target-URI-Encoded"


def record(fields: dict, payload: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(fields, sort_keys=True))}>"]
    for header, column in _HEADERS.items():
        if fields.get(column) is not None:
            value = str(fields[column])
            if column == "url" and (value != value.strip() or "\r" in value or "\n" in value):
                value = quote(value)
                lines.append(f"{_ENCODED}: true")
            lines.append(f"{header}: {'sha1:' if column == 'payload_digest' else ''}{value}")
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"Content-Length: {len(payload)}", "", ""]
    plain = "\r\n".join(lines).encode() + payload + b"\r\n\r\n"
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, len(body), len(plain) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def records(data: bytes, wanted, with_payload: bool) -> Iterator[dict]:
    """Records of a file that ``wanted`` accepts by their headers."""
    at = 0
    while at < len(data):
        size = struct.unpack_from("<HII", data, at + 14)[1]
        body = memoryview(data)[at + 24 : at + 24 + size]
        inflate = zlib.decompressobj(-15)
        head, rest = b"", body
        while b"\r\n\r\n" not in head:
            more = inflate.decompress(rest, 1024)
            if not more:
                raise ValueError("a record ends inside its header block")
            head += more
            rest = inflate.unconsumed_tail
        top, _, begun = head.partition(b"\r\n\r\n")
        lines = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
        out = dict.fromkeys([*_HEADERS.values(), "payload"])
        for header, column in _HEADERS.items():
            if (value := lines.get(header)) is not None:
                value = value.removeprefix("sha1:") if column == "payload_digest" else value
                value = unquote(value) if column == "url" and _ENCODED in lines else value
                out[column] = int(value) if column in _NUMBERS else value
        if wanted(out):
            if with_payload:
                size_of = int(lines["Content-Length"])
                out["payload"] = (begun + inflate.decompress(rest))[:size_of]
                if len(out["payload"]) < size_of:
                    raise ValueError("a record ends inside its payload")
            yield out
        at += 24 + size + 8


def write_archive(pages: DataFrame, run: RunFolder, min_bytes: int = 0) -> str:
    """Write a record per row of ``pages(page_id, url, html)``; returns the folder that lists the files.

    Payloads of fewer than ``min_bytes`` bytes are all responses.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"))
    # the digest alone decides, so no payload moves before its record type is known
    first = rows.where(F.octet_length("html") >= min_bytes).groupBy(F.sha1("html").alias("d")).agg(
        F.max("page_id").alias("best"), F.count("*").alias("n")
    )
    typed = rows.withColumn("d", F.sha1("html")).join(first, "d", "left").select(
        "page_id", "url", "html", F.when((F.col("n") > 1) & ~F.col("page_id").eqNullSafe(F.col("best")), F.col("best")).alias("refers_to")
    )
    target = f"{run.path}/archive"

    def write(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(target)
        fs.create_dir(root, recursive=True)
        buffer, size, n = [], 0, 0

        def close():
            name = f"{root}/{uuid.uuid4().hex}.warc.gz"
            with fs.open_output_stream(name, compression=None) as out:
                out.write(b"".join(buffer))
            return pa.record_batch({"file": [name], "records": pa.array([n], pa.int64())})

        for batch in batches:
            for part in steps(batch, "html"):
                for row in part.to_pylist():
                    payload = row["html"].encode()
                    revisit = row["refers_to"] is not None
                    data = record(
                        {
                            **{k: row[k] for k in ("page_id", "url", "refers_to")},
                            "record_type": "revisit" if revisit else "response",
                            "payload_digest": digest(payload),
                            "payload_bytes": len(payload),
                        },
                        b"" if revisit else payload,
                    )
                    buffer.append(data)
                    size, n = size + len(data), n + 1
                    if size >= FILE_BYTES:
                        yield close()
                        buffer, size, n = [], 0, 0
        if buffer:
            yield close()

    # only files of tasks that were committed are listed; those of lost attempts are never read
    run.write(typed.mapInArrow(write, "file string, records bigint"), "archive-files")
    return f"{run.path}/archive-files"


class _File(InputPartition):
    def __init__(self, file: str):
        self.file = file


class WarcSource(DataSource):
    """``spark.read.format("warc").option("files", folder).option("payload", "true")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.payload = options["files"], options.get("payload", "true") == "true"
        self.accepted: list[tuple[str, set]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute[0] in ("record_type", "page_id", "url"):
                self.accepted.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self):
        fs, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        files = pyarrow.dataset.dataset(root, filesystem=fs, format="parquet").to_table(columns=["file"])["file"].to_pylist()
        return [_File(f) for f in sorted(files)]

    def read(self, partition):
        if partition is None:  # an archive without files
            return
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.folder)
        with fs.open_input_stream(partition.file, compression=None) as stream:
            data = stream.read()
        wanted = lambda r: all(r[c] in values for c, values in self.accepted)
        columns = [f.strip().split(" ")[0] for f in _SCHEMA.split(",")]
        kinds = pa.schema([(c, pa.int64() if c in _NUMBERS else pa.binary() if c == "payload" else pa.string()) for c in columns])
        rows, size = [], 0
        for r in records(data, wanted, self.payload):
            rows.append(r)
            size += len(r["payload"] or b"")
            if size > 4 << 20 or len(rows) == 5000:
                yield pa.RecordBatch.from_pylist(rows, kinds)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


def read_archive(spark: SparkSession, files: str, payload: bool = True) -> DataFrame:
    """The records of the files that ``files`` lists."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("files", files).option("payload", str(payload).lower()).load()


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write, read back, and describe every record from its payload or, for a revisit, from its headers."""
    run = RunFolder(pages.sparkSession, "warc")
    files = write_archive(pages, run, min_bytes)

    def check(batches):
        for batch in batches:
            payloads = batch["payload"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], pa.array(map(len, payloads), pa.int64()), pa.array(map(digest, payloads), pa.string()), batch["record_type"], batch["refers_to"]],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    columns = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    responses = read_archive(pages.sparkSession, files).where("record_type = 'response'").mapInArrow(check, columns)
    revisits = read_archive(pages.sparkSession, files, False).where("record_type = 'revisit'")
    return responses.unionByName(revisits.select(*responses.columns))
