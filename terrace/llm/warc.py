"""WARC archives as a PySpark data source, and their writing with revisit records for repeated payloads.

Records are plain; a response's payload is gzip-coded as its HTTP head says. Reading plans one partition for each group
of files, parses a record's WARC head first, and steps over the rest of records that pushed-down predicates on record
type or head fields exclude; payloads are decoded, and checked against their digests, only on demand. Predicates are
pushed down where the session sets `spark.sql.python.filterPushdown.enabled`, as :func:`read_archives` does.

Of rows with equal payloads the one with the smallest key is a response and the others revisit it. Defined cases: a null
payload is empty; rows with a null key, and repeated rows with the smallest key, are responses; payloads shorter than
``least`` bytes are never revisits. Line breaks in keys and addresses come back percent-coded, blanks at their ends not at all.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from terrace.llm.shared import shared_dir

VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: WARC head fields behind the columns that predicates can be pushed down to.
FIELDS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
#: Bytes of files that one reading task takes on, and rows of a batch.
SPLIT_BYTES, BATCH_ROWS = 64 << 20, 512
ID = "urn:x-record:"


def payload_digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(fields: dict[str, str]) -> bytes:
    """Head lines; line breaks inside a value, which would end it, are percent-coded, and blanks around it do not last."""
    return b"".join(f"{k}: {v}".replace("\r", "%0D").replace("\n", "%0A").encode() + b"\r\n" for k, v in fields.items()) + b"\r\n"


def record(key: str, uri: str, payload: bytes, refers_to: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record; a revisit has the payload's HTTP head and digest, but not its body."""
    fields = {"WARC-Type": "revisit" if refers_to is not None else "response", "WARC-Record-ID": f"<{ID}{key}>", "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Payload-Digest": payload_digest(payload), "Content-Type": "application/http; msgtype=response"}
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<{ID}{refers_to}>", "WARC-Profile": PROFILE}
        body = b""
    else:
        body = gzip.compress(payload, 1, mtime=0)
    http = b"HTTP/1.1 200 OK\r\n" + _head({"Content-Type": "text/html; charset=utf-8", "Content-Encoding": "gzip", "X-Payload-Bytes": str(len(payload))})
    fields["Content-Length"] = str(len(http) + len(body))
    return VERSION + _head(fields) + http + body + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    partial: str
    final: str


class ArchiveWriter(DataSourceArrowWriter):
    """One file for each task, given its name once the whole job is done."""

    def __init__(self, uri: str):
        self.uri = uri

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, path = fs.FileSystem.from_uri(self.uri)
        name = uuid.uuid4().hex
        partial = f"{path}/.{name}.partial"
        files.create_dir(path, recursive=True)
        with files.open_output_stream(partial) as out:
            for batch in iterator:
                columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                for key, uri, payload, refers in zip(*(columns[n] for n in ("key", "uri", "payload", "refers_to"))):
                    out.write(record(key.as_py() or "", uri.as_py() or "", payload.as_py() or b"", refers.as_py()))
        return Written(partial, f"{path}/part-{name}.warc")

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = fs.FileSystem.from_uri(self.uri)
        for m in messages:
            if m:
                files.move(m.partial, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = fs.FileSystem.from_uri(self.uri)
        for m in messages:
            if m:
                files.delete_file(m.partial)


@dataclass
class Files(InputPartition):
    paths: list[str]


class ArchiveReader(DataSourceReader):
    def __init__(self, uri: str, payload: str):
        self.uri, self.payload, self.tests = uri, payload, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in FIELDS and isinstance(f, (EqualTo, In, IsNull, IsNotNull, StringStartsWith)):
                self.tests.append((name, f))
            else:
                yield f

    def partitions(self) -> list[Files]:
        files, path = fs.FileSystem.from_uri(self.uri)
        found = files.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        out, size = [], 0
        for info in sorted((i for i in found if i.is_file and i.path.endswith(".warc")), key=lambda i: i.path):
            if not out or size + info.size > SPLIT_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(info.path)
            size += info.size
        return out or [Files([])]

    def wanted(self, row: dict[str, str | None]) -> bool:
        for name, f in self.tests:
            x = row[name]
            if isinstance(f, IsNull):
                ok = x is None
            elif isinstance(f, IsNotNull):
                ok = x is not None
            elif isinstance(f, EqualTo):
                ok = x == f.value
            elif isinstance(f, In):
                ok = x in f.value
            else:
                ok = x is not None and x.startswith(f.value)
            if not ok:
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.uri)
        names = [*FIELDS, "payload_bytes", "payload"]
        types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

        for path in partition.paths:
            with files.open_input_stream(path) as raw, io.BufferedReader(raw, 1 << 18) as source:
                for row in self._records(source):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= BATCH_ROWS or held > SPLIT_BYTES // 4:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    def _records(self, source) -> Iterator[dict]:
        while line := source.readline():
            if line != VERSION:
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            head = _fields(source)
            row = {c: _bare(head.get(f)) for c, f in FIELDS.items()}
            left = int(head["Content-Length"]) + 4
            if not self.wanted(row):
                _skip(source, left)
                continue
            about = {}
            while (line := source.readline()) not in (b"\r\n", b""):
                left -= len(line)
                name, _, value = line.decode("utf-8", "replace").partition(":")
                about[name.strip().lower()] = value.strip()
            left -= len(line)
            row |= {"payload_bytes": int(about["x-payload-bytes"]), "payload": None}
            if self.payload == "skip" or row["record_type"] != "response":
                _skip(source, left)
            else:
                payload = gzip.decompress(source.read(left)[:-4])
                if payload_digest(payload) != row["payload_digest"] or len(payload) != row["payload_bytes"]:
                    raise ValueError(f"payload of {row['record_id']} differs from its digest")
                if self.payload == "read":
                    row["payload"] = payload
            yield row


def _fields(source: io.BufferedReader) -> dict[str, str]:
    out = {}
    while (line := source.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().partition(":")
        out[name] = value.strip()
    return out


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def _skip(source: io.BufferedReader, n: int) -> None:
    while n > 0 and (got := len(source.read(min(n, 1 << 20)))):
        n -= got


class ArchiveSource(DataSource):
    """Format `warc`: option `path`, and `payload` = read, verify (decode and check only) or skip."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("payload", "read"))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def read_archives(spark: SparkSession, uri: str, payload: str = "read") -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", payload).load(uri)


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """``pages`` with ``payload`` as bytes and ``refers_to``: the smallest key with an equal payload, for all but that one.

    Only digests are grouped; what they decide joins the rows by key and digest, so that equal payloads never meet.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    digest = F.sha1(body)
    small = pages.select(F.col(key).alias("_key"), digest.alias("_digest")).filter((F.octet_length(F.coalesce(F.col(payload).cast("string"), F.lit(""))) >= least) & F.col(key).isNotNull())
    first = small.groupBy("_digest").agg(F.min("_key").alias("_first"))
    later = small.join(first, "_digest").filter("_key > _first").distinct()
    rows = pages.withColumn("_digest", digest)
    joined = rows.join(later, (rows[key] == later["_key"]) & (rows["_digest"] == later["_digest"]), "left")
    return joined.select(*[rows[c] for c in pages.columns if c != payload], body.alias(payload), F.col("_first").alias("refers_to"))


def archive(pages: DataFrame, uri: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> None:
    """Write a record for each row to archives below ``uri``."""
    pages.sparkSession.dataSource.register(ArchiveSource)
    rows = with_revisits(pages.select(key, url, payload), key, payload, least)
    rows.select(F.col(key).cast("string").alias("key"), F.col(url).cast("string").alias("uri"), F.col(payload).alias("payload"), F.col("refers_to").cast("string").alias("refers_to")).write.format("warc").mode("append").option("path", uri).save()


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Archive ``pages`` and read the archives back: key, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    uri = shared_dir(spark, "warc")
    archive(pages, uri, key, url, payload)
    kind = pages.schema[key].dataType
    plain = lambda c: F.when(F.length(c) > len(ID), F.substr(c, F.lit(len(ID) + 1))).cast(kind)
    return read_archives(spark, uri, "verify").select(plain(F.col("record_id")).alias(key), "payload_bytes", F.substr(F.col("payload_digest"), F.lit(6)).alias("payload_digest"), "record_type", plain(F.col("refers_to")).alias("refers_to"))
