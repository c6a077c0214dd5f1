"""WARC archives as a Spark data source (operator 6): ``spark.read.format("warc")``.

Reading plans one partition for each run of files of about ``bytesPerPartition``.
Equality, IN and prefix predicates on the record type, the URI and other header columns are pushed
down.  A record's headers are parsed first; if they fail a predicate, its block is
passed over: uncompressed files seek beyond it, compressed ones discard it.  Without
option ``payload`` (true by default) no payload is sent to Spark, and with ``verify``
(false by default) each full payload is held against its digest as it passes.

Writing makes one file a task, one record a gzip member (``compress``, true by
default); the commit renames the tasks' files, so those of failed attempts don't count.
Paths can be of any file system that pyarrow knows.

Results for odd input: a null payload is an empty one; records need no URI, date or
digest; a revisit has HTTP headers and no payload, and its ``payload_length`` is what
those headers state; an empty folder or table gives no record; a cut-off record raises.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

SCHEMA = "record_id string, record_type string, target_uri string, record_date string, refers_to string, payload_digest string, payload_length long, content_type string, payload binary"

#: Header of each column that is taken from a header as it is.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "record_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}

BLOCK = 1 << 20


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


class _Plain:
    """Bytes of an uncompressed archive; passing over is seeking."""

    def __init__(self, f):
        self.f, self.end = f, None

    def line(self) -> bytes:
        return self.f.readline()

    def read(self, n: int) -> bytes:
        return self.f.read(n)

    def skip(self, n: int) -> None:
        if self.end is None:
            here = self.f.tell()
            self.end = self.f.seek(0, io.SEEK_END)
            self.f.seek(here)
        self.f.seek(n, io.SEEK_CUR)

    def cut_off(self) -> bool:
        """Whether something was passed over that isn't there."""
        return self.end is not None and self.f.tell() > self.end


class _Zipped(_Plain):
    """Bytes of an archive of gzip members."""

    def __init__(self, f):
        super().__init__(f)
        self.unzip, self.rest, self.buffer, self.at = zlib.decompressobj(31), b"", b"", 0
        self.missing = 0

    def _more(self) -> bool:
        raw = self.rest or self.f.read(BLOCK)
        self.rest = b""
        if not raw:
            return False
        out = self.unzip.decompress(raw, BLOCK)
        if self.unzip.eof:
            self.rest, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
        else:
            self.rest = self.unzip.unconsumed_tail
        self.buffer, self.at = self.buffer[self.at :] + out, 0
        return True

    def line(self) -> bytes:
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.buffer) - 1
                break
        out = self.buffer[self.at : end + 1]
        self.at = end + 1
        return out

    def read(self, n: int) -> bytes:
        parts, need = [], n
        while need:
            part = self.buffer[self.at : self.at + need]
            self.at += len(part)
            need -= len(part)
            parts.append(part)
            if need and not self._more():
                break
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n:
            step = min(n, len(self.buffer) - self.at)
            self.at += step
            n -= step
            if n and not self._more():
                self.missing += n
                break

    def cut_off(self) -> bool:
        return self.missing > 0


def _decoded(header: bytes) -> str:
    """Headers are UTF-8; other archives may have Latin-1."""
    try:
        return header.decode("utf-8")
    except UnicodeDecodeError:
        return header.decode("latin-1")


def _headers(source: _Plain) -> dict[str, str]:
    out: dict[str, str] = {}
    while line := source.line().strip():
        name, _, value = _decoded(line).partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(source: _Plain, wanted=lambda headers: True, payload: bool = True, verify: bool = False) -> Iterator[tuple[dict[str, str], dict[str, str], bytes | None]]:
    """WARC headers, HTTP headers and payload of each wanted record; the payload is None unless asked for."""
    while line := source.line():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head = _headers(source)
        size = int(head["content-length"])
        if not wanted(head):
            source.skip(size + 4)
            if source.cut_off():
                raise ValueError("the last record is cut off")
            continue
        full = head["warc-type"] in ("response", "resource")
        if not payload and not (verify and full):
            http, read = {}, 0
            if head.get("content-type", "").startswith("application/http"):
                first = source.line()
                read = len(first)
                while True:
                    line = source.line()
                    read += len(line)
                    if not line.strip():
                        break
                    name, _, value = _decoded(line).partition(":")
                    http[name.strip().lower()] = value.strip()
            source.skip(size - read + 4)
            if source.cut_off():
                raise ValueError("the last record is cut off")
            yield head, http, None
            continue
        block = source.read(size)
        source.skip(4)
        if len(block) < size or source.cut_off():
            raise ValueError("the last record is cut off")
        http, body = {}, block
        if head.get("content-type", "").startswith("application/http"):
            top, _, body = block.partition(b"\r\n\r\n")
            http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in _decoded(top).split("\r\n")[1:])}
        if verify and full and (stated := head.get("warc-payload-digest")) and stated != digest(body):
            raise ValueError(f"{head.get('warc-record-id')}: the payload does not have the recorded digest")
        yield head, http, body if payload else None


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class _Files(InputPartition):
    files: list[str] = field(default_factory=list)

    def __init__(self, files: list[str]):
        super().__init__(0)
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size = int(options.get("bytesperpartition", 64 << 20))
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.equal: list[tuple[str, tuple]] = []
        self.prefix: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if column in HEADERS and isinstance(f, EqualTo):
                self.equal.append((HEADERS[column], (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.equal.append((HEADERS[column], tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.prefix.append((HEADERS[column], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, inside = _at(self.path)
        found = fs.get_file_info(pafs.FileSelector(inside, recursive=True)) if fs.get_file_info(inside).type == pafs.FileType.Directory else [fs.get_file_info(inside)]
        out, size = [], self.size
        for x in sorted((x for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz"))), key=lambda x: x.path):
            if size + x.size > self.size:
                out.append(_Files([]))
                size = 0
            out[-1].files.append(x.path)
            size += x.size
        return out or [_Files([])]

    def wanted(self, head: dict[str, str]) -> bool:
        return all(head.get(h) in values for h, values in self.equal) and all(head.get(h, "").startswith(p) for h, p in self.prefix)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = _at(self.path)
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])
        for path in partition.files:
            rows: list[tuple] = []
            size = 0
            with fs.open_input_file(path) as f:
                for head, http, body in records(_Zipped(f) if path.endswith(".gz") else _Plain(io.BufferedReader(f, BLOCK)), self.wanted, self.payload, self.verify):
                    length = http.get("content-length") or head.get("x-payload-length")
                    rows.append((*(head.get(h) for h in HEADERS.values()), int(length) if length else len(body or b""), http.get("content-type"), body))
                    size += len(body or b"")
                    if len(rows) >= 5_000 or size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class _Wrote(WriterCommitMessage):
    file: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.zip = options["path"], options.get("compress", "true").lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        out = file = None
        for b in iterator:
            if not b.num_rows:
                continue
            if out is None:
                fs, inside = _at(self.path)
                fs.create_dir(inside)
                file = f"{inside}/part-{uuid.uuid4().hex}.warc{'.gz' * self.zip}"
                out = fs.open_output_stream(f"{file}.tmp", compression=None)
            for row in b.to_pylist():
                raw = record(row)
                if self.zip:
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = z.compress(raw) + z.flush()
                out.write(raw)
        if out is not None:
            out.close()
        return _Wrote(file)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = _at(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.move(f"{m.file}.tmp", m.file)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = _at(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{m.file}.tmp")


def record(row: dict) -> bytes:
    """One record: WARC headers, HTTP headers, and the payload unless it is a revisit."""
    payload = row.get("payload") or b""
    kind = row["record_type"]
    length = row.get("payload_length")
    length = len(payload) if length is None else length
    http = b"HTTP/1.1 200 OK\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n" % ((row.get("content_type") or "text/html; charset=utf-8").encode(), length)
    body = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row.get("record_date")), ("WARC-Target-URI", row.get("target_uri")), ("WARC-Payload-Digest", row.get("payload_digest") or digest(payload)), ("WARC-Refers-To", row.get("refers_to"))]
    if kind == "revisit":
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_revisits(pages: DataFrame, page_id: str, payload: str, uri: str, at_least: int = 0) -> DataFrame:
    """Rows for the writer. Of equal payloads of ``at_least`` bytes or more, the one with the smallest id is a response and the others revisit it.

    Rows with a null id are responses; so are all rows that share the smallest id.
    """
    from .common import BROADCAST_IDS, attach_groups, save

    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    sums = save(pages.select(F.col(page_id).alias("id"), F.unhex(F.sha2(body, 256)).alias("sum"), F.octet_length(body).alias("bytes")), "payload-sums")
    many = sums.where(F.col("bytes") >= at_least)
    groups = save(many.groupBy("sum").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "payload-groups")
    again = save(attach_groups(many, groups, "sum", "n", sums.count()).where("id > first").select("id", "sum", "first").distinct(), "revisits")
    if again.count() <= BROADCAST_IDS:
        again = F.broadcast(again)  # so that payloads stay where they are
    named = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    rows = pages.select(F.col(page_id).alias("id"), F.col(uri).alias("uri"), body.alias("payload"), F.unhex(F.sha2(body, 256)).alias("sum")).join(again, ["id", "sum"], "left")
    seen = F.col("first").isNotNull()
    return rows.select(
        named(F.coalesce(F.col("id").cast("string"), F.lit("none"))).alias("record_id"),
        F.when(seen, "revisit").otherwise("response").alias("record_type"),
        F.col("uri").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("record_date"),
        F.when(seen, named(F.col("first"))).alias("refers_to"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        "payload",
    )


def write(records_of: DataFrame, path: str, compress: bool = True) -> None:
    register(records_of.sparkSession)
    records_of.write.format("warc").option("path", path).option("compress", str(compress).lower()).mode("append").save()


def read(spark: SparkSession, path: str, payload: bool = True, verify: bool = False, bytes_per_partition: int = 64 << 20) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).option("bytesPerPartition", str(bytes_per_partition)).load(path)
