"""WARC archives: a distributed writer with revisit records, and a Python data source.

The writer gives every task a gzip archive with one member per record, whose extra
field ``sl`` holds the member's length. Archives of failed or repeated attempts are
deleted when the write commits, so a lost executor leaves no double records. Record ids
are unique: they are made of the write and the row's number.

The reader plans partitions of whole files, takes pushed predicates on header fields
(equality, lists, nulls, ranges, prefixes), inflates only the headers of a record first,
and jumps over the rest when a predicate rejects it; a payload is inflated only where it
is wanted (option ``payload``: ``full`` returns it, ``verify`` compares it with its
digest, ``skip`` leaves it packed). It reads any archive: gzip by record or as a whole,
or not packed, all record types, header names in any case. Of an HTTP record the payload
is what follows the HTTP headers, of others the block; of a revisit there is none, and
its length is what the HTTP headers say. ``page_id`` and ``refers_to`` are headers of
the writer's own (``X-Page-Id``), null in other archives.

Page ids are integers; a column of another type raises ``ValueError``. Null payloads
count as empty, null urls have no target header, null page ids have no id header and
come last when the first of equal payloads is chosen. Repeated rows are records of their
own: one is the response, the others revisit it. An empty table gives no records; only
the three named columns are read, so that further ones can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import operator
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import IntegralType

from .common import Workspace, numbered, sized

#: An archive is closed beyond so many bytes, and a partition reads files of so many.
ROLL, PLAN = 128 << 20, 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
SCHEMA = "page_id long, record_type string, target_uri string, date string, payload_digest string, payload_length long, refers_to long, payload binary"


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri) if "://" in uri else FileSystem.from_uri(re.sub(r"^file:/+|^/*", "file:///", uri))


def member(record: bytes) -> bytes:
    """A gzip member that says its own length, so that readers can jump over it."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush() + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQ", 12, b"sl", 8, 24 + len(body)) + body


def record(name: str, page_id, url, payload: bytes, digest: str, response: tuple | None, date: str) -> bytes:
    """A record; ``response`` is (record name, page id) of what a revisit refers to."""
    block = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload) + (b"" if response else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if response else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if response:
        head += [f"WARC-Refers-To: <{response[0]}>", f"WARC-Profile: {PROFILE}"]
    for field, value in (("X-Page-Id", page_id), ("X-Refers-To-Page-Id", response[1] if response else None)):
        if value is not None:
            head.append(f"{field}: {value}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of (page_id, url, html) below ``path``; returns the manifest.

    Of payloads that are equal and have ``least`` bytes or more, the one with the smallest
    page_id is a response and the others revisit it.
    """
    spark, ws, made = pages.sparkSession, Workspace(pages.sparkSession, "warc-copies"), uuid.uuid4()
    if not isinstance(pages.schema["page_id"].dataType, IntegralType):
        raise ValueError("page_id has to be an integer column")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = numbered(pages.select("page_id", "url", "html"), ws).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), "rid").withColumn("sha", F.unhex(F.sha1("payload")))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rid"))
    copied = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1").select("sha", F.col("first.page_id").alias("first_id"), F.col("first.rid").alias("first_rid"))
    copied = sized(ws.save(copied, "copied"))  # a row for each payload that occurs more than once
    joined = rows.join(copied, "sha", "left").select("rid", "page_id", "url", "payload", "sha", F.when(F.col("rid") != F.col("first_rid"), F.col("first_rid")).alias("first_rid"), "first_id")
    _fs(path)[0].create_dir(_fs(path)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(path)
        done, out, size, n, name = [], None, 0, 0, ""
        for batch in batches:
            for rid, page_id, url, data, sha, first_rid, first_id in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    # the name is never used by another attempt
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, n = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                response = None if first_rid is None else (uuid.uuid5(made, str(first_rid)).urn, first_id)
                packed = member(record(uuid.uuid5(made, str(rid)).urn, page_id, url, data, base64.b32encode(sha).decode(), response, date))
                out.write(packed)
                size, n = size + len(packed), n + 1
                if size > ROLL:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pa.RecordBatch.from_pydict({"file": [x[0] for x in done], "records": [x[1] for x in done], "bytes": [x[2] for x in done]}, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    joined.mapInArrow(run, "file string, records long, bytes long").write.parquet(f"{path}/_manifest")
    manifest = spark.read.parquet(f"{path}/_manifest")
    fs, base = _fs(path)
    keep = {r.file for r in manifest.select("file").toLocalIterator()}  # a row for each archive of up to ROLL bytes
    for name in _files(fs, base):
        if name not in keep:
            fs.delete_file(f"{base}/{name}")
    return manifest


def _files(fs, base: str) -> dict[str, int]:
    from pyarrow.fs import FileSelector

    return {x.base_name: x.size for x in fs.get_file_info(FileSelector(base)) if x.base_name.endswith((".warc.gz", ".warc"))}


class Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


class WarcReader(DataSourceReader):
    #: Columns that record headers alone decide.
    HEADERS = {"page_id", "record_type", "target_uri", "date", "payload_digest", "refers_to"}
    TESTS = {
        EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le,
        In: lambda x, values: x in values, StringStartsWith: str.startswith,
    }

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.mode = options.get("payload", "full")
        if self.mode not in ("full", "verify", "skip"):
            raise ValueError("payload has to be full, verify or skip")
        self.wanted: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            at = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if at in self.HEADERS and type(f) in (IsNull, IsNotNull, *self.TESTS):
                self.wanted.append((at, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        fs, base = _fs(self.path)
        out, size = [[]], 0
        for name, n in sorted(_files(fs, base).items()):
            if out[-1] and size + n > PLAN:
                out.append([])
                size = 0
            out[-1].append(name)
            size += n
        return [Files(x) for x in out]

    def accepts(self, head: dict) -> bool:
        for at, kind, value in self.wanted:
            x = head[at]
            if kind in (IsNull, IsNotNull):
                ok = (x is None) == (kind is IsNull)
            else:
                ok = x is not None and value is not None and self.TESTS[kind](x, value)
            if not ok:
                return False
        return True

    def read(self, partition):
        fs, base = _fs(self.path)
        names = [x.strip().split()[0] for x in SCHEMA.split(",")]
        types = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0
        for name in partition.names:
            with fs.open_input_file(f"{base}/{name}") as f:
                for head, payload in records(f, self.accepts, self.mode):
                    rows.append({**head, "payload": payload})
                    size += len(payload or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=types).select(names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=types).select(names)


class Archive:
    """The bytes of an open archive, inflated only as far as they are asked for."""

    def __init__(self, f):
        self.f, self.raw, self.data, self.z = f, b"", bytearray(), None
        #: where the gzip member ends that the present record fills, if it says so
        self.after: int | None = None
        self.plain = f.read(2) != b"\x1f\x8b"
        f.seek(0)

    def more(self, most: int) -> bool:
        """Add to ``data``; false at the end of the archive."""
        if self.plain:
            got = self.f.read(most)
            self.data += got
            return bool(got)
        if self.z is None:
            begin = self.f.tell() - len(self.raw)
            self.raw += self.f.read(8192)
            if not self.raw.strip(b"\0"):
                return False
            sl = self.raw[3:4] == b"\x04" and self.raw[12:14] == b"sl" and not self.data
            self.after = begin + struct.unpack("<Q", self.raw[16:24])[0] if sl else None
            self.z = zlib.decompressobj(31)
        if not self.raw:
            self.raw = self.f.read(1 << 16)
            if not self.raw:
                raise ValueError("an archive is cut short")
        self.data += self.z.decompress(self.raw, most)
        self.raw = self.z.unconsumed_tail
        if self.z.eof:
            self.raw, self.z = self.z.unused_data, None
        return True

    def line_end(self, begin: int) -> int:
        """Where the empty line is that ends the headers from ``begin`` on; -1 without one."""
        while (at := self.data.find(b"\r\n\r\n", begin)) < 0:
            begin = max(begin, len(self.data) - 3)
            if not self.more(4096):
                return -1
        return at

    def headers(self) -> bytes | None:
        """The next record's headers; None at the end."""
        while not (rest := self.data.lstrip(b"\r\n")):
            self.data.clear()
            if not self.more(4096):
                return None
        self.data = rest
        at = self.line_end(0)
        if at < 0:
            raise ValueError("an archive is cut short")
        head = bytes(self.data[:at])
        del self.data[: at + 4]
        return head

    def has(self, n: int) -> None:
        while len(self.data) < n:
            if not self.more(1 << 20):
                raise ValueError("an archive is cut short")

    def skip(self, n: int) -> None:
        """Go on behind the ``n`` bytes that follow."""
        if self.after is not None:
            self.f.seek(self.after)
            self.raw, self.z, self.after = b"", None, None
            self.data.clear()
            return
        while n > len(self.data):
            n -= len(self.data)
            self.data.clear()
            if self.plain:
                self.f.seek(self.f.tell() + n)
                return
            self.has(1)
        del self.data[:n]


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on the one before."""
    text = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace"))
    return {k.strip().lower(): v.strip() for k, c, v in (x.partition(":") for x in text.split("\r\n")[1:]) if c}


def records(f, accepts, mode: str) -> Iterator[tuple[dict, bytes | None]]:
    """(header fields, payload) of the accepted records of an open archive."""
    archive = Archive(f)
    while (raw := archive.headers()) is not None:
        named = fields(raw)
        size, head = int(named["content-length"]), _parsed(named)
        if not accepts(head):
            archive.skip(size)
            continue
        begin, http = 0, {}
        if named.get("content-type", "").lower().startswith("application/http"):
            at = archive.line_end(0)
            if 0 <= at <= size - 4:
                begin, http = at + 4, fields(bytes(archive.data[:at]))
        payload, head["payload_length"] = None, size - begin
        if head["record_type"] == "revisit":
            said = http.get("content-length", "")
            head["payload_length"] = int(said) if said.isdigit() else None
        elif mode != "skip":
            archive.has(size)
            payload = bytes(archive.data[begin:size])
            if mode == "verify":
                verify(payload, named)
                payload = None
        archive.skip(size)
        yield head, payload


def verify(payload: bytes, named: dict[str, str]) -> None:
    """ValueError if the payload differs from its digest, in base 32 or hexadecimal digits of a known algorithm."""
    kind, _, digest = named.get("warc-payload-digest", "").partition(":")
    if kind.lower() not in ("sha1", "sha256", "sha512", "md5"):
        return
    own = hashlib.new(kind.lower(), payload)
    if digest.upper().rstrip("=") not in (base64.b32encode(own.digest()).decode().rstrip("="), own.hexdigest().upper()):
        raise ValueError(f"the payload of record {named.get('warc-record-id')} differs from its digest")


def _parsed(named: dict[str, str]) -> dict:
    def number(field: str):
        return int(named[field]) if re.fullmatch(r"-?\d+", named.get(field, "")) else None

    return {
        "page_id": number("x-page-id"), "record_type": named.get("warc-type"), "target_uri": named.get("warc-target-uri"), "date": named.get("warc-date"),
        "payload_digest": named.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": number("x-refers-to-page-id"),
    }


class WarcDataSource(DataSource):
    """``spark.read.format("gridloom_warc").load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "gridloom_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: str = "full", pushdown: bool = True) -> DataFrame:
    """The records of the archives below ``path``.

    Spark passes predicates to a Python source only where ``spark.sql.python.filterPushdown.enabled``
    is true; ``pushdown`` sets that for the session, without it the session is left as it is.
    """
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("gridloom_warc").option("payload", payload).load(path)
