"""Operator 2: WARC files as a Spark data source, written and read.

spark.dataSource.register(WarcDataSource); spark.read.format("warc").load(path). Options: payload (true; false skips all payloads),
verify (false; true compares each payload with its digest).

Write: each task makes gzip files of a record a member, up to ROLL_BYTES each; a member's extra field holds its compressed length.
The manifest, written at commit, lists the committed files and places between records; files of tasks that were lost are not in it.

Read: partitions are runs of about SPLIT_BYTES between such places (a file without manifest is one). Equality and IN filters on
record_type, target_uri, record_id, refers_to, payload_digest and content_type are pushed down. For each record its headers are parsed
first; a record that a filter rejects is skipped by its member's length without decoding it, in foreign files by reading over it.
Foreign files may be plain, or gzip with any number of records a member.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from quern.llm.common import open_fs, pick, shared_dir, stored

ROLL_BYTES = 128 << 20
SPLIT_BYTES = 16 << 20
MANIFEST = "_MANIFEST.json"
SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, content_type string, payload_bytes long, payload binary"
#: Columns that come from one header each (fixed values of the WARC format, and one of our own for the full payload's length).
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type", "payload_bytes": "X-Payload-Length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member; the extra field "SL" holds the member's whole length as 8 bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\x00\xff"
    size = len(head) + 2 + 12 + len(body) + 8
    return head + struct.pack("<H", 12) + b"SL" + struct.pack("<HQ", 8, size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member_length(head: bytes) -> int | None:
    """The length that member() noted, from a member's first 24 bytes."""
    if len(head) >= 24 and head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"SL":
        return struct.unpack("<Q", head[16:24])[0]
    return None


def record(row: dict) -> bytes:
    """The bytes of a record: a response holds an HTTP message with the payload, a revisit the HTTP header only."""
    payload = bytes(row["payload"] or b"")
    kind = row["record_type"] or "resource"
    clean = lambda v: "".join(ch if ch >= " " and ch != "\x7f" else "%%%02X" % ord(ch) for ch in v)  # noqa: E731, UP031
    digest, length = row.get("payload_digest") or sha1_base32(payload), row.get("payload_bytes")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{clean(row['record_id'] or uuid.uuid4().urn)}>", f"WARC-Date: {row.get('date') or '1970-01-01T00:00:00Z'}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload) if length is None else length}"]
    if row.get("target_uri"):
        head.append(f"WARC-Target-URI: {clean(row['target_uri'])}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{clean(row['refers_to'] or '')}>", f"WARC-Profile: {REVISIT_PROFILE}"]
        payload = b""
    content = payload
    if kind in ("response", "revisit"):
        head.append("Content-Type: application/http; msgtype=response")
        content = b"HTTP/1.1 200 OK\r\nContent-Type: " + (row.get("content_type") or "text/html; charset=utf-8").encode() + b"\r\n\r\n" + payload
    else:
        head.append(f"Content-Type: {row.get('content_type') or 'application/octet-stream'}")
    head.append(f"Content-Length: {len(content)}")
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + content + b"\r\n\r\n"


@dataclass
class Part(InputPartition):
    file: str
    start: int
    end: int  # -1: to the file's end


@dataclass
class Wrote(WriterCommitMessage):
    files: list


class _Stream:
    """Bytes of a file from a place on, decoded as they are asked for: plain, one gzip member, or (whole) all members from there on."""

    def __init__(self, f, at: int, packed: bool, whole: bool):
        self.f, self.whole = f, whole
        f.seek(at)
        self.coder = zlib.decompressobj(31) if packed else None
        self.data, self.over = b"", False

    def more(self) -> bool:
        """Whether there was more to read."""
        if self.over:
            return False
        raw = b""
        if self.coder is not None and self.coder.eof:  # the next member
            raw = self.coder.unused_data
            self.coder = zlib.decompressobj(31)
        raw = raw or self.f.read(1 << 16)
        if not raw:
            self.over = True
            return False
        self.data += raw if self.coder is None else self.coder.decompress(raw)
        if self.coder is not None and self.coder.eof and not self.whole:
            self.over = True
        return True

    def lead(self) -> bool:
        """Drop empty lines; whether anything follows."""
        while True:
            self.data = self.data.lstrip(b"\r\n")
            if self.data or not self.more():
                return bool(self.data)

    def upto(self, mark: bytes) -> bytes | None:
        """What stands before the mark, taken together with it."""
        seen = 0
        while (i := self.data.find(mark, seen)) < 0:
            seen = max(0, len(self.data) - len(mark) + 1)
            if not self.more():
                return None
        out, self.data = self.data[:i], self.data[i + len(mark) :]
        return out

    def take(self, n: int, keep: bool = True) -> bytes:
        """The next n bytes; without keep they are only passed."""
        parts, left = [], n
        while True:
            some, self.data = self.data[:left], self.data[left:]
            left -= len(some)
            if keep:
                parts.append(some)
            if not left:
                return b"".join(parts)
            if not self.more():
                raise ValueError("a record ends early")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in HEADERS and column != "payload_bytes":
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[Part]:
        fs, inner = open_fs(self.path)
        prefix = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        info = fs.get_file_info(inner)
        if info.type == pafs.FileType.File:
            return [Part(self.path, 0, -1)]
        manifest = f"{inner.rstrip('/')}/{MANIFEST}"
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                files = json.loads(f.read())["files"]
            return [Part(f"{self.path.rstrip('/')}/{x['name']}", a, b) for x in files for a, b in zip(x["places"], [*x["places"][1:], x["size"]], strict=True)] or [Part("", 0, 0)]
        found = fs.get_file_info(pafs.FileSelector(inner, recursive=True, allow_not_found=True))
        return [Part(prefix + x.path, 0, -1) for x in found if x.path.endswith((".warc", ".warc.gz"))] or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        names = [*HEADERS, "payload"]
        kinds = [pa.string()] * 7 + [pa.int64(), pa.binary()]
        rows, held = [], 0
        for row in self.rows(partition) if partition.file else ():
            rows.append(row)
            held += len(row[-1] or b"") + 500
            if held > 4 << 20 or len(rows) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def rows(self, part: Part) -> Iterator[tuple]:
        fs, inner = open_fs(part.file)
        with fs.open_input_file(inner) as f:
            at, end = part.start, part.end if part.end >= 0 else f.size()
            while at < end:
                f.seek(at)
                head = f.read(24)
                length = member_length(head)
                stream = _Stream(f, at, head[:2] == b"\x1f\x8b", whole=length is None)
                yield from self._records(stream, part.file, 1 if length else None)
                at = at + length if length else end  # a stream without lengths goes to the file's end

    def _records(self, stream: _Stream, file: str, most: int | None) -> Iterator[tuple]:
        while most != 0 and stream.lead():
            lines = stream.upto(b"\r\n\r\n")
            if lines is None:
                raise ValueError(f"{file}: a record's headers don't end")
            headers = self._headers(lines)
            size = int(headers.get("content-length", "0"))
            if self._fits(headers):
                content = stream.take(size) if self.payload or self.verify else None
                yield self._row(headers, content)
                if content is None and most != 1:
                    stream.take(size, keep=False)
            elif most != 1:
                stream.take(size, keep=False)
            most = None if most is None else most - 1

    @staticmethod
    def _headers(data: bytes) -> dict[str, str]:
        lines = data.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        out: dict[str, str] = {}
        last = ""
        for line in lines[1:]:
            if line[:1] in " \t" and last:
                out[last] += " " + line.strip()
            else:
                last, _, value = line.partition(":")
                last = last.strip().lower()
                out[last] = value.strip()
        return out

    @staticmethod
    def _value(column: str, headers: dict[str, str]) -> str | None:
        v = headers.get(HEADERS[column].lower())
        if v is not None and column in ("record_id", "refers_to"):
            v = v.removeprefix("<").removesuffix(">")
        return v.rpartition(":")[2] if v is not None and column == "payload_digest" else v

    def _fits(self, headers: dict[str, str]) -> bool:
        return all(self._value(c, headers) in values for c, values in self.wanted.items())

    def _row(self, headers: dict[str, str], content: bytes | None) -> tuple:
        v = {c: self._value(c, headers) for c in HEADERS}
        payload = content
        if content is not None and (v["content_type"] or "").startswith("application/http"):
            payload = content[content.find(b"\r\n\r\n") + 4 :]
        if v["record_type"] == "revisit":
            payload = None
        size = v["payload_bytes"]
        n = int(size) if size is not None else len(payload) if payload is not None else None
        if self.verify and payload is not None and v["payload_digest"] and (sha1_base32(payload) != v["payload_digest"] or n != len(payload)):
            raise ValueError(f"{v['record_id']}: the payload doesn't match its digest or length")
        return (*[v[c] for c in HEADERS if c != "payload_bytes"], n, payload if self.payload else None)


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.columns, self.level = options["path"], columns, int(options.get("level", "6"))

    def write(self, rows: Iterator) -> Wrote:
        files, f, size, places, mark = [], None, 0, [], 0
        for row in rows:
            if f is None or size >= ROLL_BYTES:
                if f is not None:
                    f.close()
                    files.append({"name": name, "size": size, "places": places})
                name, size, places, mark = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0], 0
                fs, inner = open_fs(f"{self.path.rstrip('/')}/{name}")
                fs.create_dir(inner.rpartition("/")[0], recursive=True)
                f = fs.open_output_stream(inner, compression=None)
            if size - mark >= SPLIT_BYTES:
                places.append(size)
                mark = size
            data = member(record(dict(zip(self.columns, row, strict=True))), self.level)
            f.write(data)
            size += len(data)
        if f is not None:
            f.close()
            files.append({"name": name, "size": size, "places": places})
        return Wrote(files)

    def commit(self, messages: list) -> None:
        fs, inner = open_fs(self.path)
        fs.create_dir(inner, recursive=True)
        with fs.open_output_stream(f"{inner.rstrip('/')}/{MANIFEST}") as f:
            f.write(json.dumps({"files": [x for m in messages if m for x in m.files]}).encode())

    def abort(self, messages: list) -> None:
        fs, inner = open_fs(self.path)
        for m in messages:
            for x in m.files if m else []:
                fs.delete_file(f"{inner.rstrip('/')}/{x['name']}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(pages: DataFrame, path: str, *, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each row of pages; of rows with equal payloads of at least min_bytes, the largest id is a response.

    Others with that payload revisit it. A null html is an empty payload, a null url no target URI; a row with a null id is always a
    response; rows that repeat the largest id are responses each. Other columns are ignored; an empty table writes an empty archive.
    """
    spark = pages.sparkSession
    register(spark)
    flat = pick(pages, page_id=(id_col, "long"), url=(url_col, "string"), html=(html_col, "string")).withColumn("payload", F.coalesce("html", F.lit("")).cast("binary"))
    flat = flat.drop("html").withColumn("digest", F.sha1("payload"))
    groups = flat.filter((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = stored(groups.filter("n > 1").select("digest", "first"), "repeated")
    joined = flat.join(repeated, "digest", "left") if repeated.take(1) else flat.withColumn("first", F.lit(None).cast("long"))
    revisit = F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    rows = joined.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(F.coalesce(revisit, F.lit(False)), "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(F.coalesce(revisit, F.lit(False)), urn(F.col("first"))).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload",
    )
    rows.write.format("warc").mode("append").save(path)


def archive_and_read(pages: DataFrame, **options) -> DataFrame:
    """SCHEMA's rows of a new archive in the shared folder, with payloads checked against their digests."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    archive(pages, path, **options)
    return spark.read.format("warc").option("verify", "true").load(path)
