"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading: files are planned into partitions by size. In a task each record's header is parsed first; conditions on header columns that
Spark pushes down are tested there, and what the wanted columns don't need (HTTP header, payload) is never decoded. In ``.warc.gz`` files every
record is a gzip member of its own; members written here carry their length in the ``sl`` extra field, so a skipped record costs one
seek. Members of other writers are inflated to find their end, without keeping anything. Plain ``.warc`` files are skipped by Content-Length.

Writing: every task writes files of its own under a temporary name; the commit gives those of the successful attempts their names.
"""

from __future__ import annotations

import base64
import hashlib
import operator
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
    IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from tickcast.llm import common

#: Columns that a record's header holds, and the header's name for them.
HEADER = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "record_date": "warc-date", "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to", "content_type": "content-type", "content_length": "content-length",
}
#: Columns of the file, the HTTP header and the payload.
SCHEMA = (
    "file string, record_type string, record_id string, target_uri string, record_date string, payload_digest string, refers_to string, content_type string, "
    "content_length long, http_status int, http_length long, payload binary, payload_size long, payload_sha1 string"
)
HTTP, PAYLOAD = {"http_status", "http_length"}, {"payload", "payload_size", "payload_sha1"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
#: Rows and payload bytes of a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def storage(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all machines see."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# reading


class _Stream:
    """Bytes of one record, in order: a gzip member, or a stretch of a plain file."""

    def __init__(self, file, start: int, gzip: bool):
        self.file, self.at, self.start = file, start, start
        self.end = None  # of the member, where it is known
        self.buffer = b""
        self.inflate = None
        if gzip:
            self.inflate = zlib.decompressobj(31)
            self.end = self._declared()

    def _read(self, n: int) -> bytes:
        self.file.seek(self.at)
        data = self.file.read(n)
        self.at += len(data)
        return data

    def _declared(self) -> int | None:
        """End of a gzip member by its ``sl`` field."""
        head = self._read(12)
        self.at = self.start
        if len(head) < 12 or head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at {self.start}")
        if not head[3] & 4:
            return None
        self.at += 12
        extra = self._read(struct.unpack("<H", head[10:12])[0])
        self.at = self.start
        while len(extra) >= 4:
            n = struct.unpack("<H", extra[2:4])[0]
            if extra[:2] == b"sl" and n == 8:
                return self.start + struct.unpack("<I", extra[4:8])[0]
            extra = extra[4 + n :]
        return None

    def more(self) -> bytes:
        """The next decoded bytes; none at the end."""
        if self.inflate is None:
            return self._read(CHUNK)
        while not self.inflate.eof:
            data = self._read(CHUNK if self.end is None else min(CHUNK, self.end - self.at))
            if not data:
                raise ValueError(f"the gzip member at {self.start} is cut off")
            out = self.inflate.decompress(data)
            if out:
                return out
        return b""

    def head(self) -> list[bytes]:
        """Lines up to and without the empty one; what follows stays in the buffer."""
        while (k := self.buffer.find(b"\r\n\r\n")) < 0:
            data = self.more()
            if not data:
                raise ValueError(f"the record at {self.start} has no end of its header")
            self.buffer += data
        lines, self.buffer = self.buffer[:k].split(b"\r\n"), self.buffer[k + 4 :]
        return lines

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in chunks."""
        while n:
            data = self.buffer or self.more()
            if not data:
                raise ValueError(f"the record at {self.start} is cut off")
            self.buffer = data[n:]
            yield data[:n]
            n -= min(n, len(data))

    def next_start(self, left: int) -> int:
        """Where the next record starts; ``left`` bytes of the block were not taken."""
        if self.inflate is None:
            return self.at - len(self.buffer) + left + 4
        if self.end is not None:
            return self.end
        while self.more():
            pass
        return self.at - len(self.inflate.unused_data)


def fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a folded line continues the one before."""
    out, last = {}, None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            last, value = text.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def header_columns(found: dict[str, str]) -> dict:
    """Header columns of a record: identifiers without their brackets, digests without the name of the method."""
    out = {c: found.get(name) for c, name in HEADER.items()}
    for c in ("record_id", "refers_to", "target_uri"):
        if out[c] and out[c].startswith("<") and out[c].endswith(">"):
            out[c] = out[c][1:-1]
    if out["payload_digest"]:
        out["payload_digest"] = out["payload_digest"].rpartition(":")[2]
    out["content_length"] = int(out["content_length"] or 0)
    return out


def records(file, size: int, gzip: bool, wanted: set[str], keep: Callable[[dict], bool]) -> Iterator[dict]:
    """Records of an open file that pass ``keep``, a test of header columns; only the parts that ``wanted`` names are decoded."""
    at = 0
    while at < size:
        stream = _Stream(file, at, gzip)
        lines = stream.head()
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}")
        row = header_columns(fields(lines[1:]))
        left = row["content_length"]
        if keep(row):
            if wanted & (HTTP | PAYLOAD):
                left = _payload(stream, row, left, wanted)
            yield row
        at = stream.next_start(left)


def _payload(stream: _Stream, row: dict, left: int, wanted: set[str]) -> int:
    """Add HTTP and payload columns; returns the bytes of the block that were not read."""
    row |= dict.fromkeys((*HTTP, *PAYLOAD))
    if "application/http" in (row["content_type"] or ""):
        lines = stream.head()
        http = fields(lines[1:])
        status = lines[0].split(b" ")
        row["http_status"] = int(status[1]) if len(status) > 1 and status[1].isdigit() else None
        row["http_length"] = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        left -= sum(map(len, lines)) + 2 * len(lines) + 2
    if row["record_type"] != "revisit" and wanted & PAYLOAD:
        digest, n, parts = hashlib.sha1(), 0, []
        for data in stream.take(left):
            digest.update(data)
            n += len(data)
            if "payload" in wanted:
                parts.append(data)
        row |= {"payload": b"".join(parts) if "payload" in wanted else None, "payload_size": n, "payload_sha1": base64.b32encode(digest.digest()).decode()}
        left = 0
    return left


#: Tests of a header value against a filter's, for conditions that hold for values alone.
COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le,
           StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: operator.contains}


def header_test(f: Filter) -> Callable[[dict], bool | None] | None:
    """The test of a pushed filter on header columns (None is SQL's unknown), or None where the header can't decide it."""
    if isinstance(f, Not):
        inner = header_test(f.child)
        return inner and (lambda row: None if (x := inner(row)) is None else not x)
    if len(f.attribute) != 1 or f.attribute[0] not in HEADER:
        return None
    column = f.attribute[0]
    if isinstance(f, IsNull):
        return lambda row: row[column] is None
    if isinstance(f, IsNotNull):
        return lambda row: row[column] is not None
    if isinstance(f, EqualNullSafe):
        return lambda row: row[column] == f.value
    if isinstance(f, In):
        some, null = {v for v in f.value if v is not None}, None in f.value
        return lambda row: None if row[column] is None else True if row[column] in some else None if null else False
    compare = COMPARE.get(type(f))
    if compare is None or f.value is None:
        return None
    return lambda row: None if row[column] is None else compare(row[column], f.value)


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        if "path" not in options:
            raise ValueError("warc needs a path")
        self.path, self.names, self.arrow = options["path"], schema.names, to_arrow_schema(schema)
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.tests: list[Callable] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            test = header_test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[Files]:
        """Files in the order of their names, neighbours together up to the partition size."""
        fs, path = storage(self.path)
        here = fs.get_file_info(path)
        if here.type == pafs.FileType.NotFound:
            raise ValueError(f"{self.path} does not exist")
        found = [here] if here.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        sizes = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz")) and "/_temporary/" not in f.path)
        out, used = [], self.partition_bytes
        for name, size in sizes:
            if used + size > self.partition_bytes and (used or not out):
                out.append(Files([]))
                used = 0
            out[-1].files.append((name, size))
            used += size
        return out

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        fs, _ = storage(self.path)
        wanted = set(self.names)
        keep = lambda row: all(test(row) for test in self.tests)
        rows, held = [], 0
        for name, size in partition.files:
            with fs.open_input_file(name) as file:
                for row in records(file, size, name.endswith(".gz"), wanted, keep):
                    row["file"] = name
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in self.arrow], schema=self.arrow)


# writing


def _clean(value: str) -> str:
    """A header value on one line: blanks and control signs as percent codes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes | None, length: int, digest: str, refers_to: str | None) -> bytes:
    """One record: a response with its payload, or a revisit of an earlier one with the HTTP header alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block += payload or b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {_clean(uri)}"] if uri else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response"]
    lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{refers_to}>"] if kind == "revisit" else []
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member whose ``sl`` field says its own and its content's length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    known = total < 1 << 32 and len(data) < 1 << 32
    extra = struct.pack("<H2sHII", 12, b"sl", 8, total, len(data)) if known else b""
    head = b"\x1f\x8b\x08" + (b"\x04" if known else b"\x00") + b"\x00" * 4 + b"\x00\xff"
    return head + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_type, record_id, target_uri, record_date, payload (binary), and for revisits payload_size, payload_digest and refers_to."""

    NEEDED = ("record_type", "record_id", "target_uri", "record_date", "payload", "payload_size", "payload_digest", "refers_to")

    def __init__(self, options: dict, schema, overwrite: bool):
        missing = [c for c in self.NEEDED if c not in schema.names]
        if missing:
            raise ValueError(f"records lack {', '.join(missing)}")
        self.path, self.overwrite = options["path"], overwrite
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.level, self.most = int(options.get("level", 6)), int(options.get("file_bytes", 256 << 20))
        self.job = uuid.uuid4().hex

    def _place(self, name: str, temporary: bool) -> str:
        _, root = storage(self.path)
        return f"{root}/_temporary/{self.job}/{name}" if temporary else f"{root}/{name}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, _ = storage(self.path)
        task = TaskContext.get()
        names, out = [], None
        fs.create_dir(self._place("", True).rstrip("/"), recursive=True)
        try:
            for batch in batches:
                for row in zip(*(batch.column(batch.schema.get_field_index(c)) for c in self.NEEDED)):
                    if out is None:
                        names.append(f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{self.job[:8]}-{len(names):04d}.warc" + ".gz" * self.gzip)
                        out = fs.open_output_stream(self._place(names[-1], True), compression=None)
                    out.write(self._record(*(v.as_py() for v in row)))
                    if out.tell() >= self.most:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def _record(self, kind, record_id, uri, date, payload, size, digest, refers_to) -> bytes:
        if kind != "revisit":
            payload = payload or b""
            size, digest = len(payload), base32_sha1(payload)
        data = record(kind, record_id or f"urn:uuid:{uuid.uuid4()}", uri, date, payload, size, digest, refers_to)
        return member(data, self.level) if self.gzip else data

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = storage(self.path)
        if self.overwrite:
            old = [f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and "/_temporary/" not in f.path]
            for f in old:
                fs.delete_file(f)
        for m in messages:
            for name in m.files if m else []:
                fs.move(self._place(name, True), self._place(name, False))
        self._clear(fs)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(storage(self.path)[0])

    def _clear(self, fs: pafs.FileSystem) -> None:
        """Remove this job's temporary folder, and the one above once no other job uses it."""
        own = self._place("", True).rstrip("/")
        if fs.get_file_info(own).type == pafs.FileType.Directory:
            fs.delete_dir(own)
            above = own.rpartition("/")[0]
            if not fs.get_file_info(pafs.FileSelector(above)):
                fs.delete_dir(above)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema, overwrite)


# tables


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let it take filters."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Records below ``path`` with the columns of ``schema``, any of ``SCHEMA``'s; parts of records that no column needs are not decoded.

    ``http_length`` is the length that the HTTP header states, also of revisits. ``payload_size`` and ``payload_sha1`` are measured on the payload,
    which is not kept unless ``payload`` is asked for. Revisits have no payload.
    """
    register(spark)
    size = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return spark.read.format("warc").schema(schema).option("partition_bytes", size).load(path)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, target_uri, payload (null for revisits), payload_size, payload_digest, record_type, refers_to of every page.

    Of pages with equal payloads of ``least_bytes`` or more, that with the largest id is the response and others revisit it. Equal means equal in
    length, SHA-1 and SHA-256. Groups are counted by digests, summed before the shuffle; only digests that repeat are joined back, in a
    join that Spark splits where one digest has very many pages.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("target_uri"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("payload"))
    key = ["payload_size", "sha1", "sha256"]
    p = p.withColumns({"payload_size": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256)})
    again = p.filter(F.col("payload_size") >= least_bytes).groupBy(*key).agg(F.count("*").alias("_n"), F.max("page_id").alias("_first"))
    out = p.join(again.filter("_n > 1").drop("_n"), key, "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.select(
        "page_id", "target_uri", F.when(~revisit, F.col("payload")).alias("payload"), "payload_size", _base32(F.col("sha1")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def _base32(hex_digest):
    """Base 32 of a hex SHA-1: 20 bits, five hex digits, are four signs."""
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    number = lambda i: F.conv(F.substr(hex_digest, F.lit(5 * (i // 4) + 1), F.lit(5)), 16, 10).cast("int")
    return F.concat(*(F.substr(F.lit(signs), F.shiftright(number(i), 15 - 5 * (i % 4)).bitwiseAND(31) + 1, F.lit(1)) for i in range(32)))


def write_pages(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", **columns) -> None:
    """A record for every page, as ``with_revisits`` decides; record ids are ``urn:page:`` and the page's id, of pages without an id random ones.

    A null text is an empty payload, a null address leaves its header out. Of repeated rows with the largest id of their group each is a response.
    Pages without an id revisit the group's largest id where there is one. Other columns do not matter; an empty table leaves a folder without records.
    """
    common.bounded_batches(pages.sparkSession)
    register(pages.sparkSession)
    urn = lambda c: F.when(c.isNotNull(), F.concat(F.lit("urn:page:"), c.cast("string")))
    rows = with_revisits(pages, **columns).select(
        "record_type", urn(F.col("page_id")).alias("record_id"), "target_uri", F.lit(date).alias("record_date"), "payload", "payload_size", "payload_digest", urn(F.col("refers_to")).alias("refers_to")
    )
    rows.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archived pages.

    Payloads of responses are decoded and measured; revisits are told by their header and HTTP header, and no response is inflated for them.
    """
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    full = read_warc(spark, path, "record_type string, record_id string, payload_size long, payload_sha1 string").filter("record_type = 'response'")
    again = read_warc(spark, path, "record_type string, record_id string, refers_to string, payload_digest string, http_length long").filter("record_type = 'revisit'")
    one = full.select(page(F.col("record_id")).alias("page_id"), F.col("payload_size").alias("payload_bytes"), F.col("payload_sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    two = again.select(page(F.col("record_id")).alias("page_id"), F.col("http_length").alias("payload_bytes"), "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))
    return one.unionByName(two)


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all pages as archives below ``path`` (a new shared folder by default) and read them back."""
    spark = pages.sparkSession
    path = path or f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(pages, path)
    return read_pages(spark, path)
