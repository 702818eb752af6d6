"""WARC archives as a Python data source, and the records of a crawl.

``spark.read.format("warc").load(folder)`` plans one partition per archive file. A record's
headers are parsed first; pushed predicates on them (record_type, record_id, target_uri,
refers_to, payload_digest) decide whether its payload is read at all. A payload that is not
wanted is not decoded: a plain file is read on behind it, and in a compressed file the
member's own length, written in its gzip header, leads to the next member. Members of foreign
archives without that field, or of several records, are inflated and dropped. Option ``payload=false`` skips all
payloads.

Writing: each task writes files of its own, up to ``file_bytes`` each, named at random; the
commit adds a manifest of the files of the tasks that succeeded, so files of failed or
repeated attempts are never read. Folders without a manifest are read whole. Paths go through
pyarrow's file systems: local, HDFS and the usual object stores.

Line breaks between records are passed over. A file that ends inside a record, a gzip member that is
damaged or broken off, and bytes that are no record end the query with the file and the byte.

Defined cases: NULL payload is written as empty; NULL target_uri leaves the header out; line
breaks in header values are percent-encoded; an empty table makes an empty archive; repeated
rows make repeated records; extra columns are not written.
"""

from __future__ import annotations

import base64
import json
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull,
    StringStartsWith, WriterCommitMessage,
)
from pyspark.sql import types as T

from .common import land

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
    "payload_length bigint, payload binary, file string, offset bigint"
)
FILTERED = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")
FILE_BYTES = 256 << 20
BATCH_BYTES = 8 << 20
WINDOW = 1 << 20
END = b"\r\n\r\n"
# Fixed: the profile of records that repeat a payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Payloads below this size are stored again rather than referred to.
REVISIT_BYTES = 1000


def _open(path: str):
    """(file system, path in it) of a Spark path."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _safe(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in "\r\n\0" else c for c in value)


def _record(row: dict, date: str) -> tuple[bytes, bytes]:
    """Header and block of one record."""
    payload = row.get("payload") or b""
    revisit = row["record_type"] == "revisit"
    length = row.get("payload_length") if revisit and row.get("payload_length") is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}".encode() + END
    block = http if revisit else http + payload
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date)]
    if row.get("target_uri") is not None:
        fields.append(("WARC-Target-URI", row["target_uri"]))
    if row.get("payload_digest") is not None:
        fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()))
    if revisit:
        fields += [("WARC-Refers-To", f"<{row['refers_to']}>"), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "\r\n".join(["WARC/1.1", *(f"{k}: {_safe(v)}" for k, v in fields)]).encode() + END, block


def _member(data: bytes) -> bytes:
    """A gzip member that carries its own compressed and plain length in its header ('sl' field)."""
    pack = zlib.compressobj(3, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = pack.compress(data) + pack.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = struct.pack("<2sHII", b"sl", 8, size, len(data))
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Window:
    """Bytes of a file by offset, read in large pieces."""

    def __init__(self, file):
        self.file, self.start, self.data = file, 0, b""

    def at(self, offset: int, size: int) -> bytes:
        low = offset - self.start
        if low < 0 or low + size > len(self.data):
            self.file.seek(offset)
            self.start, self.data, low = offset, self.file.read(max(size, WINDOW)), 0
        return self.data[low : low + size]


class _Cursor:
    """The plain bytes of a file from the start of a record on, whether plain or in gzip members.

    A member may hold any number of records. A file that ends inside a record or a member is an error.
    """

    def __init__(self, window: _Window, size: int):
        self.window, self.size, self.place = window, size, 0
        self.packed = window.at(0, 2) == b"\x1f\x8b"
        self.inflate, self.member, self.taken, self.own = None, 0, 0, None
        self.got = bytearray()

    def _start_member(self) -> None:
        head = self.window.at(self.place, 24)
        if head[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {self.place}")
        own = len(head) == 24 and head[3] == 4 and head[12:14] == b"sl"
        # compressed and plain length, where the member carries them
        self.own = struct.unpack("<II", head[16:24]) if own else None
        self.inflate, self.member, self.taken = zlib.decompressobj(31), self.place, 0

    def more(self, size: int) -> bool:
        """Get further bytes, about ``size``; False at the end of the file."""
        if not self.packed:
            piece = self.window.at(self.place, size)
            self.place += len(piece)
            self.got += piece
            return bool(piece)
        while True:
            if self.inflate is None:
                if self.place >= self.size:
                    return False
                self._start_member()
            data = self.inflate.unconsumed_tail
            if not data:
                data = self.window.at(self.place, min(max(size, 512), 1 << 16))
                self.place += len(data)
            try:
                out = self.inflate.decompress(data, BATCH_BYTES)
            except zlib.error as error:
                raise ValueError(f"damaged gzip member at byte {self.member}: {error}") from error
            self.got += out
            if self.inflate.eof:
                self.place -= len(self.inflate.unused_data)
                self.inflate = None
            elif not data:
                raise ValueError(f"truncated gzip member at byte {self.member}")
            if out:
                return True

    def at_record(self) -> bool:
        """Go to the next record, over the line breaks between records; False where there is none."""
        while True:
            blank = len(self.got) - len(self.got.lstrip(b"\r\n"))
            self._drop(blank)
            if self.got:
                return True
            if not self.more(512):
                return False

    def offset(self) -> int:
        """Of the record, or of the member it begins in."""
        return self.member if self.packed else self.place - len(self.got)

    def find(self, mark: bytes, start: int, end: int | None) -> int:
        """Place of a mark from ``start`` on and before ``end``, -1 if it is not there."""
        while (at := self.got.find(mark, start) if end is None else self.got.find(mark, start, end)) < 0:
            if (end is not None and len(self.got) >= end) or not self.more(512):
                return -1
        return at

    def need(self, length: int, record: int) -> None:
        while len(self.got) < length:
            if not self.more(length - len(self.got)):
                raise ValueError(f"truncated record at byte {record}")

    def _drop(self, length: int) -> None:
        del self.got[:length]
        self.taken += length

    def skip(self, length: int, record: int) -> None:
        """Go past ``length`` bytes without decoding more than has to be."""
        if not self.packed and length > len(self.got):
            self.place += length - len(self.got)
            self.got.clear()
            if self.place > self.size:
                raise ValueError(f"truncated record at byte {record}")
            return
        if self.inflate is not None and self.taken == 0 and self.own and self.own[1] == length + len(END):
            # alone in a member that says how long it is
            self.place, self.inflate = self.member + self.own[0], None
            self.got.clear()
            if self.place > self.size:
                raise ValueError(f"truncated gzip member at byte {self.member}")
            return
        while length:
            if not self.got and not self.more(1 << 16):
                raise ValueError(f"truncated record at byte {record}")
            step = min(length, len(self.got))
            self._drop(step)
            length -= step


def _fields(head: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def _digest(value: str | None) -> str | None:
    """Bare lower-case hex of a labelled SHA-1 in base 32 or hex; anything else as it stands."""
    label, _, code = (value or "").partition(":")
    if label.lower() != "sha1":
        return value
    return base64.b32decode(code.upper()).hex() if len(code) == 32 else code.lower()


def records(window: _Window, size: int, wanted, payloads: bool) -> Iterator[dict]:
    """All records of a file that ``wanted(columns)`` keeps."""
    cursor = _Cursor(window, size)
    while cursor.at_record():
        offset = cursor.offset()
        cursor.need(5, offset)
        mark = cursor.find(END, 0, None) if cursor.got.startswith(b"WARC/") else -1
        if mark < 0:
            raise ValueError(f"no whole WARC record at byte {offset}")
        front = mark + len(END)
        fields = _fields(bytes(cursor.got[:mark]))
        length = fields.get("content-length", "")
        if not length.isdecimal():
            raise ValueError(f"record without a Content-Length at byte {offset}")
        whole = front + int(length)
        row = {
            "record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": fields.get("warc-type"),
            "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
            "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
            "payload_digest": _digest(fields.get("warc-payload-digest")), "offset": offset,
        }
        if not wanted(row):
            cursor.skip(whole, offset)
            continue
        start, said = front, ""
        if fields.get("content-type", "").startswith("application/http"):
            end = cursor.find(END, front, whole)
            start = end + len(END) if end >= 0 else whole
            cursor.need(start, offset)
            said = _fields(bytes(cursor.got[front : end if end >= 0 else whole])).get("content-length", "")
        revisit = row["record_type"] == "revisit"
        row["payload_length"] = int(said) if revisit and said.isdecimal() else whole - start
        row["payload"] = None
        if payloads and not revisit:
            cursor.need(whole, offset)
            row["payload"] = bytes(cursor.got[start:whole])
        cursor.skip(whole, offset)
        yield row


def _test(pushed) -> object:
    """A pushed filter as a function of a record's columns, or None."""
    column = pushed.attribute[0] if len(getattr(pushed, "attribute", ())) == 1 else None
    if column not in FILTERED:
        return None
    if isinstance(pushed, (EqualTo, EqualNullSafe)):
        return lambda row, v=pushed.value: row[column] == v and (v is not None or isinstance(pushed, EqualNullSafe))
    if isinstance(pushed, In):
        return lambda row, v=frozenset(pushed.value): row[column] is not None and row[column] in v
    if isinstance(pushed, StringStartsWith):
        return lambda row, v=pushed.value: row[column] is not None and row[column].startswith(v)
    if isinstance(pushed, IsNull):
        return lambda row: row[column] is None
    if isinstance(pushed, IsNotNull):
        return lambda row: row[column] is not None
    return None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.payloads = options["path"], str(options.get("payload", "true")).lower() != "false"
        self.names, self.tests = [f.name for f in schema.fields], []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            test = _test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, root = _open(self.path)
        names = [f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File]
        manifests = [n for n in names if n.startswith("_manifest-")]
        if manifests:
            names = []
            for manifest in manifests:
                with system.open_input_stream(f"{root}/{manifest}") as file:
                    names += json.loads(file.read())
        found = sorted(n for n in names if n.endswith((".warc", ".warc.gz")))
        return [InputPartition(n) for n in found] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.value:
            return
        system, root = _open(self.path)
        path = f"{root}/{partition.value}"
        kinds = {"payload_length": pa.int64(), "payload": pa.binary(), "offset": pa.int64()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in self.names])
        rows, held = [], 0
        with system.open_input_file(path) as file:
            wanted = lambda row: all(test(row) for test in self.tests)
            try:
                for row in records(_Window(file), file.size(), wanted, self.payloads):
                    rows.append(row | {"file": partition.value})
                    held += 300 + len(row["payload"] or b"")
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            except ValueError as error:
                raise ValueError(f"{path}: {error}") from error
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.packed = options.get("compression", "gzip") != "none"
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}")
                        out, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    head, block = _record(row, self.date)
                    data = head + block + END
                    data = _member(data) if self.packed else data
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return WrittenFiles(names)

    def commit(self, messages: list) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        names = [n for m in messages if m is not None for n in m.names]
        with system.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json", compression=None) as file:
            file.write(json.dumps(names).encode())

    def abort(self, messages: list) -> None:
        system, root = _open(self.path)
        for message in messages:
            for name in message.names if message is not None else ():
                system.delete_file(f"{root}/{name}")


class WrittenFiles(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are added to, not replaced; write to a new folder")
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def crawl_records(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html",
                  revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Records of pages: of equal payloads of at least ``revisit_bytes`` the largest page is kept.

    The digests that occur more than once are landed first: they are few and narrow, so Spark
    broadcasts them if their size allows and else joins by shuffle, where its skew join splits
    a digest that holds a large part of the rows.
    """
    rows = pages.select(
        F.col(page).alias("page"), F.col(url).alias("target_uri"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("bigint")})
    repeated = (
        rows.where(F.col("payload_length") >= revisit_bytes).groupBy("payload_digest")
        .agg(F.max("page").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 AND kept IS NOT NULL").drop("n")
    )
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    again = F.col("kept").isNotNull() & ~F.col("page").eqNullSafe(F.col("kept"))
    return rows.join(land(repeated, "warc-repeated"), "payload_digest", "left").select(
        name("page").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, name("kept")).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    register(rows.sparkSession)
    rows.write.format("warc").mode("append").option("compression", compression).save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A frame that can be filtered in several ways. Spark keeps the filters last pushed to a frame's source until
    others are pushed, also for a query without any; so there is always one, which holds for every record."""
    register(spark)
    rows = spark.read.format("warc").option("payload", str(payload).lower()).load(path)
    return rows.where("offset IS NOT NULL")
