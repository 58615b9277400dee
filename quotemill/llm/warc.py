"""WARC archives as a Python data source, and revisit records for equal payloads."""

from __future__ import annotations

import base64
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.session import stored

# Names and forms that the WARC 1.1 standard gives.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http; msgtype=response"
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
    "content_type": "Content-Type",
    "content_length": "Content-Length",
}
_NUMBERS = ("payload_length", "content_length")
#: Columns of a record. All but ``payload`` come from its headers and its place.
SCHEMA = T.StructType(
    [T.StructField(name, T.LongType() if name in _NUMBERS else T.StringType()) for name in HEADERS]
    + [T.StructField("payload", T.BinaryType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType())]
)
MANIFEST = "_manifest.json"
_FIXED = b"\x1f\x8b\x08\x04"  # gzip, deflate, with an extra field
#: then time, flags, system and the extra field: its length, its name, that one's length, and both lengths
_START = struct.Struct("<4sIBBH2sHII")


# --- one record ---------------------------------------------------------------------------------


def _line(value: str) -> str:
    """A header's value: blanks and control characters, which would end it, are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in value)


def record_bytes(row: dict) -> bytes:
    """A record from its columns: responses carry HTTP headers and the payload, revisits the headers only."""
    kind = row.get("record_type") or "response"
    payload = row.get("payload") or b""
    length = row.get("payload_length")
    length = len(payload) if length is None else length
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + payload if kind == "response" else payload
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": row.get("date") or "1970-01-01T00:00:00Z",
        "WARC-Target-URI": row.get("target_uri"),
        "WARC-Refers-To": row.get("refers_to"),
        "WARC-Profile": REVISIT_PROFILE if kind == "revisit" else None,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode() if row.get("payload_digest") else None,
        "X-Payload-Length": str(length),
        "Content-Type": HTTP_RESPONSE if kind in ("response", "revisit") else row.get("content_type") or "application/octet-stream",
        "Content-Length": str(len(body)),
    }
    head = "".join(f"{name}: {_line(value) if name in ('WARC-Target-URI', 'WARC-Record-ID', 'WARC-Refers-To') else value}\r\n" for name, value in fields.items() if value is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """One gzip member. Its extra field ``sl`` holds the lengths of member and record, where they fit."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = deflate.compress(record) + deflate.flush()
    size = _START.size + len(packed) + 8
    lengths = (size, len(record)) if max(size, len(record)) < 2**32 else (0, 0)
    start = _START.pack(_FIXED, 0, 0, 255, 12, b"sl", 8, *lengths)
    return start + packed + struct.pack("<II", zlib.crc32(record), len(record) % 2**32)


def parse_head(head: bytes) -> dict:
    """Header columns of a record from what stands before its first empty line."""
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    found = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        found.setdefault(name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip())
    out = {column: found.get(name.lower()) for column, name in HEADERS.items()}
    for c in _NUMBERS:
        out[c] = int(out[c]) if out[c] and out[c].isdigit() else None
    digest = out["payload_digest"]
    if digest and digest.startswith("sha1:") and len(digest) == 37:
        out["payload_digest"] = base64.b32decode(digest[5:]).hex()
    elif digest:
        out["payload_digest"] = digest.removeprefix("sha1:").lower()
    return out


def payload_of(columns: dict, body: bytes) -> bytes:
    """What follows the HTTP headers of a response, or the whole block of any other record."""
    if (columns["content_type"] or "").startswith("application/http"):
        return body.partition(b"\r\n\r\n")[2]
    return body


# --- reading ------------------------------------------------------------------------------------


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


class _Bytes:
    """Random access to a file that reads at least ``step`` bytes at once and nothing that is skipped."""

    def __init__(self, source, step: int = 1 << 20):
        self.source, self.step, self.size = source, step, source.size()
        self.start, self.held = 0, b""

    def at(self, offset: int, n: int) -> bytes:
        n = min(n, self.size - offset)
        if offset < self.start or offset + n > self.start + len(self.held):
            self.source.seek(offset)
            self.start, self.held = offset, self.source.read(max(n, self.step))
        return self.held[offset - self.start : offset - self.start + n]


def _members(data: _Bytes, wanted, with_payload: bool, chunk: int = 4096) -> Iterator[tuple[int, dict, bytes | None]]:
    """Offset, header columns and payload of the wanted records of a file, with or without gzip members.

    The headers are inflated first. Where they aren't wanted, or the payload isn't, the rest of the
    member is skipped by the length in its extra field; only members of other writers, which don't
    name it, are run through to find their end.
    """
    offset = 0
    while offset < data.size:
        start = data.at(offset, 24)
        if start[:2] != b"\x1f\x8b":
            yield from _plain(data, offset, wanted, with_payload, chunk)
            return
        named = start[:4] == _FIXED and start[12:16] == b"sl\x08\x00" and struct.unpack("<I", start[16:20])[0]
        inflate, at, text, cut = zlib.decompressobj(31), offset, b"", -1
        while cut < 0 and not inflate.eof and at < data.size:
            part = data.at(at, chunk)
            at += len(part)
            text += inflate.decompress(part)
            cut = text.find(b"\r\n\r\n")
        if cut < 0:
            raise ValueError(f"no end of a record's headers at byte {offset}")
        columns = parse_head(text[:cut])
        take = wanted(columns)
        if take and with_payload or not named:
            rest = [text]
            while not inflate.eof:
                if at >= data.size:
                    raise ValueError(f"a record is cut off at byte {offset}")
                part = data.at(at, max(chunk, named + offset - at if named else 1 << 16))
                at += len(part)
                got = inflate.decompress(part)
                if take and with_payload:
                    rest.append(got)
            length = columns["content_length"]
            text = b"".join(rest)[cut + 4 :][:length] if take and with_payload else b""
            if take and with_payload and len(text) != length:
                raise ValueError(f"the record at byte {offset} has {len(text)} of {length} bytes")
        if take:
            yield offset, columns, payload_of(columns, text) if with_payload else None
        offset = offset + named if named else at - len(inflate.unused_data)


def _plain(data: _Bytes, offset: int, wanted, with_payload: bool, chunk: int) -> Iterator[tuple[int, dict, bytes | None]]:
    """The same for records that aren't packed."""
    while offset < data.size:
        n = chunk
        while (cut := (text := data.at(offset, n)).find(b"\r\n\r\n")) < 0:
            if offset + n >= data.size:
                raise ValueError(f"no end of a record's headers at byte {offset}")
            n *= 2
        columns = parse_head(text[:cut])
        length = columns["content_length"]
        if length is None or offset + cut + 4 + length > data.size:
            raise ValueError(f"a record is cut off at byte {offset}")
        if wanted(columns):
            yield offset, columns, payload_of(columns, data.at(offset + cut + 4, length)) if with_payload else None
        offset += cut + 4 + length + 4


def _holds(test: ds.Filter, columns: dict) -> bool | None:
    """A pushed filter on header columns, with SQL's null."""
    if isinstance(test, ds.Not):
        found = _holds(test.child, columns)
        return None if found is None else not found
    have = columns[test.attribute[0]]
    if isinstance(test, ds.IsNull):
        return have is None
    if isinstance(test, ds.IsNotNull):
        return have is not None
    if isinstance(test, ds.EqualNullSafe):
        return have == test.value
    if have is None or getattr(test, "value", 0) is None:
        return None
    return _TESTS[type(test)](have, test.value)


_TESTS = {
    ds.EqualTo: lambda have, value: have == value,
    ds.In: lambda have, value: True if have in value else None if None in value else False,
    ds.LessThan: lambda have, value: have < value,
    ds.LessThanOrEqual: lambda have, value: have <= value,
    ds.GreaterThan: lambda have, value: have > value,
    ds.GreaterThanOrEqual: lambda have, value: have >= value,
    ds.StringStartsWith: lambda have, value: have.startswith(value),
    ds.StringEndsWith: lambda have, value: have.endswith(value),
    ds.StringContains: lambda have, value: value in have,
}


def _pushable(test: ds.Filter) -> bool:
    if isinstance(test, ds.Not):
        return _pushable(test.child)
    known = isinstance(test, (*_TESTS, ds.IsNull, ds.IsNotNull, ds.EqualNullSafe))
    return known and len(test.attribute) == 1 and test.attribute[0] in HEADERS


@dataclass
class Files(ds.InputPartition):
    """Files that one task reads."""

    paths: list[str]


class WarcReader(ds.DataSourceReader):
    """Reads whole files, several small ones to a task, and of each only what filters and columns ask for."""

    def __init__(self, schema: T.StructType, options: dict):
        self.names = schema.fieldNames()
        self.path = options["path"]
        self.partition_bytes = int(options.get("partitionBytes", 64 << 20))
        self.tests: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for test in filters:
            if _pushable(test):
                self.tests.append(test)
            else:
                yield test

    def _files(self) -> list[tuple[str, int]]:
        """Those that finished writers have listed, or all archives where nothing is listed."""
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        if info.type == pafs.FileType.File:
            return [(path, info.size)]
        listed = _listed(system, path)
        if listed is not None:
            return [(posixpath.join(path, name), size) for name, size in listed]
        found = system.get_file_info(pafs.FileSelector(path, recursive=True))
        return [(f.path, f.size) for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz"))]

    def partitions(self) -> list[Files]:
        tasks, room = [], 0
        for path, size in sorted(self._files()):
            if room < size:
                tasks.append(Files([]))
                room = self.partition_bytes
            tasks[-1].paths.append(path)
            room -= size
        return tasks or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[SCHEMA[n].dataType.simpleString()]) for n in self.names])
        wanted = lambda columns: all(_holds(t, columns) for t in self.tests)
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as source:
                for offset, columns, payload in _members(_Bytes(source), wanted, "payload" in self.names):
                    rows.append({**columns, "payload": payload, "file": path, "offset": offset})
                    held += 1000 + len(payload or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


# --- writing ------------------------------------------------------------------------------------


def _listed(system: pafs.FileSystem, path: str) -> list[list] | None:
    name = posixpath.join(path, MANIFEST)
    if system.get_file_info(name).type != pafs.FileType.File:
        return None
    with system.open_input_stream(name) as source:
        return json.loads(source.read())


@dataclass
class Written(ds.WriterCommitMessage):
    """Files of one finished task, with their sizes."""

    files: list[tuple[str, int]]


class WarcWriter(ds.DataSourceArrowWriter):
    """Each task writes its own files; they count from the moment at which the manifest names them."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("fileBytes", 64 << 20))
        self.level = int(options.get("level", 6))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _opened(self.path)
        system.create_dir(path, recursive=True)
        task = TaskContext.get()
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                for at in range(batch.num_rows):
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                            files[-1] = (files[-1][0], size)
                        # the attempt is part of the name: a repeated task never touches another's files
                        files.append((f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}-{len(files):04d}.warc.gz", 0))
                        out, size = system.open_output_stream(posixpath.join(path, files[-1][0]), compression=None), 0
                        info = {"record_type": "warcinfo", "content_type": "application/warc-fields", "payload": b"format: WARC File Format 1.1\r\n"}
                        size += out.write(member(record_bytes(info), self.level))
                    size += out.write(member(record_bytes(batch.slice(at, 1).to_pylist()[0]), self.level))
        finally:
            if out is not None:
                out.close()
        if files:
            files[-1] = (files[-1][0], size)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _opened(self.path)
        system.create_dir(path, recursive=True)
        before = _listed(system, path) or []
        now = [list(f) for m in messages if m is not None for f in m.files]
        listed = now if self.overwrite else before + now
        with system.open_output_stream(posixpath.join(path, MANIFEST)) as out:
            out.write(json.dumps(listed).encode())
        for name, _ in before if self.overwrite else ():
            system.delete_file(posixpath.join(path, name))

    def abort(self, messages: list[Written | None]) -> None:
        system, path = _opened(self.path)
        for name in (f[0] for m in messages if m is not None for f in m.files):
            system.delete_file(posixpath.join(path, name))


class WarcSource(ds.DataSource):
    """``spark.read.format("warc")``: one row a record; ``write.format("warc")``: one record a row."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """Records of an archive, or of all archives below a folder.

    Only the named columns are read; without ``payload`` no payload is decoded. Filters on header
    columns (equality, lists, ranges, starts, ends and parts of strings, nulls and their negation) are
    tested on a record's headers, before its payload is inflated. The payload of a response is what
    follows its HTTP headers. Files are planned into tasks of ``partitionBytes``. A folder without
    archives gives no row; a record that is cut off or isn't WARC is an error that names its place.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    wanted = SCHEMA if columns is None else T.StructType([SCHEMA[c] for c in columns])
    return spark.read.format("warc").schema(wanted).options(**options).load(path)


def write_warc(records: DataFrame, path: str, mode: str = "overwrite", **options: str) -> None:
    """Write one record per row: gzip members, in files of about ``fileBytes`` packed bytes.

    Columns (any of): record_type (null: response), record_id, target_uri, date, refers_to, payload,
    payload_digest (hex sha1), payload_length, content_type. Others are ignored.
    """
    records.sparkSession.dataSource.register(WarcSource)
    known = [c for c in records.columns if c in SCHEMA.names and c not in ("file", "offset", "content_length")]
    records.select(known).write.format("warc").mode(mode).options(**options).save(path)


# --- equal payloads -----------------------------------------------------------------------------


def page_records(
    pages: DataFrame, least_bytes: int = 1000, hot: int = 1000, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html"
) -> DataFrame:
    """One record per row of ``pages``, ready for ``write_warc``.

    Of rows with equal payloads of ``least_bytes`` or more, that with the largest id becomes the
    response and the others revisit it without a payload; smaller payloads are all responses. Rows
    that share that largest id are all responses, and so are all of a group without any id. A null
    text is an empty payload, a null id gives the record id ``<urn:page:null>``.

    The payloads of the ``hot`` largest groups meet their response's id by a broadcast of that many
    rows; all others are joined by digest, so no group sends more than a thousandth of all rows to a
    task.
    """
    payload = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("payload_length") >= least_bytes).groupBy("payload_digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.where("n > 1"), "equal-payloads")
    crowded = groups.orderBy(F.desc("n"), "payload_digest").limit(hot).select(F.col("payload_digest").alias("hot_digest"), F.col("first").alias("hot_first"))
    big = F.col("payload_length") >= least_bytes
    marked = rows.join(F.broadcast(crowded), big & (F.col("payload_digest") == F.col("hot_digest")), "left")
    settled = F.col("hot_digest").isNotNull() | ~big
    # rows that need no partner get a key of their own, which spreads them
    key = F.when(settled, F.concat(F.lit("-"), F.xxhash64("id", "target_uri").cast("string"))).otherwise(F.col("payload_digest"))
    rest = groups.select(F.col("payload_digest").alias("key"), F.col("first").alias("rest_first"))
    met = marked.withColumn("key", key).join(rest, "key", "left")
    first = F.coalesce("hot_first", "rest_first")
    again = first.isNotNull() & ~F.col("id").eqNullSafe(first)
    return met.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        page_urn(F.col("id")).alias("record_id"),
        "target_uri",
        F.when(again, page_urn(first)).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
        "payload_digest",
        "payload_length",
    )


def page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def page_of(urn: Column) -> Column:
    """The page id that a record id was made from."""
    return F.regexp_extract(urn, "^<urn:page:(.*)>$", 1).try_cast("long")
