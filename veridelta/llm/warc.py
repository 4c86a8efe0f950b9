"""WARC archives: a PySpark Python data source that writes and reads them.

write_warc makes one record per row with DataFrame functions; each writing task turns its
records into one archive, every record a gzip member of its own.  A member's header says
in an extra field how long the member is (the skip lengths of the WARC standard's annex on
compression: compressed and plain octets), so a reader can pass over it unread.  Files
carry the number of the attempt that wrote them; commit keeps those of successful attempts
and deletes the others'.  Of rows with equal payloads the one with the smallest key is
stored, the others become revisit records that keep headers only.

The source "warc" plans one partition per archive (.warc or .warc.gz).  Filters on record
type and on header columns are pushed down; a record's headers are parsed first, from the
first few inflated kilobytes of a member, and its block is skipped by a seek, neither
inflated nor decoded, where a filter rejects it or payloads are not wanted (option
payload=false).  Members without skip lengths are inflated to their ends, as nothing else
says where they lie.  Files are opened with pyarrow's file systems, so an archive may lie
in any store that those know; never in a folder of one machine on a cluster.

Spark plans a query when it runs, so its setting for filters of Python sources must be on
then: read_warc turns spark.sql.python.filterPushdown.enabled on for the session.

Defined cases: a null payload is empty; a null key has no id header and is always a
response; rows with a repeated key and payload are each a response; a null or unprintable
address is escaped; other columns are ignored; very long payloads are one member each; no
rows give an archive without pages.
"""

from __future__ import annotations

import gzip
import io
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import IO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from . import blocks as B

SCHEMA = "path string, offset long, record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, refers_to string, content_length long, headers map<string,string>, http_headers map<string,string>, payload binary"
#: header that each column holds
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_ID = "urn:page:"
#: payload bytes that one batch of rows gathers before it is handed on
BATCH_BYTES = 8 << 20


def base32(sha: Column | str) -> Column:
    """Bare base32 of a SHA-1 in hex: forty bits, two groups of five hex digits, are eight letters."""
    h = F.col(sha) if isinstance(sha, str) else sha
    group = lambda i: F.conv(F.substr(h, (i / 8).cast("int") * 10 + 1, F.lit(10)), 16, 10).cast("long")
    letter = lambda i: F.substr(F.lit(_BASE32), (F.expr("0") + group(i).bitwiseAND(F.lit((1 << 40) - 1)) / F.pow(F.lit(2.0), 35 - 5 * (i % 8))).cast("long").bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def write_warc(rows: DataFrame, path: str, key: str = "page_id", payload: str = "html", address: str = "url", min_bytes: int = 0, compression: str = "gzip") -> None:
    """Archives of all rows in the folder path; payloads of at least min_bytes are stored once; compression: gzip or none."""
    p = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    uri = F.col(address) if address in rows.columns else F.lit(None).cast("string")
    d = rows.select(F.col(key).cast("long").alias("id"), p.alias("payload"), F.coalesce(uri, F.lit("about:blank")).alias("uri"))
    d = d.withColumns({"size": F.octet_length("payload").cast("long"), "sha": F.sha1(F.col("payload").cast("binary"))})
    # only payloads that occur again have something to look up; as a written table their size is known when the join
    # is planned: Spark broadcasts them below its threshold, so that no payload is exchanged, and sorts both sides above
    again = d.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    d = d.join(B.stored(again, "revisits"), ["sha", "size"], "left").withColumn("digest", base32("sha"))
    revisit = F.col("id").isNotNull() & (F.col("id") > F.col("first_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat("http", F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page = lambda c: F.concat(F.lit(f"<{_ID}"), F.col(c).cast("string"), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.coalesce(page("id"), F.concat(F.lit("<urn:sha1:"), F.col("digest"), F.lit(">")))),
        line("WARC-Target-URI", F.regexp_replace("uri", r"[\x00-\x20\x7F]", "%20")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", page("first_id")), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    out = d.withColumn("revisit", F.coalesce(revisit, F.lit(False))).withColumn("http", http).withColumn("block", block).select(F.concat(head, F.col("block"), F.lit("\r\n\r\n")).cast("binary").alias("record"))
    rows.sparkSession.dataSource.register(WarcSource)
    out.write.format("warc").mode("append").option("compression", compression).save(path)


_INFO = b"software: veridelta\r\nformat: WARC File Format 1.1\r\n"
INFO = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(_INFO), _INFO)
#: fixed values: gzip's signature, method and flag of an extra field; the extra field's mark and size
_GZIP, _SKIP = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", b"sl\x08\0"


def member(record: bytes) -> bytes:
    """The record as a gzip member with skip lengths, which four bytes each must hold; beyond, without."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(record) + pack.flush() + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    whole = len(_GZIP) + 2 + len(_SKIP) + 8 + len(body)
    if max(whole, len(record)) >> 32:
        return gzip.compress(record, 6, mtime=0)
    return _GZIP + struct.pack("<H", len(_SKIP) + 8) + _SKIP + struct.pack("<II", whole, len(record)) + body


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.compressed = options.get("compression", "gzip") != "none"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc{'.gz' if self.compressed else ''}"
        packed = member if self.compressed else bytes
        store, inner = _store(self.path)
        store.create_dir(inner, recursive=True)
        with store.open_output_stream(f"{inner}/{name}", compression=None) as f:
            f.write(packed(INFO))
            for batch in iterator:
                for record in batch.column(0):
                    f.write(packed(record.as_py()))
        return Written(name)

    def _tidy(self, keep: set[str], everything: bool) -> None:
        store, inner = _store(self.path)
        for x in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if x.type == fs.FileType.File and x.base_name not in keep and (everything or x.base_name.startswith("part-")):
                store.delete_file(x.path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Every write has a folder of its own, so what no message names is of a failed attempt."""
        self._tidy({m.name for m in messages if m is not None}, self.overwrite)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._tidy(set(), False)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Archive(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


def _opened(path: str) -> IO[bytes]:
    store, inner = _store(path)
    return io.BufferedReader(_Raw(store.open_input_file(inner)), 1 << 16)


class _Raw(io.RawIOBase):
    """pyarrow's file as a raw stream, for buffered reads and seeks."""

    def __init__(self, f: pa.NativeFile) -> None:
        self.f = f

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, b: memoryview) -> int:
        got = self.f.read(len(b))
        b[: len(got)] = got
        return len(got)

    def seek(self, to: int, whence: int = 0) -> int:
        return self.f.seek(to, whence)

    def tell(self) -> int:
        return self.f.tell()


def _headers(lines: Iterator[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for x in lines:
        if not x.strip():
            break
        if x[:1] in b" \t" and last:
            out[last] += " " + x.strip().decode("utf-8", "replace")
        else:
            name, _, value = x.partition(b":")
            out[last := name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


Found = tuple[int, dict[str, str], int, bytes | None]


def records(f: IO[bytes], wanted, payloads: bool) -> Iterator[Found]:
    """Offset, headers, block length and block of each record that wanted(headers) accepts; other blocks are skipped."""
    if f.peek(2)[:2] == b"\x1f\x8b":
        yield from _members(f, wanted, payloads)
    else:
        yield from _plain(f, wanted, payloads)


def _plain(f: IO[bytes], wanted, payloads: bool) -> Iterator[Found]:
    while True:
        at = f.tell()
        version = f.readline()
        if not version:
            return
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = _headers(iter(f.readline, b""))
        size = int(head.get("content-length", 0))
        if not (payloads and wanted(head)):
            f.seek(size, 1)
            if wanted(head):
                yield at, head, size, None
            continue
        block = f.read(size)
        if len(block) < size:
            raise ValueError(f"record at byte {at} is cut short")
        yield at, head, size, block


def _members(f: IO[bytes], wanted, payloads: bool) -> Iterator[Found]:
    """Records of an archive whose members have skip lengths; from the first without, the rest is inflated in one go."""
    while True:
        at = f.tell()
        fixed = f.read(12)
        if not fixed:
            return
        extra = f.read(struct.unpack("<H", fixed[10:])[0]) if fixed[:4] == _GZIP[:4] and len(fixed) == 12 else b""
        if extra[:4] != _SKIP or len(extra) != 12:
            f.seek(at)
            yield from _plain(gzip.GzipFile(fileobj=f), wanted, payloads)
            return
        end = at + struct.unpack("<I", extra[4:8])[0]
        inflate, text = zlib.decompressobj(-15), b""
        while b"\r\n\r\n" not in text and f.tell() < end:
            text += inflate.decompress(f.read(min(1024, end - f.tell())))
        lines, _, begun = text.partition(b"\r\n\r\n")
        version, *fields = lines.split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = _headers(iter(fields))
        size = int(head.get("content-length", 0))
        if wanted(head):
            block = None
            if payloads:
                block = (begun + inflate.decompress(f.read(max(0, end - f.tell()))) + inflate.flush())[:size]
                if len(block) < size:
                    raise ValueError(f"record at byte {at} is cut short")
            yield at, head, size, block
        f.seek(end)


def _bare(x: str | None) -> str | None:
    return x[1:-1] if x and x[0] == "<" and x[-1] == ">" else x


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() == "true"
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | IsNotNull | StringStartsWith) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                kind = type(f).__name__
                self.filters.append((kind, f.attribute[0], None if kind == "IsNotNull" else f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        store, inner = _store(self.path)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.File:
            return [Archive(self.path)]
        found = store.get_file_info(fs.FileSelector(inner, recursive=True))
        names = sorted(x.path for x in found if x.type == fs.FileType.File and x.size and x.base_name[0] not in "_.")
        scheme = self.path[: len(self.path) - len(self.path.split("://", 1)[-1])] if "://" in self.path else "file:" if self.path.startswith("file:") else ""
        prefix = scheme + (self.path.split("://", 1)[1].split("/", 1)[0] if scheme and not names[:1] == [] and not names[0].startswith("/") and scheme not in ("file://", "s3://", "gs://") else "")
        return [Archive(prefix + x) for x in names]

    def _wanted(self, head: dict[str, str]) -> bool:
        for kind, column, value in self.filters:
            x = head.get(HEADERS[column])
            x = _bare(x) if column in ("record_id", "refers_to") else x
            if x is None or kind == "EqualTo" and x != value or kind == "In" and x not in value or kind == "StringStartsWith" and not x.startswith(value):
                return False
        return True

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archives at all
            return
        rows: list[dict] = []
        gathered = 0
        with _opened(partition.path) as f:
            for at, head, size, block in records(f, self._wanted, self.payloads):
                http, payload = None, block
                if block is not None and head.get("content-type", "").startswith("application/http"):
                    lines, _, payload = block.partition(b"\r\n\r\n")
                    http = list(_headers(iter(lines.split(b"\r\n")[1:])).items())
                row = {c: head.get(h) for c, h in HEADERS.items()}
                row |= {"record_id": _bare(row["record_id"]), "refers_to": _bare(row["refers_to"])}
                rows.append(row | {"path": partition.path, "offset": at, "content_length": size, "headers": list(head.items()), "http_headers": http, "payload": payload})
                gathered += len(block or b"") + 500
                if gathered >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, gathered = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
        cols = [x.split() for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[t]) for c, t in cols], names=[c for c, _ in cols])


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The archives' records; filters on header columns reach the reader."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, min_bytes: int = 0, compression: str = "gzip") -> DataFrame:
    """Writes the pages' archives to the shared folder, and what reading them gives."""
    spark = pages.sparkSession
    path = f"{B.shared_dir(spark)}/veridelta/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, min_bytes=min_bytes, compression=compression)
    # both kinds are wanted and nothing else; of revisits no block is there to be read
    r = read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))
    stored = F.col("record_type") == "response"
    number = lambda c: F.when(F.col(c).startswith(_ID), F.substr(F.col(c), F.lit(len(_ID) + 1)).cast("long"))
    return r.select(
        number("record_id").alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.element_at("http_headers", "content-length").cast("long")).alias("payload_bytes"),
        F.when(stored, base32(F.sha1("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
