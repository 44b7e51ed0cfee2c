"""WARC archives as a PySpark data source, and the writing of pages as such.

spark.read.format("kf_warc").option("path", folder or file): filters on warc_type and on header columns (target_uri, page_id,
payload_digest, record_id, refers_to) are pushed down and judged on the parsed headers, and of a record that is not wanted, or whose payload
nobody asked for, no more is read than must be. Archives written here are planned as ranges at record boundaries: every record is a
gzip member with the 'sl' skip lengths of the WARC guidelines, by which the reader seeks over it. Any other .warc or .warc.gz file is one
partition and read in order: a plain file is sought over, a compressed one inflated and thrown away.
Options: payload=true returns payloads; verify=true (the default) decodes the payloads of responses to count and digest them,
and fails if a SHA-1 differs from the header; verify=false takes both from the headers.

df.write.format("kf_warc").option("path", folder).mode("append"): one record per row; a file per task, named by a random id, counts
only once the manifest of the committed job names it, so retried tasks and lost executors leave no doubles.

Defined cases: a null payload is empty; a null url or page_id leaves its header out; equal payloads of one page_id that
is the largest are all responses; pages without id revisit the response, or are responses if no page with that payload has an
id; line breaks in header values are percent-encoded; an empty table gives an archive of no records. Records of other types have their
block as payload, requests and revisits none; a chunked response has its chunks joined; a header that is missing or no number
where one is due is null; files of jobs that were not committed are not read; a truncated or damaged file, and a folder that is not there,
raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage

from kernelfield.llm.common import shared_dir, table

FIELDS = "warc_type string, record_id string, target_uri string, page_id bigint, refers_to bigint, payload_digest string, payload_bytes bigint, headers map<string,string>, payload binary"
_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x0c\x00sl\x08\x00"
_MEMBER = len(_HEAD) + 8
#: Bytes; beyond, a file is taken for damaged.
MOST_HEADER = 1 << 20
#: Files that the writer makes, which count only by a manifest.
_OWN = re.compile(r"part-[0-9a-f]{32}\.warc\.gz")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def filesystem(uri: str):
    """pyarrow's file system and path of a folder."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def member(headers: list[tuple[str, str]], block: bytes, level: int = 3) -> bytes:
    """A record as a gzip member with skip lengths."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    raw = head.encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    return _HEAD + struct.pack("<II", _MEMBER + len(body) + 8, len(raw) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    headers += [("WARC-Target-URI", url)] if url is not None else []
    headers += [("X-Page-Id", str(page_id))] if page_id is not None else []
    block = _HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return member(headers, block + payload)
    return member([*headers, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", str(refers_to))], block)


class _Done(WriterCommitMessage):
    def __init__(self, name: str, size: int, starts: list[int]):
        self.name, self.size, self.starts = name, size, starts


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.date, self.range = options["path"], options.get("date", "1970-01-01T00:00:00Z"), int(options.get("rangebytes", 8 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name, at, starts, after = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0], self.range
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to")]
                for page_id, url, payload, digest, refers in zip(*columns, strict=True):
                    if at >= after:
                        starts.append(at)
                        after = at + self.range
                    data = record(page_id, url, payload or b"", digest or base32_sha1(payload or b""), refers, self.date)
                    out.write(data)
                    at += len(data)
        return _Done(name, at, starts)

    def commit(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        found = [{"name": m.name, "size": m.size, "starts": m.starts} for m in messages if m is not None]
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(found).encode())

    def abort(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.name}")


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


#: Column, header and how a header becomes the column's value.
_COLUMNS = {"warc_type": ("warc-type", str), "record_id": ("warc-record-id", str), "target_uri": ("warc-target-uri", str), "page_id": ("x-page-id", int), "refers_to": ("x-refers-to-page-id", int), "payload_digest": ("warc-payload-digest", lambda v: v.partition(":")[2] if v.lower().startswith("sha1:") else v)}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload, self.verify = options.get("payload", "false") == "true", options.get("verify", "true") == "true"
        self.tests: list[tuple[str, list | None, bool]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            if name in _COLUMNS and isinstance(f, EqualTo):
                self.tests.append((name, [f.value], False))
            elif name in _COLUMNS and isinstance(f, In):
                self.tests.append((name, list(f.value), False))
            elif name in _COLUMNS and isinstance(f, IsNotNull):
                self.tests.append((name, None, False))
            elif name in _COLUMNS and isinstance(f, IsNull):
                self.tests.append((name, None, True))
            else:
                yield f

    def partitions(self):
        fs, root = filesystem(self.path)
        from pyarrow.fs import FileSelector, FileType

        out, known, others = [], set(), []
        if fs.get_file_info(root).type == FileType.File:
            return [Range(root, 0, -1)]
        for info in fs.get_file_info(FileSelector(root)):
            if info.base_name.startswith("_manifest-"):
                with fs.open_input_stream(info.path) as f:
                    for x in json.loads(f.read()):
                        known.add(x["name"])
                        ends = [*x["starts"][1:], x["size"]]
                        out += [Range(f"{root}/{x['name']}", s, e) for s, e in zip(x["starts"], ends, strict=True) if e > s]
            elif info.type == FileType.File and info.base_name.endswith((".warc", ".warc.gz")):
                others.append(info.base_name)
        out += [Range(f"{root}/{x}", 0, -1) for x in sorted(others) if x not in known and not _OWN.fullmatch(x)]
        return out or [Range("", 0, 0)]

    def wanted(self, values: dict) -> bool:
        return all((values[c] is None) == null if allowed is None else values[c] in allowed for c, allowed, null in self.tests)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, t) for n, t in zip(("warc_type", "record_id", "target_uri", "page_id", "refers_to", "payload_digest", "payload_bytes", "headers", "payload"), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()), strict=True)])
        rows, held = [], 0
        for values, payload in self.records(partition):
            rows.append(values | {"payload": payload if self.payload else None})
            held += len(payload or b"") if self.payload else 200
            if held > 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, partition: Range) -> Iterator[tuple[dict, bytes | None]]:
        """Columns and payload of the records that are wanted. end -1: all of a file, whoever wrote it."""
        if partition.start == partition.end:
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.file) as f:
            if partition.end >= 0:
                yield from self._by_member(f, partition)
            else:
                packed = f.read(2) == b"\x1f\x8b"
                f.seek(0)
                yield from self._in_order(Gunzip(f, partition.file) if packed else Plain(f, partition.file), partition.file)

    def _needs_block(self, kind: str | None) -> bool:
        return self.payload or (self.verify and kind == "response")

    def _by_member(self, f, partition: Range) -> Iterator[tuple[dict, bytes | None]]:
        at = partition.start
        while at < partition.end:
            where = f"{partition.file} at {at}"
            f.seek(at)
            first = f.read(min(2048, partition.end - at))
            if len(first) < _MEMBER or first[: len(_HEAD)] != _HEAD:
                raise ValueError(f"{where}: no record begins here")
            size = struct.unpack("<I", first[len(_HEAD) : len(_HEAD) + 4])[0]
            if size <= _MEMBER or at + size > partition.end:
                raise ValueError(f"{where}: its length does not fit the file")
            unpack = zlib.decompressobj(-15)
            raw, read = unpack.decompress(first[_MEMBER:]), len(first)
            while b"\r\n\r\n" not in raw:
                more = f.read(min(2048, size - read))
                if not more or len(raw) > MOST_HEADER:
                    raise ValueError(f"{where}: its header does not end")
                read += len(more)
                raw += unpack.decompress(more)
            head, _, body = raw.partition(b"\r\n\r\n")
            headers, values = _parsed(head, where)
            if self.wanted(values):
                length = _length(headers, where)
                if self._needs_block(values["warc_type"]) or length <= len(body):
                    if len(body) < length:
                        body += unpack.decompress(f.read(max(0, size - read)))
                    if len(body) < length:
                        raise ValueError(f"{where}: it is cut off")
                yield self._record(headers, values, body[:length], where)
            at += size

    def _in_order(self, stream: Plain | Gunzip, file: str) -> Iterator[tuple[dict, bytes | None]]:
        while True:
            head = stream.header()
            if head is None:
                return
            where = f"{file}, record ending its header at {stream.at}"
            headers, values = _parsed(head, where)
            length = _length(headers, where)
            if not self.wanted(values):
                stream.skip(length)
            elif self._needs_block(values["warc_type"]) or values["warc_type"] == "response" and length <= 2048:
                yield self._record(headers, values, stream.take(length), where)
            else:
                start = stream.take(min(length, 2048))  # the inner header tells the length of the payload
                stream.skip(length - len(start))
                yield self._record(headers, values, start, where)

    def _record(self, headers: dict, values: dict, block: bytes, where: str) -> tuple[dict, bytes | None]:
        """block may be its beginning only, unless the payload is needed."""
        kind = values["warc_type"]
        whole = self._needs_block(kind)
        inner, _, payload = block.partition(b"\r\n\r\n") if kind in ("response", "revisit", "request") and "http" in headers.get("content-type", "http") else (b"", b"", block)
        raw = payload
        if whole and re.search(rb"(?i)\r\ntransfer-encoding: *chunked", inner):
            payload = _unchunked(payload)
        if kind == "response" and self.verify:
            values["payload_bytes"] = len(payload)
            digest = base32_sha1(payload)
            given = headers.get("warc-payload-digest", "")
            wrong = given.lower().startswith("sha1:") and values["payload_digest"].upper() != digest
            if wrong and (raw is payload or values["payload_digest"].upper() != base32_sha1(raw)):  # some writers digest the chunks
                raise ValueError(f"{where}: payload digest {digest}, header {values['payload_digest']}")
            values["payload_digest"] = values["payload_digest"] or digest
        elif kind in ("response", "revisit"):
            length = re.search(rb"(?i)content-length: *(\d+)", inner)
            values["payload_bytes"] = int(length[1]) if length else len(payload) if whole else None
        else:
            values["payload_bytes"] = int(headers["content-length"])
        values["headers"] = list(headers.items())
        return values, payload if whole and kind not in ("revisit", "request") else None


def _parsed(head: bytes, where: str) -> tuple[dict, dict]:
    """Headers by name in lower case, and the columns."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"{where}: {first[:20]!r} is no WARC record")
    headers: dict[str, str] = {}
    for line in lines:
        if line[:1] in (" ", "\t") and headers:  # a folded line
            headers[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            headers[name] = value.strip()
    values = {}
    for column, (header, kind) in _COLUMNS.items():
        try:
            values[column] = kind(headers[header]) if header in headers else None
        except ValueError:
            values[column] = None
    return headers, values


def _length(headers: dict, where: str) -> int:
    if not headers.get("content-length", "").isdigit():
        raise ValueError(f"{where}: no Content-Length")
    return int(headers["content-length"])


def _unchunked(body: bytes) -> bytes:
    """The chunks of a body joined; the body itself if it is not what it says."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at : max(at, end)].split(b";")[0].strip()
        if end < 0 or not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return body
        if int(size, 16) == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + int(size, 16)])
        at = end + 2 + int(size, 16) + 2


class Plain:
    """An uncompressed archive, read in order."""

    def __init__(self, f, name: str):
        self.f, self.name, self.at, self.held = f, name, 0, b""

    def _more(self) -> bytes:
        return self.f.read(1 << 16)

    def _pull(self) -> bool:
        more = self._more()
        self.held += more
        return bool(more)

    def header(self) -> bytes | None:
        """Up to the empty line; None at the end of the file."""
        while True:
            self.held, before = self.held.lstrip(b"\r\n"), len(self.held)
            self.at += before - len(self.held)
            if self.held:
                break
            if not self._pull():
                return None
        while b"\r\n\r\n" not in self.held:
            if len(self.held) > MOST_HEADER or not self._pull():
                raise ValueError(f"{self.name} at {self.at}: a header does not end")
        head, _, self.held = self.held.partition(b"\r\n\r\n")
        self.at += len(head) + 4
        return head

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            more = self._more()
            if not more:
                raise ValueError(f"{self.name} at {self.at}: a record is cut off")
            parts.append(more)
            have += len(more)
        whole = b"".join(parts)
        self.held = whole[n:]
        self.at += n
        return whole[:n]

    def skip(self, n: int) -> None:
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            to = self.f.tell() + n - len(self.held)
            if to > self.f.size():
                raise ValueError(f"{self.name} at {self.at}: a record is cut off")
            self.f.seek(to)
            self.held = b""
        self.at += n


class Gunzip(Plain):
    """A compressed archive of any number of members, inflated in order."""

    def __init__(self, f, name: str):
        super().__init__(f, name)
        self.unpack, self.rest = None, b""

    def _more(self) -> bytes:
        while True:
            if not self.rest:
                self.rest = self.f.read(1 << 16)
                if not self.rest:
                    if self.unpack is not None:
                        raise ValueError(f"{self.name} at {self.at}: a gzip member is cut off")
                    return b""
            if self.unpack is None:
                self.unpack = zlib.decompressobj(31)
            try:
                out = self.unpack.decompress(self.rest, 1 << 20)
            except zlib.error as e:
                raise ValueError(f"{self.name} at {self.at}: {e}") from e
            self.rest = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.rest, self.unpack = self.unpack.unused_data, None
            if out:
                return out

    def skip(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.at += len(self.held)
            self.held = self._more()
            if not self.held:
                raise ValueError(f"{self.name} at {self.at}: a record is cut off")
        self.held = self.held[n:]
        self.at += n


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kf_warc"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, path: str, least_bytes: int = 0, html: str = "html", key: str = "page_id", url: str = "url") -> None:
    """Writes a record per row. Of equal payloads of at least least_bytes the row with the largest key is the response, the others revisit it."""
    register(pages.sparkSession)
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.sha1("payload"))
    repeated = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha1").alias("of"), "first")
    linked = rows.join(repeated, F.col("sha1") == F.col("of"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    linked.select("page_id", "url", "payload", F.lit(None).cast("string").alias("payload_digest"), refers.alias("refers_to")).write.format("kf_warc").option("path", path).mode("append").save()


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("kf_warc").options(path=path, **options).load()


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top, CAST(CAST(from_hex(d) AS BIT) AS VARCHAR) AS bits FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * CAST(substr(bits, 5 * i + 1, 1) AS BIGINT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS BIGINT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS BIGINT)
    + 2 * CAST(substr(bits, 5 * i + 4, 1) AS BIGINT) + CAST(substr(bits, 5 * i + 5, 1) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m
"""
