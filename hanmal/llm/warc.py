"""WARC archives read by an index first (operator 6).

build_index() scans archives once, a file a task, and writes one row for each record: file, offset and length of its bytes, the
record's place in them (inner, size; a gzip member may hold several records), type, URL, payload digest. A selection is then any query on that table, and fetch() reads only the selected records: rows are
partitioned by file and block of BLOCK bytes, sorted by offset, and ranges closer than MAX_GAP are read together, up to MAX_READ
bytes at once. Every record is parsed from its own range and its payload checked against the indexed digest.

Archives are .warc (plain) or .warc.gz, in gzip members of whole records (one each, as the format wants it). They are opened through
pyarrow.fs, so any file system that executors share will do. write_archives() makes archives from a table of pages: each
task writes a file of its own under a temporary name and renames it, so a lost or repeated task does no harm.

Defined results: every URL survives the round trip: one with control characters, or with blanks around it, is written percent-encoded
and marked so; a null url or html survives the round trip (the header is left out; the payload is marked absent, its
digest is null); an empty html is an empty payload; repeated rows are records of their own; an empty table makes archives without
records, and an empty selection an empty table; other columns of pages are not archived; a damaged record, or one that does not
match its digest, raises an error that names file and offset, and so do bytes after a record that are not a record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, require, spark_to_arrow

BLOCK, MAX_GAP, MAX_READ = 64 << 20, 128 << 10, 8 << 20
INDEX = "file string, offset long, length long, inner long, size long, type string, url string, digest string, page_id long"
RECORDS = "page_id long, url string, html string, digest string"


def filesystem(uri: str):
    """The pyarrow file system and path of a URI or plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def digest_of(payload: bytes) -> str:
    return "sha1:" + hashlib.sha1(payload).hexdigest()


_UNSAFE = re.compile("[\\x00-\\x20\\x7f%]")


def header_value(url: str) -> tuple[str, bool]:
    """url as a header can hold it, and whether that is percent-encoded."""
    if not re.search("[\\x00-\\x1f\\x7f]|^ | $", url):
        return url, False
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url), True


def matches(digest: str, body: bytes) -> bool:
    """Whether a digest, SHA-1 in hexadecimal or base 32, is that of body; other algorithms are not checked."""
    kind, _, value = digest.partition(":")
    sha = hashlib.sha1(body)
    return kind.lower() != "sha1" or value.lower() == sha.hexdigest() or value.upper() == base64.b32encode(sha.digest()).decode()


def make_record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A response record, uncompressed."""
    body = (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head = ["WARC/1.0", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        value, encoded = header_value(url)
        head += ["WARC-Target-URI: " + value, *["X-Target-URI-Encoding: percent"] * encoded]
    head.append("WARC-Payload-Digest: " + digest_of(body) if html is not None else "X-Payload: absent")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes, where: str = "record") -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and block of an uncompressed record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        raise ValueError(f"{where}: no WARC header")
    headers = {k.strip().lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    n = int(headers.get("content-length", "-1"))
    if not 0 <= n <= len(rest):
        raise ValueError(f"{where}: truncated")
    return headers, rest[:n]


def url_of(headers: dict[str, str]) -> str | None:
    url = headers.get("warc-target-uri")
    return unquote(url) if url is not None and headers.get("x-target-uri-encoding") == "percent" else url


def records(data: bytes, where: str) -> Iterator[tuple[int, int]]:
    """Offset and length of each record of the content of a gzip member."""
    at = 0
    while at < len(data):
        head_end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or head_end < 0:
            raise ValueError(f"{where}: no WARC header at {at} of its content")
        n = head_end + 4 - at + content_length(data[at:head_end])
        if at + n > len(data):
            raise ValueError(f"{where}: truncated")
        while data[at + n : at + n + 2] == b"\r\n":
            n += 2
        yield at, n
        at += n


def content_length(head: bytes) -> int:
    return next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)


def payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def members(f, where: str, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member, or of each record of a plain archive."""
    buf, at = f.read(chunk), 0
    if buf[:2] == b"\x1f\x8b":
        while buf:
            z, out, used = zlib.decompressobj(31), io.BytesIO(), 0
            while not z.eof:
                if not buf:
                    raise ValueError(f"{where} at {at}: truncated")
                out.write(z.decompress(buf))
                used += len(buf) - len(z.unused_data)
                buf = z.unused_data or (b"" if z.eof else f.read(chunk))
            yield at, used, out.getvalue()
            at += used
            buf = buf or f.read(chunk)
        return
    while buf:
        while b"\r\n\r\n" not in buf:
            more = f.read(chunk)
            if not more:
                raise ValueError(f"{where} at {at}: truncated")
            buf += more
        head = buf.partition(b"\r\n\r\n")[0]
        if not head.startswith(b"WARC/"):
            raise ValueError(f"{where} at {at}: no WARC header")
        n = len(head) + 4 + content_length(head) + 4
        parts = [buf]
        have = len(buf)
        while have < n:
            more = f.read(max(chunk, n - have))
            if not more:
                raise ValueError(f"{where} at {at}: truncated")
            parts.append(more)
            have += len(more)
        buf = b"".join(parts)
        yield at, n, buf[:n]
        buf, at = buf[n:] or f.read(chunk), at + n


def write_archives(pages: DataFrame, folder: str) -> list[str]:
    """Writes pages (page_id, url, html) as one archive a partition; the paths."""
    require(pages, "page_id", "url", "html")

    def run(batches):
        from pyspark import TaskContext

        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.warc.gz"
        held = f"{path}/.{name}.{task.taskAttemptId()}"
        n = 0
        with fs.open_output_stream(held, compression=None) as out:
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    out.write(pack(make_record(*row)))
                    n += 1
        if n:
            fs.move(held, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])
        else:
            fs.delete_file(held)

    src = pages.select(F.col("page_id").cast("long"), "url", "html")
    return sorted(f"{folder}/{r['name']}" for r in src.mapInArrow(run, "name string").collect())


def build_index(spark: SparkSession, files: list[str]) -> DataFrame:
    """The index of these archives, written as a table."""
    schema = spark_to_arrow(spark, INDEX)

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = filesystem(name)
                rows: list[tuple] = []
                with fs.open_input_stream(path, compression=None) as f:
                    for offset, length, data in members(f, name):
                        for inner, size in records(data, f"{name} at {offset}"):
                            headers, block = parse(data[inner : inner + size], f"{name} at {offset}")
                            absent = headers.get("x-payload") == "absent"
                            digest = None if absent else headers.get("warc-payload-digest") or digest_of(payload(block))
                            page = headers.get("x-page-id")
                            rows.append((name, offset, length, inner, size, headers.get("warc-type"), url_of(headers), digest, int(page) if page else None))
                        if len(rows) >= 5000:
                            yield _batch(rows, schema)
                            rows = []
                yield _batch(rows, schema)

    names = spark.createDataFrame([(f,) for f in files], "file string")
    path = fresh_path(spark, "warc-index")
    names.repartitionByRange(max(1, len(files)), "file").mapInArrow(run, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def coalesce(ranges: Iterator[tuple], gap: int = MAX_GAP, most: int = MAX_READ) -> Iterator[list[tuple]]:
    """Neighbouring (file, offset, length, ...) rows, in order, that one read should fetch."""
    held: list[tuple] = []
    for r in ranges:
        if held and (r[0] != held[0][0] or r[1] - (held[-1][1] + held[-1][2]) > gap or r[1] + r[2] - held[0][1] > most):
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def fetch(selected: DataFrame) -> DataFrame:
    """page_id, url, html and digest of the selected index rows."""
    schema = spark_to_arrow(selected.sparkSession, RECORDS)
    columns = ["file", "offset", "length", "inner", "size", "url", "digest", "page_id"]

    def run(batches):
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        name, f, out, held = None, None, [], 0
        for group in coalesce(rows):
            if group[0][0] != name:
                if f is not None:
                    f.close()
                name = group[0][0]
                fs, path = filesystem(name)
                f = fs.open_input_file(path)
            start = group[0][1]
            data = f.read_at(max(r[1] + r[2] for r in group) - start, start)
            for _, offset, length, inner, size, url, digest, page_id in group:
                raw = data[offset - start : offset - start + length]
                where = f"{name} at {offset}"
                if raw[:2] == b"\x1f\x8b":
                    raw = zlib.decompress(raw, 31)
                _, block = parse(raw[inner : inner + size], where)
                body = payload(block)
                if digest is not None and not matches(digest, body):
                    raise ValueError(f"{where}: payload does not match {digest}")
                out.append((page_id, url, None if digest is None else body.decode("utf-8", "replace"), digest))
                held += len(body)
                if held > 4 << 20:
                    yield _batch(out, schema)
                    out, held = [], 0
        if f is not None:
            f.close()
        yield _batch(out, schema)

    placed = selected.where("type = 'response'").select(*columns).repartition("file", F.floor(F.col("offset") / BLOCK))
    return placed.sortWithinPartitions("file", "offset", "inner").mapInArrow(run, RECORDS)
