"""WARC archives with a two-level capture index (operator 5).

Writing: every task writes its pages as gzip members of one archive and reports
where each record lies. Indexing: capture lines, keyed by reversed host and path,
are range-partitioned and sorted; every range becomes one index file of
compressed blocks, followed by a sparse directory of the blocks' first keys.
Reading: a key is searched in the list of index files, then in that file's
directory, then in one block, and the record is read by offset and length.

Files go through pyarrow's file systems to any folder that all executors share.
A task writes under a name of its own and only committed tasks are listed, so
repeated or lost tasks leave unlisted files and no wrong results.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import uuid
import zlib
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import storage

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
BLOCK_LINES = 3000
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:capture:"
_TAIL = "<QQ"


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed and lower-cased, then port, path and query."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return ")" + _plain(url)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return _plain(key + (f"?{parts.query}" if parts.query else ""))


def _plain(text: str) -> str:
    """Percent-encodes white space and control characters, which would end a line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text) if any(c <= " " or c == "\x7f" for c in text) else text


def record(key: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, level: int = 3) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'' if key is None else key}>",
        f"WARC-Target-URI: {_plain(url or '')}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + press.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]):
        raise ValueError("truncated record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


@lru_cache(maxsize=4)
def _system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _write(folder: str, name: str, parts) -> None:
    """Writes a file completely, then gives it its name."""
    system, base = _system(folder)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/{name}.part", compression=None) as out:
        for part in parts:
            out.write(part)
    system.move(f"{base}/{name}.part", f"{base}/{name}")


@lru_cache(maxsize=64)
def _open(folder: str, name: str):
    system, base = _system(folder)
    return system.open_input_file(f"{base}/{name}")


def _range(folder: str, name: str, offset: int, length: int) -> bytes:
    file = _open(folder, name)
    file.seek(offset)
    return file.read(length)


def mark_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Key, url, payload, digest and ``refers_to``: for payloads of ``least`` bytes or more the
    smallest key of an equal payload, unless that is the row's own; else null.

    A null payload counts as empty. Rows with a null key are never referred to; one whose
    payload has no other key is a response. The smallest keys are
    aggregated before the join by digest, which may split a hot digest.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # written, so that the join has two plain exchanges and may split a hot digest
    first = storage.written(rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("key").alias("_first")), "digests")
    joined = rows.join(first, "digest", "left")
    return joined.select("key", "url", "payload", "digest", F.when(~F.col("key").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


_CAPTURE = "url_key string, key string, file string, offset long, length long"


def write_archives(marked: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Writes one archive for each task; returns the captures as a written table."""
    rows = marked.select(F.col("key").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"))
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")

    def run(batches):
        name, at, found = f"{uuid.uuid4().hex}.warc.gz", 0, []

        def members():
            nonlocal at
            for batch in batches:
                for key, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    member = record(key, url, payload, digest, refers, level)
                    found.append((url_key(url), key, name, at, len(member)))
                    at += len(member)
                    yield member

        stream = members()
        head = next(stream, None)
        if head is None:
            return

        def all_members():
            yield head
            yield from stream

        _write(folder, name, all_members())
        for lo in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c) if k != 1 else pa.array(c, pa.string()) for k, c in enumerate(zip(*found[lo : lo + 10_000], strict=True))], names=["url_key", "key", "file", "offset", "length"])

    return storage.written(rows.mapInArrow(run, _CAPTURE), "captures")


def _line(url_key: str, key: str | None) -> str:
    """What capture lines are sorted and searched by."""
    return f"{url_key} {'' if key is None else key}"


def write_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> list[tuple[str, str]]:
    """Writes index files; returns (first line's key, file), sorted: one for each range,
    so as many as shuffle partitions at most."""
    keyed = captures.withColumn("line", F.concat_ws(" ", "url_key", F.coalesce("key", F.lit(""))))
    # binary order: the order in which Python compares encoded strings
    ranged = keyed.select(F.col("line").cast("binary").alias("line"), "file", "offset", "length").repartitionByRange("line").sortWithinPartitions("line", "file", "offset")

    def run(batches):
        name, directory, at, first = f"{uuid.uuid4().hex}.cdx", [], 0, None

        def blocks():
            nonlocal at, first
            held: list[tuple] = []

            def block():
                nonlocal at
                data = zlib.compress("\n".join(json.dumps([x[0].decode(), *x[1:]]) for x in held).encode(), 6)
                directory.append([held[0][0].decode(), at, len(data)])
                at += len(data)
                return data

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.append(row)
                    if len(held) == lines:
                        yield block()
                        held = []
            if held:
                yield block()
            if directory:
                first = directory[0][0]
                data = zlib.compress(json.dumps(directory).encode(), 6)
                yield data
                yield struct.pack(_TAIL, at, len(data))

        _write(folder, name, blocks())
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([name])], names=["first", "file"])

    files = storage.written(ranged.mapInArrow(run, "first string, file string"), "index")
    return sorted(((r["first"].encode(), r["file"]) for r in files.collect()), key=lambda x: x)


@lru_cache(maxsize=2)
def _directory(folder: str, name: str) -> tuple[list[bytes], list[list]]:
    system, base = _system(folder)
    size = system.get_file_info(f"{base}/{name}").size
    at, length = struct.unpack(_TAIL, _range(folder, name, size - struct.calcsize(_TAIL), struct.calcsize(_TAIL)))
    rows = json.loads(zlib.decompress(_range(folder, name, at, length)))
    return [r[0].encode() for r in rows], rows


@lru_cache(maxsize=4)
def _block(folder: str, name: str, at: int, length: int) -> tuple[list[bytes], list[list]]:
    rows = [json.loads(x) for x in zlib.decompress(_range(folder, name, at, length)).decode().split("\n")]
    return [r[0].encode() for r in rows], rows


def find(folder: str, files: list[tuple[bytes, str]], line: bytes):
    """Captures (file, offset, length) whose line equals ``line``, by binary searches."""
    k = max(0, bisect.bisect_left(files, (line, "")) - 1)
    while k < len(files) and files[k][0] <= line:
        firsts, rows = _directory(folder, files[k][1])
        b = max(0, bisect.bisect_left(firsts, line) - 1)
        while b < len(firsts) and firsts[b] <= line:
            keys, own = _block(folder, files[k][1], rows[b][1], rows[b][2])
            i = bisect.bisect_left(keys, line)
            while i < len(keys) and keys[i] == line:
                yield own[i][1], own[i][2], own[i][3]
                i += 1
            b += 1
        k += 1


def read_captures(wanted: DataFrame, folder: str, files: list[tuple[bytes, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """Reads the records of (url, key) pairs back through the index.

    Repeated pairs are looked up once; every record found gives a row. Wanted lines are
    range-partitioned like the index, so that neighbours share a block. Returns the
    key as text, ``record_type``, ``payload``, ``payload_bytes``, ``payload_digest`` (of a
    response computed from what was read) and ``refers_to`` as text.
    """
    pairs = wanted.select(F.col(key).cast("string").alias("key"), F.col(url).alias("url")).distinct()
    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # records are far larger than the pairs that Spark would coalesce by
    ranged = pairs.repartitionByRange(parts, F.reverse(F.split(F.regexp_extract("url", "^[^:]*://([^/:?#]*)", 1), "\\.")), "url", "key").sortWithinPartitions("url", "key")
    ranged.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for key, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for file, offset, length in find(folder, files, _line(url_key(url), key).encode()):
                    headers, http, payload = parse(_range(folder, file, offset, length))
                    kind, refers = headers["WARC-Type"], headers.get("WARC-Refers-To")
                    if kind == "response":
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    else:
                        size, digest = int(http["Content-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    out.append((headers["WARC-Record-ID"][1:-1].removeprefix(_ID) or None, kind, payload if kind == "response" else None, size, digest, refers and refers[1:-1].removeprefix(_ID)))
                    held += len(payload)
                    if held > 8 << 20:
                        yield _batch(out)
                        out, held = [], 0
            if out:
                yield _batch(out)

    return ranged.mapInArrow(run, "key string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html") -> tuple[str, list[tuple[bytes, str]]]:
    """Writes archives and index of a table; returns their folder and the index files."""
    folder = folder or storage.scratch(spark, "warc")
    captures = write_archives(mark_revisits(pages, key, url, payload), folder)
    return folder, write_index(captures, folder)
