"""WARC archives of web pages and a two-level index of their captures.

Every page is one record, a compressed member of a ``.warc.gz`` file of its own length, so that a record can be read without the rest of its file.
The index lists captures by reversed-host URL key (``com,example,www)/path``). Sorted lines are cut into compressed blocks; the sparse
directory keeps the first and the last key of each block. A lookup finds its blocks by binary search in the directory, its lines by binary search in
the block, and reads just those byte ranges.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questlog.session import materialise, scratch_path

ARCHIVE_BYTES = 128 << 20
BLOCK_LINES = 3_000
DIRECTORY_ENTRIES = 65_536
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 4


def file_system(uri: str) -> tuple[FileSystem, str]:
    """The file system of a folder that driver and executors share, and the path on it."""
    if uri.startswith("/"):
        return LocalFileSystem(), uri
    return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: Column) -> Column:
    """Reversed host, ``)``, then path and query; scheme, port and fragment are left out. What is no URL is its own key; null is empty."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(F.substring(rest, 1, 1) == "/", rest).otherwise(F.concat(F.lit("/"), rest)))
    return F.coalesce(F.when(host == "", url).otherwise(key), F.lit(""))


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """`pages` (page_id, url, html) as page_id, url, html, refers_to: the smallest page_id of equal payloads of at least `min_bytes`, null for that page itself.

    Payloads are compared by SHA-1 and length on narrow rows; pages then meet only the list of revisits. Pages without id are never revisits.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    narrow = materialise(pages.select("page_id", F.sha1(payload.cast("binary")).alias("sha1"), F.octet_length(payload).alias("bytes"))
                         .filter((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull()))
    firsts = materialise(narrow.groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    revisits = materialise(narrow.join(firsts, ["sha1", "bytes"]).filter("page_id <> first").select("page_id", "sha1", F.col("first").alias("refers_to")).distinct())
    return pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("sha1")).join(revisits, ["page_id", "sha1"], "left").select("page_id", "url", "html", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its HTTP head and payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("X-Payload-Length", str(len(payload))),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return f"{VERSION}\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record back into its fields: page_id, url, record_type, payload (of a response), payload_bytes, payload_digest, refers_to. Raises on a damaged record."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    if version != VERSION:
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    named = dict(line.split(": ", 1) for line in lines)
    size = int(named["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("record length does not hold")
    number = lambda k: int(x) if (x := named.get(k, "")[10:-1]) else None
    out = {"page_id": number("WARC-Record-ID"), "url": named.get("WARC-Target-URI"), "record_type": named["WARC-Type"], "payload": None,
           "payload_bytes": int(named["X-Payload-Length"]), "payload_digest": named["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number("WARC-Refers-To")}
    if out["record_type"] == "response":
        out["payload"] = block.partition(b"\r\n\r\n")[2]
        if len(out["payload"]) != out["payload_bytes"] or payload_digest(out["payload"]) != out["payload_digest"]:
            raise ValueError("payload does not match its digest")
    return out


def _compress(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: datetime = datetime(2024, 1, 1, tzinfo=timezone.utc)) -> DataFrame:
    """Write `pages` (page_id, url, html, refers_to) as archives below `folder` and return (key, page_id, file, offset, length), written to the shared folder.

    Each task attempt writes files of its own name, and only the names of committed attempts are in the result, so tasks may be repeated.
    """
    stamp = date.strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        number, sink, name, at = 0, None, "", 0
        try:
            for batch in batches:
                rows: dict[str, list] = {"key": [], "page_id": [], "file": [], "offset": [], "length": []}
                for key, page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "url", "html", "refers_to")), strict=True):
                    if sink is None or at >= archive_bytes:
                        if sink is not None:
                            sink.close()
                        name, at = f"{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz", 0
                        sink, number = fs.open_output_stream(f"{root}/{name}", compression=None), number + 1
                    data = _compress(record(page_id, url, (html or "").encode(), refers_to, stamp))
                    sink.write(data)
                    for c, v in zip(rows, (key, page_id, name, at, len(data)), strict=True):
                        rows[c].append(v)
                    at += len(data)
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))
        finally:
            if sink is not None:
                sink.close()

    rows = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"), "url", "html", F.col("refers_to").cast("long").alias("refers_to"))
    return materialise(rows.mapInArrow(write, "key string, page_id long, file string, offset long, length long"))


def build_index(captures: DataFrame, lines: int | None = None) -> DataFrame:
    """Blocks (block, first_key, last_key, lines, data) of the captures in order of key and page_id, written to the shared folder.

    A block has `lines` lines, by default BLOCK_LINES or as many more as keep the directory at about DIRECTORY_ENTRIES blocks, which bounds its size.
    """
    lines = lines or max(BLOCK_LINES, -(-captures.count() // DIRECTORY_ENTRIES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, held = TaskContext.get().partitionId() << 32, 0, []

        def block() -> pa.RecordBatch:
            text = "\n".join(f"{json.dumps(k)}\t{f}\t{o}\t{n}" for k, f, o, n in held)
            return pa.RecordBatch.from_arrays([pa.array([base + number]), pa.array([held[0][0]]), pa.array([held[-1][0]]), pa.array([len(held)]), pa.array([zlib.compress(text.encode())], pa.binary())],
                                              names=["block", "first_key", "last_key", "lines", "data"])

        for batch in batches:
            for line in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                held.append(line)
                if len(held) >= lines:
                    yield block()
                    held, number = [], number + 1
        if held:
            yield block()

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    return materialise(ordered.mapInArrow(cut, "block long, first_key string, last_key string, lines long, data binary"))


def lookup(blocks: DataFrame, keys: DataFrame, folder: str) -> DataFrame:
    """The captured records of every distinct key in `keys` (column key): key, page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to.

    The directory (bounded by `build_index`) goes to every task; a key that runs over several blocks is looked for in each of them.
    """
    directory = blocks.select("first_key", "last_key", "block").toArrow().to_pylist()
    directory.sort(key=lambda r: (r["first_key"].encode(), r["last_key"].encode()))
    firsts, lasts, numbers = [r["first_key"].encode() for r in directory], [r["last_key"].encode() for r in directory], [r["block"] for r in directory]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, block = [], []
            for k in batch.column(0).to_pylist():
                raw = k.encode()
                for n in numbers[bisect_left(lasts, raw):bisect_right(firsts, raw)]:
                    key.append(k)
                    block.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(block, pa.int64())], names=["key", "wanted"])

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            lines = [line.split("\t") for line in zlib.decompress(right.column("data")[0].as_py()).decode().split("\n")]
            names = [json.loads(x[0]).encode() for x in lines]
            for k in left.column("key").to_pylist():
                raw = k.encode()
                found += [(x[1], int(x[2]), int(x[3]), k) for x in lines[bisect_left(names, raw):bisect_right(names, raw)]]
        fs, root = file_system(folder)
        found.sort()
        rows, name, source = [], None, None
        try:
            for file, offset, length, k in found:
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{root}/{file}")
                rows.append({"key": k, **parse(zlib.decompress(source.read_at(length, offset), 31))})
        finally:
            if source is not None:
                source.close()
        return pa.Table.from_pylist(rows, RECORDS)

    wanted = keys.select("key").distinct().mapInArrow(find, "key string, wanted long")
    return wanted.groupBy("wanted").cogroup(blocks.select("block", "data").groupBy("block")).applyInArrow(
        read, "key string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


RECORDS = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Archive `pages` (page_id, url, html; other columns are left), index the archives, and read every record back through the index.

    A null html is an empty payload, a null url has the empty key and no target, a null page_id is kept as null and is always a response; repeated rows
    are a record each (the smallest page_id of a payload is a response as often as it occurs). An empty table gives an empty result. `folder` must be
    shared by driver and executors (default: a new one in the checkpoint folder).
    """
    folder = folder or scratch_path(pages.sparkSession)
    captures = write_archives(with_roles(pages, min_bytes), folder)
    return lookup(build_index(captures), pages.select(url_key(F.col("url")).alias("key")), folder)
