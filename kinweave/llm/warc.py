"""WARC archives with a two-level capture index.

Archives hold a gzip member per record, in no particular order. The index is sorted by URL key (host reversed, then the
path) and page id and lies in shards of key ranges; a shard holds compressed blocks of lines and, at its end, a sparse
directory with each block's first key. A lookup finds the shards by their key ranges, searches the directory, reads and
unpacks one block (or a few for a key that fills several), searches that, and reads the records by their byte ranges.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_store, partitions, put, scratch, stored, table

DATE = "2024-01-01T00:00:00Z"  # written where a page has no date of its own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 512
NEAR = 256 << 10  # bytes between two records up to which one read fetches both


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: com,example,www:8080)/path?query; without blanks or control characters; "-" for none."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return ")" + quote(url, safe="/:?#&=%~+,;@!$'()*[]")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + quote(rest, safe="/:?#&=%~+,;@!$'()*[]")


# Records.


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, same: bool = False) -> bytes:
    """A WARC record. ``same``: the payload stands in the response of page ``refers_to``; this record has its length and digest only."""

    def name(i: int | None, digest: str) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}')}>"

    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "revisit" if same else "response"), ("WARC-Record-ID", name(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    if page_id is not None:
        head.append(("X-Page-ID", page_id))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if same:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to)]
    else:
        block += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of a record, HTTP headers and payload; raises if the record isn't whole or its payload has another digest."""

    def fields(text: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in text.decode().split("\r\n")[1:])

    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    head = fields(head)
    n = int(head["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    if head["WARC-Type"] == "response" and head["WARC-Payload-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError(f"the payload of {head['WARC-Record-ID']} has another digest")
    return head, fields(http), payload


def packed(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Archive:
    """Writes an archive under a temporary name; ``close`` moves it into place."""

    def __init__(self, uri: str):
        self.uri, (self._fs, self._path) = uri, open_store(uri)
        self._fs.create_dir(self._path.rpartition("/")[0], recursive=True)
        self._draft = f"{self._path}.{uuid.uuid4().hex}.part"
        self._out, self.size, self.entries = self._fs.open_output_stream(self._draft), 0, []

    def add(self, key: str, page_id: int | None, raw: bytes) -> None:
        data = packed(raw)
        self._out.write(data)
        self.entries.append((key, page_id, self.uri, self.size, len(data)))
        self.size += len(data)

    def close(self) -> list[tuple]:
        self._out.close()
        self._fs.move(self._draft, self._path)
        return self.entries


ENTRY = "key string, page_id long, path string, at long, length long"


def entries_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in ENTRY.split(", ")])


def write_archives(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row; returns the index entries (ENTRY).

    Of rows with equal payloads of ``min_bytes`` or more, those with the largest id (nulls are least) are responses, the
    others revisit it; smaller payloads are all responses. A null payload is empty. Payloads move once, to meet the
    largest id of their digest; a frequent payload's rows can be split, as that side of the join has one row a digest.
    Rows with equal ids and payloads are records of their own, responses all where theirs is the largest id. Payloads of
    any length are written whole. Ids are whole numbers, or text that spells one; any other is an error. A null url has a key of its own. Other columns are
    not read. An empty table gives no archives and no entries.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.length("payload") >= min_bytes, F.unhex(F.sha1("payload"))))
    best = rows.groupBy("digest").agg(F.max("id").alias("best"), F.count("*").alias("n")).where("n > 1 and digest is not null").drop("n")
    rows = rows.join(best, "digest", "left")
    same = F.col("best").isNotNull() & ~F.col("id").eqNullSafe(F.col("best"))
    rows = rows.select("id", "url", "payload", F.when(same, F.col("best")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, archive, seq = TaskContext.get(), None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to = (batch.column(k)[i].as_py() for k in range(4))
                if archive is None:
                    archive = Archive(f"{out_dir}/{context.stageId()}-{context.partitionId():06d}-{seq:04d}-{context.taskAttemptId()}.warc.gz")
                archive.add(url_key(url), page_id, record(page_id, url, payload, refers_to, refers_to is not None))
                if archive.size >= archive_bytes:
                    yield entries_batch(archive.close())
                    archive, seq = None, seq + 1
        if archive is not None:
            yield entries_batch(archive.close())

    return stored(rows.mapInArrow(write, ENTRY), "warc-entries")


# Index.


class IndexShard:
    """Reads a shard: its directory first, then blocks as they are needed (the last one read is kept)."""

    def __init__(self, uri: str):
        fs, path = open_store(uri)
        self._in = fs.open_input_file(path)
        size = self._in.size()
        at, n = struct.unpack("<QQ", self._in.read_at(16, size - 16))
        self.directory = json.loads(zlib.decompress(self._in.read_at(n, at)))
        self.firsts = [d[0] for d in self.directory]
        self._kept: tuple[int, list[list]] = (-1, [])

    def block(self, k: int) -> list[list]:
        if self._kept[0] != k:
            _, at, n = self.directory[k]
            self._kept = (k, [json.loads(x) for x in zlib.decompress(self._in.read_at(n, at)).split(b"\n")])
        return self._kept[1]

    def find(self, key: str) -> Iterator[list]:
        """Entries of a key."""
        for k in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            lines = self.block(k)
            keys = [x[0] for x in lines]
            yield from lines[bisect_left(keys, key) : bisect_right(keys, key)]


def shard_bytes(lines: list[tuple], block_lines: int = BLOCK_LINES) -> list[bytes]:
    out, directory, at = [], [], 0
    for i in range(0, len(lines), block_lines):
        data = zlib.compress(b"\n".join(json.dumps(x, separators=(",", ":")).encode() for x in lines[i : i + block_lines]))
        directory.append((lines[i][0], at, len(data)))
        out.append(data)
        at += len(data)
    end = zlib.compress(json.dumps(directory).encode())
    return [*out, end, struct.pack("<QQ", at, len(end))]


SHARD = "first string, last string, path string, n long"
SHARD_LINES = 500_000


def write_index(entries: DataFrame, out_dir: str, n_shards: int | None = None) -> DataFrame:
    """Sort index entries into shards; returns one row per shard (SHARD). A task that gets many lines writes several shards."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, lines, seq = TaskContext.get(), [], 0

        def close() -> pa.RecordBatch:
            path = f"{out_dir}/{context.partitionId():06d}-{seq:04d}-{context.taskAttemptId()}.idx"
            put(path, shard_bytes(lines))
            return pa.RecordBatch.from_pydict({"first": [lines[0][0]], "last": [lines[-1][0]], "path": [path], "n": [len(lines)]})

        for batch in batches:
            lines += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(lines) >= SHARD_LINES:
                yield close()
                lines, seq = [], seq + 1
        if lines:
            yield close()

    rows = entries.repartitionByRange(n_shards or partitions(entries.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id")
    return stored(rows.mapInArrow(write, SHARD), "warc-shards")


def find_captures(shards: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Index entries (ENTRY) of every distinct URL in ``urls``, found by search in shards, directories and blocks.

    The driver holds the shards' key ranges: one short row for some hundred thousand captures.
    """
    ranges = sorted((r["first"], r["last"], r["path"]) for r in shards.collect())
    firsts = [r[0] for r in ranges]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, IndexShard] = {}
        for batch in batches:
            found = []
            for key in sorted({url_key(u) for u in batch.column(0).to_pylist()}):
                for i in range(bisect_right(firsts, key) - 1, -1, -1):
                    if ranges[i][1] < key:
                        break
                    path = ranges[i][2]
                    if path not in opened:
                        opened = {path: IndexShard(path), **dict(list(opened.items())[:1])}
                    for x in opened[path].find(key):
                        found.append(tuple(x))
                        if len(found) >= 10_000:
                            yield entries_batch(found)
                            found = []
            if found:
                yield entries_batch(found)

    # Different URLs may have one key; they meet in one task, and a set there keeps the key once.
    keys = urls.select(url_col).distinct().select(url_col, F.lower(F.substring_index(F.regexp_replace(F.coalesce(F.trim(url_col), F.lit("")), "^[^:]*://", ""), "#", 1)).alias("near"))
    return keys.repartitionByRange(partitions(urls.sparkSession), "near").sortWithinPartitions("near").mapInArrow(find, ENTRY).dropDuplicates(["path", "at"])


CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_captures(entries: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records (CAPTURE) that index entries tell of: read by byte ranges, those that lie near each other at once."""

    def rows_of(fs_cache: dict, path: str, some: list[tuple[int, int]]) -> list[tuple]:
        if path not in fs_cache:
            fs_cache.clear()
            fs, p = open_store(path)
            fs_cache[path] = fs.open_input_file(p)
        begin = some[0][0]
        data = fs_cache[path].read_at(some[-1][0] + some[-1][1] - begin, begin)
        out = []
        for at, n in some:
            head, http, payload = parse(zlib.decompress(data[at - begin : at - begin + n], 31))
            number = lambda k, h=head: int(h[k]) if k in h else None
            out.append((number("X-Page-ID"), int(http["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], number("X-Refers-To-Page-ID"), head.get("WARC-Target-URI"), payload if with_payload and head["WARC-Type"] == "response" else None))
        return out

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in CAPTURE.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            some, where = [], None
            for path, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if some and (path != where or at - sum(some[-1]) > NEAR or at - some[0][0] > 16 * NEAR):
                    yield batch_of(rows_of(opened, where, some))
                    some = []
                where = path
                some.append((at, n))
            if some:
                yield batch_of(rows_of(opened, where, some))

    n = 4 * partitions(entries.sparkSession)
    rows = entries.select("path", "at", "length", F.shiftright("at", 22).alias("part")).repartition(n, "path", "part").sortWithinPartitions("path", "at")
    return rows.select("path", "at", "length").mapInArrow(read, CAPTURE)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, out = table(spark, sf_dir, "pages"), scratch(spark, "warc")
    shards = write_index(write_archives(pages, f"{out}/archives"), f"{out}/index")
    return read_captures(find_captures(shards, pages), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
