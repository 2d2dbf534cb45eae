"""WARC archives with a two-level capture index.

Write: each partition of the pages becomes archive files of gzip members, one per record; pages never cross a shuffle but
for a join of their digests (no payload) that finds the first of equal payloads. Of those the page with the smallest id
is a response record and the others are revisits that refer to it and carry no payload.

Index: one line per record (reversed-host URL key, page id, archive, offset, length), range-sorted and cut into blocks of
BLOCK lines, each compressed by itself; a sparse directory beside each index file holds the first key, offset and length of its blocks.
A host with a third of all captures is many blocks, since the order is by key and page id.

Read: keys to look up are range-sorted likewise. A task binary-searches the directory for the file and block, reads that
range, and binary-searches the lines in it. What it finds (archive, offset, length) is sorted by archive and offset, and
the archives are read in that order, range by range.

Files are written through pyarrow's file systems under a name of their own and then moved to the final name, so a task
that is run again, or by two executors at once, leaves the same file.

Defined results: a null html counts as empty; a null url has an empty key; equal pages (same id, same payload) are all
responses if that id is the smallest of its payload, for they are one capture; an empty table gives no archives and an
empty result; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, sized, stored, table

#: Payloads of fewer bytes are never revisits; lines of a block of the index; bytes after which an archive is closed.
MIN_BYTES, BLOCK, ARCHIVE_BYTES = 0, 3000, 256 << 20
LINES = "key string, page_id long, file string, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def file_system(path: str):
    """(file system, path in it); a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(re.sub(r"^(file:)?/*", "file:///", path))


def url_key(url: str | None) -> str:
    """org,example,www)/path?query: host reversed, lower case, without port 80 or 443 and a leading www; empty for null."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip().lower() + ")"
    host = re.sub(r"^www\d*\.", "", host)
    tail = (parts.path or "/").lower() + ("?" + "&".join(sorted(parts.query.lower().split("&"))) if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (tail if tail == "/" else tail.rstrip("/") or "/")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, sha: str, refers_to) -> bytes:
    """A gzip member with one record."""
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse(raw: bytes) -> tuple[dict, bytes]:
    """(header fields in lower case, payload) of a record."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record begins here")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("the record is cut short")
    return fields, block.partition(b"\r\n\r\n")[2]


def _moved(fs, temp: str, final: str) -> None:
    """temp under its final name; where a run before has put that there, it holds the same."""
    fs.move(temp, final)


class _Archive:
    """Files name-00000.warc.gz, ... of one partition."""

    def __init__(self, folder: str, name: str, attempt: str, most: int):
        (self.fs, self.folder), self.name, self.attempt, self.most, self.n, self.out = file_system(folder), name, attempt, most, -1, None

    def put(self, raw: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at + len(raw) > self.most and self.at:
            self.close()
            self.n, self.at, self.final = self.n + 1, 0, f"{self.name}-{self.n + 1:05d}.warc.gz"
            self.temp = f"{self.folder}/.{self.final}.{self.attempt}"
            self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.out.write(raw)
        self.at += len(raw)
        return self.final, self.at - len(raw), len(raw)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            _moved(self.fs, self.temp, f"{self.folder}/{self.final}")
            self.out = None


def _made(folder: str) -> str:
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    return folder


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    named = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named, strict=True)], names=[n for n, _ in named])


def capture_plan(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, sha (hex), refers_to: which record each page becomes."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha1(F.encode(body, "UTF-8")).alias("sha"), F.octet_length(body).alias("n"))
    first = rows.where(F.col("n") >= min_bytes).groupBy("n", "sha").agg(F.min("page_id").alias("first"), F.count("*").alias("same")).where("same > 1").drop("same")
    first = sized(stored(first, "first-captures"))
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, ["n", "sha"], "left").select("page_id", "url", "html", "sha", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives under folder; LINES of all records, not in order."""
    _made(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        archive = _Archive(folder, f"part-{task.partitionId():06d}", str(task.taskAttemptId()), archive_bytes)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                lines = []
                for page_id, url, html, sha, refers_to in zip(*(c.to_pylist() for c in batch.slice(lo, 1000).columns), strict=True):
                    b32 = base64.b32encode(bytes.fromhex(sha)).decode()
                    lines.append((url_key(url), page_id, *archive.put(record(page_id, url, html.encode(), b32, refers_to))))
                yield _batch(LINES, list(map(list, zip(*lines, strict=True))))
        archive.close()

    return stored(capture_plan(pages, min_bytes).mapInArrow(write, LINES), "captures")


def write_index(lines: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Writes the index and its block directories under folder; first_key, first_id, file of each index file."""
    _made(folder)
    schema = "first_key string, first_id long, file string, blocks long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        (fs, path), name = file_system(folder), f"cdx-{task.partitionId():06d}"
        temp, at, held, out, blocks = f"{path}/.{name}.{task.taskAttemptId()}", 0, [], None, []

        def close_block():
            nonlocal at, out
            out = out or fs.open_output_stream(f"{temp}.gz", compression=None)
            raw = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
            out.write(raw)
            blocks.append((held[0][0], held[0][1], at, len(raw)))
            at += len(raw)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) >= block:
                    close_block()
        if held:
            close_block()
        if out:
            out.close()
            _moved(fs, f"{temp}.gz", f"{path}/{name}.gz")
            with fs.open_output_stream(f"{temp}.dir") as f:
                f.write(json.dumps(blocks).encode())
            _moved(fs, f"{temp}.dir", f"{path}/{name}.dir")
            yield _batch(schema, [[blocks[0][0]], [blocks[0][1]], [name], [len(blocks)]])

    n = lines.rdd.getNumPartitions()
    ordered = lines.repartitionByRange(n, F.col("key"), F.col("page_id")).sortWithinPartitions("key", "page_id", "file", "offset")
    return stored(ordered.mapInArrow(write, schema), "index-files")


def lookup(wanted: DataFrame, files: DataFrame, index: str) -> DataFrame:
    """LINES of the captures with the keys and page ids in wanted (key, page_id), and of nothing else.

    Every task is given the first key of each index file (one row per partition of the index). It searches those, reads
    the block directory of the file it needs, searches that, and reads and unpacks one block; since the keys it looks up
    are in order, each block is read once.
    """
    low = -(2**63)
    rows = sorted((r["first_key"], low if r["first_id"] is None else r["first_id"], r["file"]) for r in files.collect())
    sent = wanted.sparkSession.sparkContext.broadcast(([r[:2] for r in rows], [r[2] for r in rows]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, names = sent.value
        fs, path = file_system(index)
        held: dict = {}

        def kept(key, make):
            if key not in held:
                while len(held) > 5:
                    held.pop(next(iter(held)))
                held[key] = make()
            return held[key]

        def directory(name: str):
            with fs.open_input_stream(f"{path}/{name}.dir") as f:
                blocks = json.loads(f.read())
            return [(k, low if p is None else p) for k, p, *_ in blocks], [tuple(b[2:]) for b in blocks]

        def block(name: str, offset: int, length: int):
            with fs.open_input_file(f"{path}/{name}.gz") as f:
                lines = [json.loads(x) for x in zlib.decompress(f.read_at(length, offset)).split(b"\n")]
            return [(k, low if p is None else p) for k, p, *_ in lines], lines

        def captures(at):
            i = max(0, bisect.bisect_left(firsts, at) - 1)
            while i < len(firsts) and firsts[i] <= at:  # repeated captures may go on into the next block or file
                starts, places = kept(names[i], lambda: directory(names[i]))
                b = max(0, bisect.bisect_left(starts, at) - 1)
                while b < len(starts) and starts[b] <= at:
                    keys, lines = kept((names[i], b), lambda: block(names[i], *places[b]))
                    j = bisect.bisect_left(keys, at)
                    while j < len(keys) and keys[j] == at:
                        yield lines[j]
                        j += 1
                    b += 1
                i += 1

        for batch in batches:
            out = [x for key, page_id in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in captures((key, low if page_id is None else page_id))]
            if out:
                yield _batch(LINES, list(map(list, zip(*out, strict=True))))

    n = wanted.rdd.getNumPartitions()
    ordered = wanted.distinct().repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.select("key", "page_id").mapInArrow(find, LINES)


def read_records(lines: DataFrame, archives: str, with_payload: bool = False) -> DataFrame:
    """RECORDS at the given places (with_payload: and html), read in the order of archive and offset.

    A revisit's payload_bytes are null here; its digest is that of its header.
    """
    schema = RECORDS + ", html string" * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(archives)
        name, f = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                out = []
                for file, offset, length in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns), strict=True):
                    if file != name:
                        if f is not None:
                            f.close()
                        name, f = file, fs.open_input_file(f"{path}/{file}")
                    fields, payload = parse(f.read_at(length, offset))
                    number = lambda x: int(m[1]) if (m := re.search(r":page:(-?\d+)>", fields.get(x, ""))) else None  # noqa: B023, E731
                    sha, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    if kind == "response" and digest(payload) != sha:
                        raise ValueError(f"{file} at {offset}: the payload has another digest")
                    row = (number("warc-record-id"), fields["warc-target-uri"], len(payload) if kind == "response" else None, sha, kind, number("warc-refers-to"))
                    out.append(row + ((payload.decode() if kind == "response" else None),) * with_payload)
                yield _batch(schema, list(map(list, zip(*out, strict=True))))
        if f is not None:
            f.close()

    n = lines.rdd.getNumPartitions()
    ordered = lines.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.select("file", "offset", "length").mapInArrow(read, schema)


def with_full_payload(records: DataFrame) -> DataFrame:
    """Revisits with the payload_bytes of the response that they refer to; a revisit without its response is an error."""
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("_n")).distinct()
    named = records.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    responses = sized(stored(responses.join(named, ["refers_to", "payload_digest"], "left_semi"), "responses"))
    joined = records.join(responses, ["refers_to", "payload_digest"], "left")
    n = F.coalesce("payload_bytes", "_n", F.raise_error(F.concat(F.lit("no response for revisit "), F.col("page_id").cast("string"))).cast("long"))
    return joined.select("page_id", "url", n.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES, block: int = BLOCK) -> DataFrame:
    """Writes pages to archives and an index under folder, and reads every capture back through the index."""
    folder = folder or new_path(pages.sparkSession, "warc")
    lines = write_archives(pages, f"{folder}/archive", min_bytes, archive_bytes)
    files = write_index(lines, f"{folder}/index", block)
    found = stored(lookup(lines.select("key", "page_id"), files, f"{folder}/index"), "found")
    return with_full_payload(stored(read_records(found, f"{folder}/archive"), "records"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("url")


OP9_SQL = """
WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
h AS (SELECT page_id, octet_length(p) AS payload_bytes, sha1(p) AS sha, min(page_id) OVER (PARTITION BY p) AS first FROM d),
bits AS (SELECT *, [substr('0000' || bin(('0x' || c)::INT), -4) FOR c IN string_split(sha, '')] AS b FROM h)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum([substr(array_to_string(b, ''), 1 + 5 * i + j, 1)::INT * (16 >> j) FOR j IN range(5)])::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""
