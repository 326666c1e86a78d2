"""WARC archives and their index, merged from locally sorted capture runs.

Writing: every task writes archives of gzipped WARC records into the shared
folder, a name of its own for each attempt, so that a repeated task never
touches what another has written; only archives whose task succeeded are
listed. Of equal payloads the page of the smallest id is a response and the
others are revisits of it.

Reading: each archive is streamed record by record into one capture run, sorted
by URL key and time. Runs are dealt out by ranges of (URL key, time, page), so
each range receives a slice of every run, and a loser tree merges the slices;
the ranges in order are the capture history of all pages.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_folder, slices, table

#: A payload shorter than this is always stored.
REVISIT_BYTES = 100
#: Size at which a task goes on with another archive.
ARCHIVE_BYTES = 256 << 20
#: Captures of a range that is merged in one task, about.
RANGE_ROWS = 200_000
#: Repeated digests that may be broadcast; with more, pages and digests meet in a shuffle.
BROADCAST_ROWS = 50_000

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def url_key(url: str | None) -> str:
    """Sort-friendly key of a URL: host labels reversed, then path and query, without scheme, port and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return url
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


class LoserTree:
    """Merges sorted iterators: each inner node holds the loser of its match, so a next item costs one path to the root."""

    def __init__(self, runs: Iterable[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        k = len(self.runs)
        self.head: list[tuple | None] = [next(r, None) for r in self.runs]
        self.loser = [-1] * k
        winners = [-1] * (2 * k)
        winners[k:] = range(k)
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.loser[node] = (a, b) if self._before(a, b) else (b, a)
        self.best = winners[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None
        return (x, a) <= (y, b)

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while k and self.head[self.best] is not None:
            at = self.best
            yield self.head[at]
            self.head[at] = next(self.runs[at], None)
            node, winner = (k + at) // 2, at
            while node >= 1 and k > 1:
                if not self._before(winner, self.loser[node]):
                    winner, self.loser[node] = self.loser[node], winner
                node //= 2
            self.best = winner


def _filesystem(folder: str):
    """The store of a folder as executors reach it without a JVM: local and shared mounts, hdfs with its client library, S3, GCS and ABFS."""
    from pyarrow import fs

    if folder.startswith(("s3a://", "s3n://")):
        folder = "s3://" + folder[6:]
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder)


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, seconds: int) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {(_EPOCH + timedelta(seconds=seconds)).strftime('%Y-%m-%dT%H:%M:%SZ')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, "WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, listed = None, []
        for part in slices(batches, 64):
            for page_id, url, html, digest, revisit, refers_to, seconds in zip(*(c.to_pylist() for c in part.columns)):
                if out is None or out.tell() >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    disk, root = _filesystem(folder)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = disk.open_output_stream(f"{root}/{name}", compression=None)
                    listed.append(name)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                record = _record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to, revisit, seconds)
                out.write(pack.compress(record) + pack.flush())
        if out is not None:
            out.close()
        if listed:
            yield pa.RecordBatch.from_arrays([pa.array(listed)], names=["archive"])

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html, captured) to archives in ``folder``; their names."""
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(text, 256).alias("digest"), F.octet_length(text).alias("n"), F.unix_seconds("captured").alias("seconds"))
    groups = rows.filter(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = cut(groups.filter("copies > 1 and first is not null").select(F.col("digest").alias("g"), "first"))
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    joined = rows.join(groups, F.col("digest") == F.col("g"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    records = joined.select("page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"), F.coalesce("seconds", F.lit(0)).alias("seconds"))
    return cut(records.mapInArrow(_write(folder), "archive string"))


def records(folder: str, archive: str) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, block, offset) of each record of an archive, streamed."""
    disk, root = _filesystem(folder)
    with disk.open_input_stream(f"{root}/{archive}", compression=None) as source:
        offset, rest = 0, b""
        while True:
            unpack, record, used = zlib.decompressobj(31), [], 0
            while not unpack.eof:
                chunk = rest or source.read(1 << 18)
                if not chunk:
                    if used:
                        raise ValueError(f"{archive} ends within a record")
                    return
                record.append(unpack.decompress(chunk))
                used += len(chunk) - len(unpack.unused_data)
                rest = unpack.unused_data
            head, _, body = b"".join(record).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            yield headers, body[: int(headers["Content-Length"])], offset
            offset += used


def _capture(headers: dict[str, str], block: bytes) -> tuple:
    """(url key, date, page_id, payload bytes, digest, type, refers_to) of a record, its payload verified."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().rsplit("Content-Length: ", 1)[1])
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    number = lambda name: int(x) if (x := headers[name][len("<urn:page:") : -1]) else None
    return url_key(headers.get("WARC-Target-URI")), headers["WARC-Date"], number("WARC-Record-ID"), size, digest, kind, number("WARC-Refers-To") if kind == "revisit" else None


_CAPTURE = "run string, place long, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long"
_NAMES = [c.split()[0] for c in _CAPTURE.split(", ")]
_KINDS = [pa.string() if "string" in c else pa.int64() for c in _CAPTURE.split(", ")]


def _order(capture: tuple) -> tuple:
    return capture[0], capture[1], capture[2] is None, capture[2] or 0


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 4096]), _KINDS)], names=_NAMES)


def _runs(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                captures = [(*_capture(h, b), offset) for h, b, offset in records(folder, archive)]
                captures.sort(key=_order)
                yield from _batches([(archive, i, *c) for i, c in enumerate(captures)])

    return read


def _stretches(batches: Iterator[pa.RecordBatch]) -> dict[str, list[pa.RecordBatch]]:
    """By run, its rows in order, left in the batches that brought them."""
    found: dict[str, list[pa.RecordBatch]] = {}
    for batch in (b for b in batches if b.num_rows):
        code = batch.column(0).dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.diff(code, prepend=-1)).tolist()
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            found.setdefault(batch.column(0)[lo].as_py(), []).append(batch.slice(lo, hi - lo))
    return found


def _captures(stretches: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The captures of a run as a merge compares them, few of them Python objects at a time."""
    for part in slices(iter(stretches), 64):
        for row in zip(*(c.to_pylist() for c in part.columns)):
            yield _order(row[2:]), row[0], row[1], row


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Loser-tree merge of the slices of runs that came to this range, each in its order."""
    runs = _stretches(batches)
    merged, part = LoserTree(_captures(runs[name]) for name in sorted(runs)), []
    for *_, row in merged:
        part.append(row)
        if len(part) == 4096:
            yield from _batches(part)
            part = []
    yield from _batches(part)


def capture_histories(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """All captures of the listed archives, ordered by URL key, time and page over all partitions."""
    runs = cut(archives.mapInArrow(_runs(folder), _CAPTURE))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    # blocks of a run arrive in any order; Spark's sort, which spills, brings each run back into its own
    placed = runs.repartitionByRange(ranges, "url_key", "captured", "page_id").sortWithinPartitions("run", "place")
    return placed.mapInArrow(_merge, _CAPTURE)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html and, if known, captured) to archives and read them back as capture histories.

    A null html is an empty payload; a null url has an empty key. A null page_id
    is never the response that others refer to, unless all copies have none:
    then each is a response. Repeated rows of the smallest id are responses all.
    An empty table writes no archive and gives an empty result. Without a column
    ``captured`` (timestamp), the page id stands in for the seconds. Other
    columns are not read.
    """
    if "captured" not in pages.columns:
        pages = pages.select("page_id", "url", "html", F.timestamp_seconds(F.coalesce(F.pmod(F.col("page_id"), F.lit(1 << 32)), F.lit(0))).alias("captured"))
    folder = shared_folder(pages.sparkSession, f"warc-{uuid.uuid4().hex}")
    return capture_histories(pages.sparkSession, write_archives(pages, folder), folder)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages and read the archives back."""
    return warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERY = ("op2_warc", op2_warc)

ORACLE = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN g ON payload_digest = d
"""
