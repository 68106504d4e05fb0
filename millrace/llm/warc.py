"""Operator 2: WARC archives with revisit records and a globally ordered capture index.

Pages are written as gzip members, one record each, into archive segments of a stored table (any file
system Spark can write); ``archive_bytes`` gives the bytes of a segment as a .warc.gz file. Of payloads of
at least MIN_REVISIT bytes that are equal, the largest page id is the response and the others are
revisits that carry the HTTP head alone. Reading the segments back yields one capture per record;
each segment's captures are a run sorted by URL key and time, stored in the shared folder. Runs are cut at the borders of a range
partitioning and merged in each range by a loser tree, so (range_no, position) orders all captures of all URLs.

A hot payload costs one row per partial aggregate, a hot URL key is cut by time and page id. Capture times are not in the table: a page's is made from its id (``stamp``). Null html
and url count as empty; a null page id is always a response; rows that repeat an id and payload are
all responses if that id is the largest.
"""

from __future__ import annotations

import hashlib
import zlib
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hint_small, materialize, table

MIN_REVISIT = 1000
SEGMENT_BYTES = 4 << 20
#: Compressed bytes given to a member's decoder at a time.
FEED = 1 << 16
#: Captures of a range, about: what a merging task holds of all its runs.
RANGE_ROWS = 200_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> str:
    """Host labels reversed, then port, path and query; no scheme, 'www.' or fragment; lower case."""
    try:
        u = urlsplit(url if "//" in url else "//" + url)
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return url.lower()
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + ("" if port in (None, 80, 443) else f":{port}")
    return (key + ")" + (u.path or "/") + ("?" + u.query if u.query else "")).lower()


def stamp(page_id: int | None) -> str:
    import datetime

    at = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=(page_id or 0) % (1 << 28))
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id, url: str, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {url.translate(_ESCAPE)}",
        f"WARC-Date: {stamp(page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(body)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


#: Line ends cannot stand in a header line.
_ESCAPE = {10: "%0A", 13: "%0D"}


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes):
    """(offset, length, uncompressed record) of the gzip members in ``data``."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z, out, end = zlib.decompressobj(31), [], at
        while not z.eof:
            if end >= len(data):
                raise ValueError("truncated archive")
            out.append(z.decompress(view[end : end + FEED]))
            end = min(end + FEED, len(data))
        end -= len(z.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def parse(raw: bytes) -> dict:
    """The figures of one record; a response's payload is read and digested."""
    cut = raw.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in raw[:cut].decode().split("\r\n")[1:])
    block = raw[cut + 4 : cut + 4 + int(head["Content-Length"])]
    if raw[cut + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("bad record end")
    http_end = block.index(b"\r\n\r\n")
    length = int(block[block.index(b"Content-Length: ") + 16 : http_end])
    out = {"type": head["WARC-Type"], "url": head["WARC-Target-URI"], "date": head["WARC-Date"], "page_id": head["WARC-Record-ID"][10:-1], "refers_to": head.get("WARC-Refers-To", "")[10:-1]}
    declared = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if out["type"] == "response":
        payload = block[http_end + 4 :]
        if len(payload) != length or hashlib.sha1(payload).hexdigest() != declared:
            raise ValueError("payload does not match its digest")
    return out | {"bytes": length, "digest": declared}


class LoserTree:
    """k-way merge: inner nodes keep the losers, so each step replays one path from leaf to root."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.tree = [-1] * self.k
        for i in range(len(self.heads)):
            self._replay(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b)) if x is not None else False

    def _replay(self, i: int) -> None:
        node, winner = (i + self.k) >> 1, i
        while node:
            other = self.tree[node]
            if other == -1:
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node >>= 1
        self.tree[0] = winner

    def __iter__(self):
        while True:
            w = self.tree[0]
            if w == -1 or self.heads[w] is None:
                return
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages plus digest and refers_to (null: response)."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    dug = pages.select("page_id", "url", body.alias("payload"), F.sha1(body).alias("digest"))
    long_ones = dug.where((F.length("payload") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    winners = long_ones.groupBy("digest").agg(F.max("page_id").alias("winner"), F.min("page_id").alias("least")).where("least < winner").select("digest", "winner")
    winners = materialize(winners, "warc-winners")
    joined = dug.join(hint_small(winners, winners.count(), 500_000), "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") < F.col("winner"), F.col("winner")).alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """A stored table (archive string, data binary) of gzip-member segments of about SEGMENT_BYTES."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{seq:06d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], names=["archive", "data"])

        for batch in batches:
            payloads = batch.column(2)
            for i, (page_id, url, digest, refers) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True)):
                parts.append(member(record(page_id, url or "", payloads[i].as_buffer().to_pybytes(), digest, refers)))
                size += len(parts[-1])
                if size >= SEGMENT_BYTES:
                    yield out()
                    parts, size, seq = [], 0, seq + 1
        if parts:
            yield out()

    return materialize(with_revisits(pages).mapInArrow(run, "archive string, data binary"), "warc-archives")


CAPTURE = "url_key string, captured_at string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long"


def read_captures(archives: DataFrame) -> DataFrame:
    """One row per record, read from the archives' bytes; each archive's rows are a sorted run."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in CAPTURE.split(", ")]
        kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in CAPTURE.split(", ")]
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for offset, length, raw in members(data.as_buffer().to_pybytes()):
                    r = parse(raw)
                    rows.append((url_key(r["url"]), r["date"], int(r["page_id"]) if r["page_id"] else None, r["type"], r["bytes"], r["digest"], int(r["refers_to"]) if r["refers_to"] else None, archive, offset, length))
                rows.sort(key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[8]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return materialize(archives.mapInArrow(run, CAPTURE), "warc-captures")


def merge_index(captures: DataFrame) -> DataFrame:
    """Captures in global order of (url_key, captured_at, page_id): range_no, then position.

    There are as many ranges as RANGE_ROWS asks for, so a task's runs are bounded whatever the input; a hot URL's captures are
    cut by time, id and place in the archives.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        rows: dict[str, list] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            cols = [c.to_pylist() for c in batch.columns]
            for r in zip(*cols, strict=True):
                rows.setdefault(r[7], []).append(((r[0], r[1], -1 if r[2] is None else r[2], r[7], r[8]), r))
        if schema is None:
            return
        runs = []
        for archive in sorted(rows):
            part = rows[archive]
            if any(a[0] > b[0] for a, b in zip(part, part[1:], strict=False)):  # a shuffle may deal a run's pieces out of turn
                part.sort(key=lambda x: x[0])
            runs.append(part)
        number, merged = TaskContext.get().partitionId(), []
        for i, (_, r) in enumerate(LoserTree(runs)):
            merged.append((*r, number, i))
            if len(merged) == 10_000:
                yield _rows(merged, schema)
                merged = []
        if merged:
            yield _rows(merged, schema)

    n_ranges = max(1, -(-captures.count() // RANGE_ROWS), int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = captures.repartitionByRange(n_ranges, "url_key", "captured_at", "page_id", "archive", "offset")
    return ranged.mapInArrow(run, CAPTURE + ", range_no int, position long")


def _rows(rows: list, schema):
    import pyarrow as pa

    kinds = [*schema.types, pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*schema.names, "range_no", "position"])


def archive_bytes(archives: DataFrame, name: str) -> bytes:
    """The bytes of one archive, as any WARC reader takes them."""
    return bytes(archives.where(F.col("archive") == name).first()["data"])


def op2_warc_index(spark, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"))
    out = merge_index(read_captures(archives))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "archive", "offset", "length", "range_no", "position")
