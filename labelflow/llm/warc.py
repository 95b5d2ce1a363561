"""WARC archives of pages, and their capture index by external merging.

Each task writes the records of its pages into an archive file of its own, one gzip member per record, and returns
its captures as a run, sorted by (URL key, timestamp). The runs are range-partitioned by that key, so a host or URL with
many captures spans several partitions, and each partition merges its runs with a loser tree: one comparison per
level and record. The merged partitions are written as the index: the globally sorted capture history, with a record's
position in it and its capture number under its URL key, both carried over partition edges. Archives are read back through
the index, each file once and in order; bytes that the index doesn't name are an error.

The archive folder has to be reachable by all executors under the same address (a shared mount, or any store that
pyarrow's file systems open). Files are named anew by every attempt; only those that the index names count.

Defined cases: null or empty html is the payload of 0 bytes; of rows with equal payloads, those with the smallest non-null
page_id are responses and all others revisit it (without any identifier, all are responses); repeated rows have a
record each; a null or malformed URL is archived under the key of its text; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import scratch, stored

RUN_DDL = "run string, seq bigint, url_key string, timestamp string, page_id bigint, record_type string, digest string, offset bigint, length bigint"
HISTORY_DDL = RUN_DDL + ", part int, place bigint, capture bigint"
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
MASK = (1 << 64) - 1


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Host labels in reverse, then the path and query: captures of a site sort together."""
    try:
        u = urlsplit(url)
        host = u.hostname or ""
    except ValueError:
        return url
    if not host:
        return url
    if host.startswith("www."):
        host = host[4:]
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/").lower() + ("?" + u.query.lower() if u.query else "")


def capture_time(page_id: int | None) -> datetime:
    """The tables have no capture times: the identifier counts seconds."""
    return EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))


def record_id(url: str, page_id: int | None) -> str:
    """Upper half: hash of the URL (all ones for a null identifier); lower half: the identifier."""
    top = MASK if page_id is None else int.from_bytes(hashlib.sha1(url.encode()).digest()[:8], "big") >> 1
    return f"<urn:uuid:{uuid.UUID(int=top << 64 | ((page_id or 0) & MASK))}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = n & MASK
    return None if n >> 64 == MASK else low - (1 << 64) if low >> 63 else low


def warc_record(url: str, page_id: int | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(url, page_id)}", f"WARC-Date: {capture_time(page_id):%Y-%m-%dT%H:%M:%SZ}",
            f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_url or '', refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _files(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address if "://" in address or address.startswith("/") else f"/{address.removeprefix('file:').lstrip('/')}")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write the archive files and return the runs: one row per record, sorted within each run."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    first = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha")
             .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    marked = rows.join(first, "sha", "left").select("page_id", "url", "payload", F.col("first.page_id").alias("to"), F.col("first.url").alias("to_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        files.create_dir(path, recursive=True)
        out, name, at, index = None, f"{uuid.uuid4().hex}.warc.gz", 0, []
        for b in batches:
            for page_id, url, body, to, to_url in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                revisit = to if to is not None and to != page_id else None
                digest = base32_sha1(body)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = z.compress(warc_record(url, page_id, body, digest, revisit, to_url)) + z.flush()
                out.write(member)
                index.append((url_key(url), f"{capture_time(page_id):%Y%m%d%H%M%S}", page_id, "response" if revisit is None else "revisit", digest, at, len(member)))
                at += len(member)
        if out is None:
            return
        out.close()
        index.sort(key=lambda r: (r[0], r[1], r[5]))
        for lo in range(0, len(index), 8192):
            part = index[lo: lo + 8192]
            yield pa.RecordBatch.from_pydict({"run": [name] * len(part), "seq": list(range(lo, lo + len(part))), "url_key": [r[0] for r in part], "timestamp": [r[1] for r in part],
                                              "page_id": pa.array([r[2] for r in part], pa.int64()), "record_type": [r[3] for r in part], "digest": [r[4] for r in part],
                                              "offset": [r[5] for r in part], "length": [r[6] for r in part]})

    # written as a table, so the archives are written once however often the index is read
    return stored(marked.mapInArrow(run, RUN_DDL), "warc-runs")


class LoserTree:
    """Merges k sorted lists: inner nodes hold the losers, so a new item plays one match per level."""

    def __init__(self, lists: list[list]):
        self.lists, self.at, k = lists, [0] * len(lists), len(lists)
        self.size = 1 << max(0, (k - 1).bit_length())
        self.loser = [-1] * max(1, self.size)
        self.winner = self._build(1)

    def _head(self, i: int):
        return self.lists[i][self.at[i]] if 0 <= i < len(self.lists) and self.at[i] < len(self.lists[i]) else None

    def _better(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or (x is not None and (x, a) <= (y, b))

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if not self._better(a, b):
            a, b = b, a
        self.loser[node] = b
        return a

    def __iter__(self):
        while (item := self._head(w := self.winner)) is not None:
            yield w, self.at[w], item
            self.at[w] += 1
            node = (w + self.size) >> 1
            while node:
                if not self._better(w, self.loser[node]):
                    w, self.loser[node] = self.loser[node], w
                node >>= 1
            self.winner = w


def merge_runs(runs: DataFrame) -> DataFrame:
    """The capture history in global order: partitions follow each other by (URL key, timestamp), rows within them too.
    part is the partition, place the row's place in it; capture counts a URL key's captures within the partition."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, place, capture, last = TaskContext.get().partitionId(), 0, 0, None
        parts: dict[str, list] = {}
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                parts.setdefault(r[0], []).append(r)
        if not parts:
            return
        names = sorted(parts)
        for name in names:  # rows of a run may arrive in several blocks
            if any(x[1] > y[1] for x, y in zip(parts[name], parts[name][1:])):
                parts[name].sort(key=lambda r: r[1])
        tree, got = LoserTree([[(r[2], r[3]) for r in parts[n]] for n in names]), []
        for w, i, _ in tree:
            r = parts[names[w]][i]
            capture, last = capture + 1 if r[2] == last else 1, r[2]
            got.append((*r, pid, place, capture))
            place += 1
            if len(got) == 8192:
                yield _batch(got)
                got = []
        if got:
            yield _batch(got)

    return runs.repartitionByRange("url_key", "timestamp", "run", "seq").mapInArrow(merge, HISTORY_DDL)


def capture_index(runs: DataFrame) -> DataFrame:
    """The written index: a row per record with its position in the global history (from 0) and the number of its capture
    among those of its URL key (from 1)."""
    spark = runs.sparkSession
    merged = stored(merge_runs(runs), "warc-index")
    edges = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min_by("url_key", "place").alias("first"), F.max_by("url_key", "place").alias("last"),
                                       F.max_by("capture", "place").alias("n_last")).orderBy("part").collect()
    # a row per partition: what its first URL key had before, and how many rows
    carry, before, key, total = [], 0, None, 0
    for e in edges:
        had = total if e["first"] == key else 0
        carry.append((e["part"], e["first"], had, before))
        before += e["n"]
        key, total = e["last"], e["n_last"] + (had if e["first"] == e["last"] else 0)
    at = spark.createDataFrame(carry, "part int, first_key string, had bigint, before bigint")
    return merged.join(F.broadcast(at), "part").select(
        "run", "seq", "url_key", "timestamp", "page_id", "record_type", "digest", "offset", "length", (F.col("before") + F.col("place")).alias("position"),
        (F.col("capture") + F.when(F.col("url_key") == F.col("first_key"), F.col("had")).otherwise(0)).alias("capture"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    names = ["run", "seq", "url_key", "timestamp", "page_id", "record_type", "digest", "offset", "length", "part", "place", "capture"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def parse_record(raw: bytes) -> dict:
    """Fields of one WARC record; the payload of a response is checked against its digest."""
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = body[: int(named["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = named["warc-payload-digest"].removeprefix("sha1:")
    if named["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {named['warc-record-id']} does not match its digest")
    to = named.get("warc-refers-to")
    return {"page_id": page_of(named["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": named["warc-type"],
            "refers_to": page_of(to) if to else None, "payload": payload}


def read_members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream, one at a time."""
    at, data = 0, b""
    while True:
        z, out, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not data:
                data = stream.read(chunk)
                if not data:
                    if used:
                        raise ValueError("archive ends inside a record")
                    return
            out.append(z.decompress(data))
            used += len(data) - len(z.unused_data)
            data = z.unused_data
        yield at, b"".join(out)
        at += used


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every record that the index (or the runs) names, read at its offset: run, offset, page_id, payload_bytes, payload_digest,
    record_type, refers_to; and url_key, timestamp, the indexed type, and of an index position and capture."""
    passed = ["url_key", "timestamp", "record_type", *(c for c in ("position", "capture") if c in index.columns)]
    kinds = {"run": pa.string(), "offset": pa.int64(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    names = [*kinds, "url_key", "timestamp", "indexed_type", *passed[3:]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        name, stream, at = None, None, 0

        def close():
            if stream is not None:
                with stream:
                    if stream.read(1):
                        raise ValueError(f"{name} has records that the index does not name")

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b, rows = batch.slice(lo, 1024), []
                for run, offset, length in zip(*(b.column(i).to_pylist() for i in range(3))):
                    if run != name:
                        close()
                        name, stream, at = run, files.open_input_stream(f"{path}/{run}", compression=None, buffer_size=1 << 20), 0
                    if offset != at:
                        raise ValueError(f"{name} has bytes at {at} that the index does not name")
                    z = zlib.decompressobj(31)
                    raw = z.decompress(stream.read(length))
                    if not z.eof or z.unused_data:
                        raise ValueError(f"the record at {at} of {name} has not the indexed length")
                    at += length
                    rows.append({"run": run, "offset": offset, **parse_record(raw)})
                    del rows[-1]["payload"]
                yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], t) for k, t in kinds.items()), *b.columns[3:]], names=names)
        close()

    # the runs are few: deal one file to a task on average, its records in order
    n = max(1, index.select("run").distinct().count())
    rows = index.select("run", "offset", "length", *passed).repartition(n, "run").sortWithinPartitions("run", "offset")
    return rows.mapInArrow(read, "run string, offset bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
                                 "url_key string, timestamp string, indexed_type string" + "".join(f", {c} bigint" for c in passed[3:]))


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write, merge the index, read back through it: one row per record with its position in the capture history and its capture
    number."""
    folder = folder or scratch(pages.sparkSession, "warc")
    return read_archives(capture_index(write_archives(pages, folder)), folder)
