"""Line deduplication over range-partitioned hashes.

Every long line becomes a row (128-bit key hash, document, position). The rows are range-partitioned by hash,
document and position together, so a line that a third of all documents share spans many partitions, and sorted
within them, the largest document first. Each partition is streamed once, holding the rows of the current key alone:
the first document of a key is the one that keeps it, and the later ones lose it if enough documents hold it. A key that
touches a partition's edge may go on in the next one; its rows leave the stream undecided and are settled by counting
(at most two such keys a partition). What comes back is a compressed bitmap of kept lines per document, not text.

Defined cases: a null or empty text is one empty line; a null identifier is a document smaller than any other;
rows that repeat an identifier count as one document, and each text has its own bitmap; lines of equal key within a
document go or stay together; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import WHITE, stored, text_or_empty

UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
LINE = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n_lines", pa.int32()), ("pos", pa.int32())])
LINE_DDL = "h1 bigint, h2 bigint, doc_id bigint, row bigint, n_lines int, pos int"


def line_key(line: str) -> str:
    line = line.strip(WHITE)
    return line.lower() if line.isascii() else line.translate(UPPER)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, row (tells texts under one identifier apart), text."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, md5 = struct.Struct("<qq").unpack, hashlib.md5
        for b in batches:
            h1, h2, src, n, pos = [], [], [], [], []
            for i, t in enumerate(b.column(2)):
                lines = t.as_py().split("\n")
                for p, line in enumerate(lines):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                        x, y = unpack(md5(key.encode()).digest())
                        h1.append(x)
                        h2.append(y)
                        src.append(i)
                        n.append(len(lines))
                        pos.append(p)
            at = pa.array(src, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), b.column(0).take(at), b.column(1).take(at), pa.array(n, pa.int32()), pa.array(pos, pa.int32())], schema=LINE)

    return _rows(docs).mapInArrow(run, LINE_DDL)


def _stream(min_docs: int):
    """One pass over a sorted partition; vectorised by batch, carrying the current key across batches."""

    def decide(t: dict[str, np.ndarray], closed: bool, first_key: tuple | None):
        """Whole key groups in t: drop rows of decided keys, and the rows of undecided ones."""
        h1, h2, doc, null = t["h1"], t["h2"], t["doc_id"], t["null"]
        n = len(h1)
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        new_doc = new.copy()
        new_doc[1:] |= (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])
        n_docs = np.add.reduceat(new_doc.astype(np.int64), start)
        nth = np.cumsum(new_doc)
        nth -= nth[start][group] - 1  # 1 for the document that keeps the line
        drop = (n_docs[group] >= min_docs) & (nth > 1)
        edge = np.zeros(len(start), bool)
        if first_key is not None and len(start) and (h1[0], h2[0]) == first_key:
            edge[0] = True
        if closed and len(start):
            edge[-1] = True  # the last key of the partition
        return drop & ~edge[group], edge[group]

    def out(t, mask, open_):
        at = np.flatnonzero(mask)
        cols = [pa.array(t[k][at]) for k in ("h1", "h2")] + [pa.array(t["doc_id"][at], mask=t["null"][at])] + [pa.array(t[k][at]) for k in ("row", "n_lines", "pos")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(at), open_))], names=[*LINE.names, "undecided"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold, first_key = None, None
        for b in batches:
            if not b.num_rows:
                continue
            t = {k: b.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i, k in enumerate(LINE.names)}
            t["null"] = b.column(2).is_null().to_numpy(zero_copy_only=False)
            if first_key is None:
                first_key = (t["h1"][0], t["h2"][0])
            if hold is not None:
                t = {k: np.concatenate([hold[k], v]) for k, v in t.items()}
            same = (t["h1"] == t["h1"][-1]) & (t["h2"] == t["h2"][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                head = {k: v[:cut] for k, v in t.items()}
                drop, edge = decide(head, False, first_key)
                yield out(head, drop, False)
                yield out(head, edge, True)
            hold = {k: v[cut:] for k, v in t.items()}
            if (hold["h1"][0], hold["h2"][0]) == first_key:
                # an edge key in any case: its rows need not be held
                yield out(hold, np.ones(len(hold["h1"]), bool), True)
                hold = None
        if hold is not None:
            _, edge = decide(hold, True, first_key)
            yield out(hold, edge, True)

    return run


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, row, n_lines, pos) of every line that goes."""
    ordered = (line_hashes(docs, min_chars)
               .repartitionByRange("h1", "h2", F.col("doc_id").desc_nulls_last(), "row", "pos")
               .sortWithinPartitions("h1", "h2", F.col("doc_id").desc_nulls_last(), "row", "pos"))
    seen = stored(ordered.mapInArrow(_stream(min_docs), LINE_DDL + ", undecided boolean"), "line-dedup")
    undecided = seen.where("undecided")
    # two keys a partition at most: counted with partial sums, and small enough to broadcast
    settled = (undecided.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
               .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs))
    late = (undecided.join(F.broadcast(settled), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))))
    cols = ["doc_id", "row", "n_lines", "pos"]
    return seen.where("not undecided").select(*cols).unionByName(late.select(*cols))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, row, n_lines, n_dropped, bitmap (zlib of one bit a line, set where it stays), for texts that lose lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dropped, maps = [], []
            for n, pos in zip(b.column(2).to_pylist(), b.column(3)):
                bits = np.ones(n, np.uint8)
                bits[pos.values.to_numpy()] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
                dropped.append(n - int(bits.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "row", "n_lines", "n_dropped", "bitmap"])

    # one document's own positions: bounded by its number of lines
    grouped = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "row").agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("pos"))
    return grouped.select("doc_id", "row", "n_lines", "pos").mapInArrow(run, "doc_id bigint, row bigint, n_lines int, n_dropped bigint, bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (and the kept text) of every row of docs."""
    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string" + (", text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha, texts = [], [], [], []
            for t, m in zip(b.column(1), b.column(2)):
                text, m = t.as_py(), m.as_py()
                if m is None:
                    n.append(text.count("\n") + 1)
                    gone.append(0)
                else:
                    lines = text.split("\n")
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(m), np.uint8), count=len(lines))
                    text = "\n".join([x for x, k in zip(lines, keep.tolist()) if k])
                    n.append(len(lines))
                    gone.append(len(lines) - int(keep.sum()))
                sha.append(hashlib.sha256(text.encode()).hexdigest())
                texts.append(text)
            cols = {"doc_id": b.column(0), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_pydict(cols | ({"text": pa.array(texts, pa.string())} if with_text else {}))

    a, m = _rows(docs).alias("a"), bitmaps.alias("m")
    joined = a.join(m.hint("shuffle_hash"), F.col("a.row").eqNullSafe(F.col("m.row")) & F.col("a.doc_id").eqNullSafe(F.col("m.doc_id")), "left")
    return joined.select("a.doc_id", "a.text", "m.bitmap").mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, with_text: bool = False) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs), with_text)
