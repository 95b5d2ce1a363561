"""Packing token sequences by best-fit decreasing.

A first pass tokenises each document where it lies and cuts it: full windows leave as sequences of their own, the
remainder (under one window) goes on as a narrow row of identifier, length and checksum. These rows are rebalanced
into packing tasks of even size; each packs its remainders in falling length, a segment tree indexed by remaining
capacity giving the tightest open window that a piece fits. Only narrow rows are shuffled, and no task holds text of
others.

Defined cases: a null text has the end id alone; an empty table gives no rows; repeated rows are packed each for
itself; ties in length go by order of arrival; a null identifier is packed like any other; extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import stored

PIECE_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level tokenizer: file of merge ranks, pre-token pattern, special tokens and their ids."""

    ranks_file: str
    pattern: str
    special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),)


@lru_cache(maxsize=2)
def byte_encoding(ranks_file: str, pattern: str, special: tuple[tuple[str, int], ...]):
    """The byte-level tokenizer of a file of merge ranks. A worker builds it once for all its tasks."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


def token_ids(encoding, text: str) -> np.ndarray:
    """Ids of a whole text; the strings of special tokens are read as these tokens."""
    ids = encoding.encode(text, allowed_special="all") if any(s in text for s in encoding.special_tokens_set) else encoding.encode_ordinary(text)
    return np.array(ids, "<u4")


def pieces(docs: DataFrame, tokenizer: Tokenizer, window: int, end_id: int) -> DataFrame:
    """The cut documents: every piece has `window` ids but a document's last, which has fewer (or as many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_encoding(tokenizer.ranks_file, tokenizer.pattern, tokenizer.special)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                src, start, length, crc, total = [], [], [], [], []
                for i, t in enumerate(part.column(1)):
                    raw = token_ids(encoding, t.as_py() or "").tobytes() + end
                    n = len(raw) // 4
                    for s in range(0, n, window):
                        src.append(i)
                        start.append(s)
                        length.append(min(window, n - s))
                        crc.append(zlib.crc32(raw[4 * s: 4 * (s + window)]))
                        total.append(n)
                cols = [part.column(0).take(pa.array(src, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(run, PIECE_DDL)


class CapacityTree:
    """Segment tree over remaining capacities 0..window: a leaf counts the open windows with that capacity."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least `least` with an open window, or -1."""
        i = least + self.size
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length (1..window)."""
    tree, open_ = CapacityTree(window), [[] for _ in range(window + 1)]
    seq, off, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        c = tree.tightest(n)
        if c < 0:
            w, c = used, window
            used += 1
        else:
            w = open_[c].pop()
            tree.add(c, -1)
        seq[i], off[i] = w, window - c
        if c > n:
            open_[c - n].append(w)
            tree.add(c - n, 1)
    return seq, off


def _pack(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        seq, off = best_fit_decreasing(t.column("length").to_numpy(), window)
        t = t.append_column("sequence_id", pa.array(seq + base)).append_column("offset", pa.array(off))
        yield from t.to_batches(max_chunksize=65_536)

    return run


def pack(docs: DataFrame, tokenizer: Tokenizer, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = stored(pieces(docs, tokenizer, window, end_id), "packing")
    # full windows fill a sequence each, so they are packed alike, without looking at other pieces
    return cut.hint("rebalance").mapInArrow(_pack(window), PIECE_DDL + ", sequence_id bigint, offset bigint")
