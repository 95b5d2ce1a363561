"""Importance resampling of documents towards a target distribution, over hashed n-grams.

A text's features are its runs of one to three words; each is hashed to a bucket by the CRC-32 of its bytes. Corpus and
target are bags of buckets; a bucket's gain is the floored, smoothed log ratio of their shares, a document's weight the
sum over its features. Gumbel noise from a hash of seed and identifier turns the highest scores into a draw without
replacement.

The hashing works on blocks of texts. The distinct features of a block are grouped by byte length into two-dimensional
uint8 arrays, a row each; the CRCs of an array are updated together column by column, and the buckets are scattered back
to where the features stood. The buckets of every document are written once (a document with many features as a count
per bucket, so no row grows beyond the number of buckets); counting and weighing read them.

Defined cases: null and empty texts, and texts without words, have no features, weight 0, and are never drawn;
a null identifier takes part with the empty string in the noise's hash and comes last among ties; rows of equal identifiers
have the same noise and are ranked by place; with no document of enough words, or an empty table, nothing is drawn; extra
columns are ignored. Very long texts are hashed in segments that carry the last two words; features of more than
MAX_COLUMNS bytes are hashed one at a time with the same CRC.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import stored, text_or_empty, unused
from labelflow.operators.windows import consecutive_ids

GRAMS = 3
#: bytes of text hashed together
BLOCK_BYTES = 1 << 21
MAX_COLUMNS = 512
#: word bytes stay, A-Z become a-z, every other byte a space: bytes from 0x80 belong to characters beyond ASCII, all of them word characters
_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_IDS = 21  # bits of a word's number in a block


def crc_table() -> np.ndarray:
    """CRC-32 (reflected polynomial EDB88320) of every byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> np.uint32(1) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


def crc_rows(matrix: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a uint8 matrix: one table step per column for all rows."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = table[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def crc_spans(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC-32 of spans of a buffer, those of equal length together."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for n, at in zip(sizes.tolist(), np.split(order, first[1:])):
        if n > MAX_COLUMNS:
            out[at] = [zlib.crc32(buffer[s: s + n].tobytes()) for s in start[at].tolist()]
        else:
            out[at] = crc_rows(np.lib.stride_tricks.sliding_window_view(buffer, n)[start[at]], table)
    return out


class WordNumbers(dict):
    """Word to its number in a block."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def block_buckets(lines: list[bytes], buckets: int, table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the features of every line of single-spaced words: per order, an array by the feature's last word (the first
    words of a line have no longer features: their entries are not to be read); and the words before each line."""
    words = [w for x in lines for w in x.split()]
    count = np.fromiter((x.count(b" ") + 1 if x else 0 for x in lines), np.int64, len(lines))
    before = np.concatenate([[0], np.cumsum(count)])
    if not words:
        return [np.empty(0, np.int64)] * GRAMS, before
    numbers = WordNumbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    buffer = np.frombuffer(b" ".join(x for x in lines if x), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    starts, lengths, backs, key = [], [], [], ids
    for k in range(GRAMS):
        if k:
            key = key[:-1] << _IDS | ids[k:]  # of the k + 1 words from each on
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        starts.append(begin[first])
        lengths.append(end[first + k] - begin[first])
        backs.append(back)
    crc = crc_spans(buffer, np.concatenate(starts), np.concatenate(lengths), table) % np.uint32(buckets)
    out, at = [], 0
    for k, (s, back) in enumerate(zip(starts, backs)):
        out.append(np.concatenate([np.zeros(min(k, len(ids)), np.int64), crc[at: at + len(s)][back]]))
        at += len(s)
    return out, before


def _segments(text: bytes) -> Iterator[bytes]:
    """A text's single-spaced words in pieces, each cut at a space."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + BLOCK_BYTES)
        end = len(text) if end < 0 else end
        yield b" ".join(text[at:end].split())
        at = end


def text_buckets(texts: list[str], buckets: int, table: np.ndarray) -> list[tuple[int, int, np.ndarray | None, np.ndarray | None]]:
    """(words, features, buckets of the features, counts by bucket) of each text; one of the last two is None."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    counts: list[np.ndarray | None] = [None] * len(texts)
    n_words = [0] * len(texts)
    lines: list[bytes] = []
    owner: list[tuple[int, int]] = []  # text, words carried from its last segment

    def flush() -> None:
        got, before = block_buckets(lines, buckets, table)
        for (i, carried), lo, hi in zip(owner, before.tolist(), before[1:].tolist()):
            n_words[i] += hi - lo - carried
            parts[i] += [g[max(lo + k, lo + carried): hi] for k, g in enumerate(got)]
            if sum(map(len, parts[i])) > buckets:
                c = np.bincount(np.concatenate(parts[i]), minlength=buckets)
                counts[i], parts[i] = c if counts[i] is None else counts[i] + c, []
        lines.clear()
        owner.clear()

    size = 0
    for i, t in enumerate(texts):
        carry: list[bytes] = []
        for line in _segments(t.encode("utf-8", "surrogatepass").translate(_WORD_BYTES)):
            if carry:
                line = b" ".join([*carry, line]) if line else b" ".join(carry)
            lines.append(line)
            owner.append((i, len(carry)))
            carry = line.rsplit(b" ", GRAMS - 1)[-(GRAMS - 1):] if line else []
            size += len(line) + 1
            if size >= BLOCK_BYTES:
                flush()
                size = 0
    if lines:
        flush()
    out = []
    for i in range(len(texts)):
        tail = np.concatenate(parts[i]) if parts[i] else np.empty(0, np.int64)
        if counts[i] is None:
            out.append((n_words[i], len(tail), tail, None))
        else:
            c = counts[i] + np.bincount(tail, minlength=buckets)
            out.append((n_words[i], int(c.sum()), None, c))
    return out


def hashed_features(df: DataFrame, buckets: int, keep: list[str], text: Column) -> DataFrame:
    """The kept columns with n_words, n_features and the features' buckets: `found` lists them (two or four bytes each), or
    `counts` has a count per bucket where a text has more features than there are buckets."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = crc_table()
        for b in batches:
            texts = b.column(b.num_columns - 1)
            lo, size = 0, 0
            for hi, n in enumerate(pc.binary_length(texts).to_pylist(), 1):
                size += n
                if size < BLOCK_BYTES and hi < b.num_rows:
                    continue
                part = b.slice(lo, hi - lo)
                words, features, found, counts = zip(*text_buckets(part.column(b.num_columns - 1).to_pylist(), buckets, table))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array([None if f is None else f.astype(kind).tobytes() for f in found], pa.binary()),
                     pa.array([None if c is None else c.astype("<i8").tobytes() for c in counts], pa.binary())], names=[*keep, "n_words", "n_features", "found", "counts"])
                lo, size = hi, 0

    rows = df.select(*keep, text.alias(unused(df, "text")))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, (kept + ", " if kept else "") + "n_words bigint, n_features bigint, found binary, counts binary")


def bucket_totals(features: DataFrame, buckets: int) -> np.ndarray:
    """Features of the whole table in each bucket: a task adds up its rows, Spark the tasks."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                found, counts = (b.column(i).slice(lo, 256).drop_null().to_pylist() for i in range(2))
                total += np.bincount(np.frombuffer(b"".join(found), kind), minlength=buckets)
                for c in counts:
                    total += np.frombuffer(c, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("found", "counts").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, target to corpus."""
    b, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((y + 1.0) * (s + b)) / ((x + 1.0) * (t + b)))) for x, y in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(features: DataFrame, gains: np.ndarray, keep: list[str]) -> DataFrame:
    """The kept columns, n_words, n_features and weight: the sum of gains over a document's features."""
    kind = "<u2" if len(gains) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                found, counts = (part.column(part.num_columns - i).to_pylist() for i in (2, 1))
                w = [int(gains[np.frombuffer(f, kind)].sum()) if f is not None else int(gains @ np.frombuffer(c, "<i8")) for f, c in zip(found, counts)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(w, pa.int64())], names=[*keep, "n_words", "n_features", "weight"])

    rows = features.select(*keep, "n_words", "n_features", "found", "counts")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    return rows.mapInArrow(run, kept + ", weight bigint")


def gumbel(key: Column, seed: int) -> Column:
    """Floored Gumbel noise in thousandths, from the first 32 bits of a hash of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """Every document's doc_id, n_features, weight, score, and rank among the drawn (null: not drawn); n_words and place in the
    input (row) go along."""
    corpus = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row"))
    keep = ["doc_id", "row"]
    features = stored(hashed_features(corpus, buckets, keep, F.col("text")), "resample-features")
    wanted = hashed_features(target.select(text_or_empty().alias("text")), buckets, [], F.col("text"))
    gains = bucket_gains(bucket_totals(features, buckets), bucket_totals(wanted, buckets))
    scored = stored(weighed(features, gains, keep).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "resample-scores")
    n = scored.where(F.col("n_words") >= min_words).count()
    # one distributed numbering: documents that may be drawn come first, by falling score
    order = {"_late": F.col("n_words") < min_words, "_fall": -F.col("score"), "_none": F.col("doc_id").isNull()}
    numbered = consecutive_ids(scored.select("*", *(c.cast("bigint").alias(k) for k, c in order.items())), [*order, "doc_id", "row"], name="_place", start=1)
    return numbered.select("doc_id", "n_features", "weight", "score", F.when(F.col("_place") <= percent * n // 100, F.col("_place")).alias("rank"), "n_words", "row")


def drawn_documents(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The drawn rows of the table that was resampled, whole: docs has to be read as it was then (the place in the input names a
    row)."""
    place = unused(docs, "_row")
    return docs.withColumn(place, F.monotonically_increasing_id()).join(ranked.where("rank is not null").select(F.col("row").alias(place)), place, "left_semi").drop(place)
