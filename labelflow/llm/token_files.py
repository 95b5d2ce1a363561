"""Token ids as directly addressable codes.

A token file splits every id into chunks of eight bits, lowest first. Level 0 holds the first chunk of each token; a
token whose id goes on sets its bit in the level's continuation bitmap and has its next chunk in the next level, at
the place that the number of set bits before its own names. A rank directory counts the set bits before every block of
512, so that place takes one directory entry and one block of bits: any token is read by a few bytes per level, with
no block of others decoded. Small ids cost one byte, most others two.

Writing: documents are range-partitioned by identifier (ties by place in the input, so a repeated identifier spans
partitions), tokenised in that order and written by each task into files of a bounded number of tokens, a document
whole in one file. The written manifest names the files in order with the number of ids before each, so the files
together are one array of ids, addressed by document or by position. Files are named anew by every attempt; only
those in the manifest count. The folder has to be reachable by all executors under the same address (a shared mount
or any store that pyarrow's file systems open).

Defined cases: a null or empty text has the end id alone; null identifiers come first; rows of equal identifiers follow
each other in the order of the input; an empty table gives a manifest without files; extra columns are ignored. Very
long texts: a task holds one file's codes and one document's ids (documents longer than the bound fill a file of their
own), never a partition.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.llm.common import scratch, stored, text_or_empty
from labelflow.operators.windows import running_agg

MAGIC = b"DACTOK01"
#: bits of a rank directory's block
BLOCK = 512
#: tokens after which a file is closed
FILE_TOKENS = 1 << 24
#: entries of a worker's table of encoded pre-tokens before it is emptied
TABLE_ROWS = 500_000
MANIFEST_DDL = "part int, file int, name string, docs bigint, tokens bigint"


# -- codes

def split_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(chunks, continues) of each level of an array of unsigned 32-bit ids."""
    levels, rest = [], np.ascontiguousarray(ids, "<u4")
    while True:
        on = rest > 255
        levels.append((rest.astype(np.uint8), on))
        if not on.any():
            return levels
        rest = rest[on] >> np.uint32(8)


def pack_bits(on: np.ndarray) -> np.ndarray:
    """The bitmap as bytes, lowest bit first, filled up to whole blocks."""
    n = -(-len(on) // BLOCK) * BLOCK // 8
    return np.concatenate([b := np.packbits(on, bitorder="little"), np.zeros(n - len(b), np.uint8)])


def rank_directory(bits: np.ndarray) -> np.ndarray:
    """Set bits before every block, and in all."""
    per = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(per)]).astype("<i8")


class FileWriter:
    """Collects documents' ids by level and writes them as one file."""

    def __init__(self):
        self.levels: list[tuple[list, list]] = []
        self.ids: list[int | None] = []
        self.starts = [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for k, (chunks, on) in enumerate(split_levels(ids)):
            if k == len(self.levels):
                self.levels.append(([], []))
            self.levels[k][0].append(chunks)
            self.levels[k][1].append(on)
        self.ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))

    @property
    def tokens(self) -> int:
        return self.starts[-1]

    def write(self, out) -> None:
        """Sections one after the other, then their places (8-byte integers), the number of places and the magic word."""
        places, at = [], 0

        def put(a: np.ndarray) -> None:
            nonlocal at
            places.extend((at, len(a)))
            out.write(raw := np.ascontiguousarray(a).tobytes())
            at += len(raw)

        put(np.array(self.starts, "<i8"))
        put(np.array([d or 0 for d in self.ids], "<i8"))
        put(np.array([d is None for d in self.ids], np.uint8))
        for chunks, on in self.levels:
            bits = pack_bits(np.concatenate(on))
            put(np.concatenate(chunks))
            put(bits)
            put(rank_directory(bits))
        out.write(np.array([*places, len(places)], "<i8").tobytes() + MAGIC)


class TokenFile:
    """Random access to a written file: every method reads only the bytes it needs from the open file."""

    def __init__(self, source):
        self.f = source
        end = source.size()
        tail = self._at(end - len(MAGIC) - 8, len(MAGIC) + 8)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        n = int(np.frombuffer(tail[:8], "<i8")[0])
        places = np.frombuffer(self._at(end - len(MAGIC) - 8 - 8 * n, 8 * n), "<i8").reshape(-1, 2).tolist()
        self.starts, self.ids, self.null, *rest = places
        self.levels = [rest[i: i + 3] for i in range(0, len(rest), 3)]
        self.docs = self.ids[1]
        self.tokens = self.levels[0][0][1] if self.levels else 0

    def _at(self, place: int, n: int) -> bytes:
        self.f.seek(place)
        return self.f.read(n)

    def _ints(self, section, lo: int, hi: int) -> np.ndarray:
        return np.frombuffer(self._at(section[0] + 8 * lo, 8 * (hi - lo)), "<i8")

    def _rank(self, level: int, i: int) -> tuple[int, bool]:
        """Set bits before bit i of a level, and bit i."""
        _, bits, ranks = self.levels[level]
        block = np.frombuffer(self._at(bits[0] + i // BLOCK * (BLOCK // 8), BLOCK // 8), np.uint8)
        got = np.unpackbits(block, bitorder="little")
        return int(self._ints(ranks, i // BLOCK, i // BLOCK + 1)[0]) + int(got[: i % BLOCK].sum()), bool(got[i % BLOCK])

    def token(self, i: int) -> int:
        """The id at position i of the file: per level one chunk, one block of the bitmap and one directory entry."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for k, (chunks, _, _) in enumerate(self.levels):
            value |= self._at(chunks[0] + i, 1)[0] << 8 * k
            i, on = self._rank(k, i)
            if not on:
                break
        return value

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """The ids at positions lo to hi: what goes on of a range is a range of the next level."""
        if not 0 <= lo <= hi <= self.tokens:
            raise IndexError((lo, hi))
        out, at = np.zeros(hi - lo, "<u4"), np.arange(hi - lo)
        for k, (chunks, bits, _) in enumerate(self.levels):
            if lo == hi:
                break
            got = np.frombuffer(self._at(chunks[0] + lo, hi - lo), np.uint8)
            out[at] |= got.astype("<u4") << np.uint32(8 * k)
            raw = np.frombuffer(self._at(bits[0] + lo // 8, (hi + 7) // 8 - lo // 8), np.uint8)
            on = np.unpackbits(raw, bitorder="little")[lo % 8: lo % 8 + hi - lo].astype(bool)
            at, lo = at[on], self._rank(k, lo)[0]
            hi = lo + len(at)
        return out

    def document_ids(self) -> list[int | None]:
        null = self._at(self.null[0], self.docs)
        return [None if z else d for d, z in zip(self._ints(self.ids, 0, self.docs).tolist(), null)]

    def document(self, j: int) -> np.ndarray:
        lo, hi = self._ints(self.starts, j, j + 2).tolist()
        return self.slice(lo, hi)

    def documents(self, run: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(number, start, ids) of every document in order, read in runs of about so many tokens."""
        starts, j = self._ints(self.starts, 0, self.docs + 1), 0
        while j < self.docs:
            end = max(j + 1, int(np.searchsorted(starts, starts[j] + run, "right")) - 1)
            ids = self.slice(int(starts[j]), int(starts[end]))
            for i in range(j, end):
                yield i, int(starts[i]), ids[starts[i] - starts[j]: starts[i + 1] - starts[j]]
            j = end


# -- tokenising

@dataclass(frozen=True)
class JsonTokenizer:
    """A byte-level tokenizer of the tokenizers library: its file and the pattern that cuts its pre-tokens."""

    file: str
    pattern: str


#: code points that the narrow pattern covers: ASCII to IPA, most texts of European languages
NARROW = 0x2B0


def narrow_pattern(pattern: str) -> str:
    """The pattern for texts below NARROW only, with its character properties written out, so that Python's own (several times
    faster) re can run it: the members of each property are what the regex library finds there."""
    import regex

    out, inside, i = [], False, 0
    while i < len(pattern):
        if m := re.match(r"\\p\{\w+\}|\\[sS]", pattern[i:]):
            name = m[0]
            members = "".join(re.escape(chr(c)) for c in range(NARROW) if regex.match(name.lower() if name == "\\S" else name, chr(c)))
            if name == "\\S" and inside:
                raise ValueError("\\S inside of a class")
            out.append(members if inside else f"[^{members}]" if name == "\\S" else f"[{members}]")
        else:
            m = re.match(r"\\.|.", pattern[i:], re.DOTALL)
            inside = m[0] == "[" or inside and m[0] != "]"
            out.append(m[0])
        i += len(m[0])
    return "".join(out)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: bytes that print are themselves, the others
    follow from U+0100."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class PreTokenTable:
    """Ids of texts: the pattern cuts a text into pre-tokens, which the library's model merges each for itself, so each distinct
    one is given to it once. The table has two generations, so common pre-tokens outlive rare ones. Texts that hold the string
    of an added token are given to the library whole."""

    def __init__(self, tokenizer: JsonTokenizer):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer.file)
        self.model = self.library.model
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cut = regex.compile(tokenizer.pattern).findall
        self.cut_narrow = re.compile(narrow_pattern(tokenizer.pattern)).findall
        self.wide = re.compile(f"[^\\x00-{chr(NARROW - 1)}]").search
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def merge(self, pre_token: str) -> bytes:
        found = self.before.get(pre_token)
        if found is None:
            spelled = pre_token.encode().decode("latin-1").translate(self.letters)
            found = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for t in texts:
            if any(a in t for a in self.added):
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            cut = self.cut(t) if self.wide(t) else self.cut_narrow(t)
            if len(self.known) > TABLE_ROWS:
                self.known, self.before = {}, self.known
            for w in set(cut).difference(self.known):
                self.known[w] = self.merge(w)
            out.append(b"".join(map(self.known.__getitem__, cut)))
        return out


@lru_cache(maxsize=1)
def pre_token_table(tokenizer: JsonTokenizer) -> PreTokenTable:
    """A worker's table, kept between its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return PreTokenTable(tokenizer)


def _blocks(batch: pa.RecordBatch, chars: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """(identifiers, texts) of a batch in blocks of about so many characters."""
    ids, texts, size = [], [], 0
    for d, t in zip(batch.column(0), batch.column(1)):
        ids.append(d.as_py())
        texts.append(t.as_py())
        size += len(texts[-1])
        if size >= chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


# -- files

def _files(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address if "://" in address or address.startswith("/") else f"/{address.removeprefix('file:').lstrip('/')}")


def write_token_files(docs: DataFrame, tokenizer: JsonTokenizer, folder: str, end_id: int = 0, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order, each followed by end_id. Returns the manifest, which is also
    written into the folder: a row per file with its number of documents and tokens and, as base, the ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, table, end = TaskContext.get().partitionId(), pre_token_table(tokenizer), np.array([end_id], "<u4").tobytes()
        files, path = _files(folder)
        files.create_dir(path, recursive=True)
        rows: list[tuple] = []
        held = FileWriter()

        def close() -> None:
            name = f"{part:06d}-{len(rows):06d}-{uuid.uuid4().hex}.dac"
            with files.open_output_stream(f"{path}/{name}", compression=None) as out:
                held.write(out)
            rows.append((part, len(rows), name, len(held.ids), held.tokens))

        for b in batches:
            for ids, texts in _blocks(b):
                for d, raw in zip(ids, table.encode(texts)):
                    held.add(d, np.frombuffer(raw + end, "<u4"))
                    if held.tokens >= file_tokens:
                        close()
                        held = FileWriter()
        if held.ids:
            close()
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["part", "file", "name", "docs", "tokens"])

    order = ["doc_id", "_row"]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("_row"))
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, MANIFEST_DDL)
    # as a table first, so that the files are written once
    listed = stored(laid, "token-files")
    path = f"{folder.rstrip('/')}/manifest.parquet"
    running_agg(listed, [], ["part", "file"], ["tokens"], exclusive=True, suffix="_base").withColumnRenamed("tokens_base", "base") \
        .select(*listed.columns, F.col("base").cast("bigint")).write.parquet(path)
    return read_manifest(docs.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/manifest.parquet")


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        for b in batches:
            for name, docs, tokens, base in zip(*(b.column(i).to_pylist() for i in range(4))):
                with files.open_input_file(f"{path}/{name}") as source:
                    f, rows, size = TokenFile(source), [], 0
                    if (f.docs, f.tokens) != (docs, tokens):
                        raise ValueError(f"{name} is not as the manifest has it")
                    doc_ids = f.document_ids()
                    for j, start, ids in f.documents():
                        rows.append((doc_ids[j], base + start, len(ids), zlib.crc32(ids.tobytes()), ids if with_ids else None))
                        size += len(ids)
                        if len(rows) == 4096 or size >= 1 << 22:
                            yield _batch(rows, names)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, names)

    listed = read_manifest(spark, folder)
    # files are few and large: one to a task on average
    n = max(1, listed.count())
    dealt = listed.select("name", "docs", "tokens", "base").repartition(n, "name")
    return dealt.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else ""))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows))[: len(names)], kinds)], names=names)


def tokens_at(positions: DataFrame, folder: str, column: str = "position") -> DataFrame:
    """The id at each position of the array that the files form: column, token (null outside of it). Positions are sorted into
    their files by range and each is read for itself."""
    listed = read_manifest(positions.sparkSession, folder)
    file = F.struct("base", "name", "tokens")
    asked = positions.select(F.col(column).cast("bigint").alias("at"), F.lit(None).cast("struct<base bigint, name string, tokens bigint>").alias("file"), F.lit(1).alias("ask"))
    both = listed.select(F.col("base").alias("at"), file.alias("file"), F.lit(0).alias("ask")).union(asked.select("at", "file", "ask")).withColumn("_tie", F.monotonically_increasing_id())
    # the last file that begins at or before a position is the running maximum along the array
    placed = running_agg(both, [], ["at", "ask", "_tie"], ["file"], "max", suffix="_of").where("ask = 1").select("at", "file_of.*")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        last, source, f = None, None, None
        for b in batches:
            out = []
            for at, base, name, tokens in zip(*(c.to_pylist() for c in b.columns)):
                if name is None or at is None or not 0 <= at - base < tokens:
                    out.append(None)
                    continue
                if name != last:
                    if source is not None:
                        source.close()
                    last, source = name, files.open_input_file(f"{path}/{name}")
                    f = TokenFile(source)
                out.append(f.token(at - base))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=[column, "token"])

    return placed.select("at", "base", "name", "tokens").sortWithinPartitions("name", "at").mapInArrow(read, f"`{column}` bigint, token bigint")


def round_trip(docs: DataFrame, tokenizer: JsonTokenizer, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the files and read every document back from them."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer, folder, end_id)
    return read_documents(docs.sparkSession, folder)
