"""SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the model crosses from a non-marker into a whitespace marker (checked when a task starts), so
merges never cross the start of a marker run: a text is cut there, each distinct marked word is segmented
once, and the ids are joined back by position. The table of distinct words is kept by each task across its
batches and emptied at a fixed number of entries, so its memory is bounded; words over a fixed length are
segmented on their own and not remembered. Nothing is shuffled.

Defined cases: a null text is the empty text, which has the begin and end ids alone; literal markers count as
spaces, as the library itself reads them; repeated rows give repeated rows; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: a run of spaces with what follows it
CHUNK = re.compile(" +[^ ]*")
#: a second space in a row, or one at either end: the text can't be cut by split(" ")
UNEVEN = re.compile("^ |  | $")
#: table entries before it is emptied, and the longest word that it holds
TABLE_ROWS, TABLE_WORD = 400_000, 48


def cuts_are_safe(sp) -> bool:
    """No piece has a marker after a non-marker, and the normaliser only adds and escapes spaces."""
    crossing = re.compile(f"[^{MARK}]{MARK}")
    return (not any(crossing.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size()))
            and sp.normalize("a  ﬁ b ") == f"{MARK}a{MARK}{MARK}ﬁ b{MARK}")


class ChunkTable(dict):
    """Word (a chunk without its first marker) to its ids as little-endian bytes."""

    def __init__(self, sp):
        super().__init__()
        self.sp = sp
        self.lone = self._ids([sp.piece_to_id(MARK)])

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        # encode() puts the first marker back; a marker on its own has no text to put it before
        got = self._ids(self.sp.encode(word)) if word else self.lone
        if len(word) <= TABLE_WORD:
            if len(self) >= TABLE_ROWS:
                self.clear()
            self[word] = got
        return got

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if MARK in text:
            text = text.replace(MARK, " ")
        words = [c[1:] for c in CHUNK.findall(" " + text)] if UNEVEN.search(text) else text.split(" ")
        return b"".join(map(self.__getitem__, words))


def encode_decode(docs: DataFrame, model: str, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; with_text adds ids and decoded text."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        if not cuts_are_safe(sp):
            raise ValueError("this model's pieces may cross whitespace markers; the distinct-chunk table does not hold for it")
        table, begin, end = ChunkTable(sp), ChunkTable._ids([sp.bos_id()]), ChunkTable._ids([sp.eos_id()])
        for b in batches:
            n, enc, dec, ids_out, texts = [], [], [], [], []
            for t in b.column(1):
                raw = begin + table.encode(t.as_py() or "") + end
                ids = array("I", raw).tolist()
                back = sp.decode(ids)
                n.append(len(ids))
                enc.append(hashlib.sha256(raw).hexdigest())
                dec.append(hashlib.sha256(back.encode()).hexdigest())
                if with_text:
                    ids_out.append(ids)
                    texts.append(back)
            cols = {"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(enc, pa.string()), "decoded_sha256": pa.array(dec, pa.string())}
            if with_text:
                cols |= {"ids": pa.array(ids_out, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(run, schema)
