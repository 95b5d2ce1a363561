"""Directly addressable token files: codes against plain arrays, files against the tokenizers library."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import clashing, docs, no_docs, rows, same_rows  # noqa: F401

from labelflow.llm import token_files as T

TOKENIZER = T.JsonTokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(TOKENIZER.file)


class Counting(pa.BufferReader):
    """A file that counts the bytes read from it."""

    taken = 0

    def read(self, n=None):
        self.taken += n or 0
        return super().read(n)


def file_of(documents):
    w, out = T.FileWriter(), io.BytesIO()
    for d, ids in documents:
        w.add(d, np.array(ids, "<u4"))
    w.write(out)
    return Counting(out.getvalue())


@pytest.mark.parametrize("top", [1, 256, 50_257, 1 << 24, 1 << 32])
def test_every_token_is_addressable(top):
    rng = np.random.default_rng(top % 997)
    documents = [(i - 3 if i % 7 else None, (rng.random(n := int(rng.integers(1, 900))) ** 3 * top).astype(np.uint32)) for i in range(12)]
    flat, source = np.concatenate([x for _, x in documents]), None
    f = T.TokenFile(source := file_of(documents))
    assert (f.docs, f.tokens) == (12, len(flat)) and f.document_ids() == [d for d, _ in documents]
    assert [f.token(i) for i in range(len(flat))] == flat.tolist()
    for _ in range(300):
        lo, hi = sorted(rng.integers(0, len(flat) + 1, 2).tolist())
        assert f.slice(lo, hi).tolist() == flat[lo:hi].tolist()
    for run in (1, 700, 10 ** 6):
        got = list(f.documents(run))
        assert [j for j, _, _ in got] == list(range(12)) and np.concatenate([x for _, _, x in got]).tolist() == flat.tolist()
        assert [s for _, s, _ in got] == np.cumsum([0] + [len(x) for _, x in documents])[:-1].tolist()
    assert f.document(5).tolist() == documents[5][1].tolist()
    for bad in (-1, len(flat)):
        with pytest.raises(IndexError):
            f.token(bad)


def test_a_token_costs_a_few_bytes_of_a_large_file():
    ids = np.random.default_rng(1).integers(0, 50_257, 400_000)
    source = file_of([(1, ids)])
    f = T.TokenFile(source)
    for i in (0, 511, 512, 77_777, 399_999):
        source.taken = 0
        assert f.token(i) == ids[i] and source.taken <= len(f.levels) * (1 + 64 + 8)
    assert source.size() < 2.6 * len(ids)


def test_rank_directory():
    on = np.random.default_rng(2).random(5000) < 0.4
    bits = T.pack_bits(on)
    assert T.rank_directory(bits).tolist() == [int(on[: b * 512].sum()) for b in range(len(bits) // 64 + 1)]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        T.TokenFile(pa.BufferReader(b"something else, of some length"))


def test_pre_token_table_equals_the_library(library, monkeypatch):
    rng, table = random.Random(2), T.PreTokenTable(TOKENIZER)
    pick = [" ", "a", "b'", "s", "\n", " \t", "é", "9", "!", "　", "<|endoftext|>", "\xa0", "\x1c", "\x85", "​", "Ǆ", "é", "½", "٣", "的", "😀", "<|", "\x00"]
    texts = ["".join(rng.choice(pick) for _ in range(rng.randrange(10))) for _ in range(3000)]
    monkeypatch.setattr(T, "TABLE_ROWS", 500)
    for lo in range(0, 3000, 100):
        got = table.encode(texts[lo: lo + 100])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts[lo: lo + 100]]


def order(r):
    return r[0] is not None, r[0] or 0


def test_files_hold_the_documents_in_order(spark, rows, clashing, no_docs, library, tmpdir_path):
    ordered = sorted(rows, key=order)
    want, ids, at = [], [], 0
    for d, t, *_ in ordered:
        x = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        ids += x
    # files of a few hundred tokens, over several partitions; rows of one identifier keep the input's order
    manifest = T.write_token_files(clashing.coalesce(1), TOKENIZER, tmpdir_path, file_tokens=700)
    files = manifest.orderBy("part", "file").collect()
    assert len(files) > 8 and [f.base for f in files] == np.cumsum([0] + [f.tokens for f in files])[:-1].tolist()
    got = sorted(T.read_documents(spark, tmpdir_path, with_ids=True).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == want
    assert [r.start for r in got] == np.cumsum([0] + [n for _, n, _ in want])[:-1].tolist()
    assert [i for r in got for i in r.ids] == ids
    asked = spark.createDataFrame([(i,) for i in [*range(0, len(ids), 997), 0, 0, len(ids) - 1, len(ids), -1, None]], "position bigint")
    found = {r.position: r.token for r in T.tokens_at(asked, tmpdir_path).collect()}
    assert found == {i: ids[i] for i in [*range(0, len(ids), 997), len(ids) - 1]} | {len(ids): None, -1: None, None: None}
    assert T.round_trip(no_docs, TOKENIZER).collect() == []


def test_partitions_do_not_matter(clashing):
    a, b = (T.round_trip(clashing.repartition(n), TOKENIZER).select("doc_id", "n_tokens", "ids_crc32").collect() for n in (1, 7))
    assert same_rows(a, b)


def test_a_hot_identifier_spans_partitions(spark, tmpdir_path):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "concat('text number ', id) as text").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = T.write_token_files(df, TOKENIZER, tmpdir_path).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(f.docs for f in files) < 1000 and sum(f.docs for f in files) == 3000


def test_narrow_pattern_cuts_alike():
    import re

    import regex
    wide, narrow = regex.compile(TOKENIZER.pattern), re.compile(T.narrow_pattern(TOKENIZER.pattern))
    for c in map(chr, range(T.NARROW)):
        for t in (f"a{c}1 {c} b", f"  {c}{c}\n{c}'s9", f"{c} "):
            assert wide.findall(t) == narrow.findall(t), repr(t)
