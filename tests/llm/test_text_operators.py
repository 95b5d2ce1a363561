"""Tokenising, packing, line and exact deduplication, sharding: against brute force over a small table."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import CLASH, clashing, docs, no_docs, rows, same_rows  # noqa: F401
from pyspark.sql import functions as F

from labelflow.llm import exact_dedup, line_dedup, packing, pieces, sharding
from labelflow.llm.common import stored

WS = re.compile(r"[\x20\x09-\x0D]")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# -- pieces

@pytest.fixture(scope="module")
def sp():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_library(rows, clashing, no_docs, sp):
    model = public_tokenizers.path("piece_bpe_32k.model")
    want = []
    for d, t, *_ in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(sp.decode(ids))))
    assert same_rows(pieces.encode_decode(clashing, model).collect(), want)
    full = pieces.encode_decode(clashing, model, with_text=True).where("doc_id = 1").first()
    assert full.ids == sp.encode(rows[2][1], add_bos=True, add_eos=True) and full.decoded == rows[2][1]
    assert pieces.encode_decode(no_docs, model).collect() == []


def test_chunk_table_on_odd_texts(sp):
    rng, table = random.Random(1), pieces.ChunkTable(sp)
    for _ in range(3000):
        t = "".join(rng.choice(" a▁b\n\t  éx①ﬁ.") for _ in range(rng.randrange(12)))
        assert np.frombuffer(table.encode(t), "<u4").tolist() == sp.encode(t), repr(t)


def test_chunk_table_is_bounded(sp, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_ROWS", 3)
    table = pieces.ChunkTable(sp)
    text = "one two three four five six one two"
    assert np.frombuffer(table.encode(text), "<u4").tolist() == sp.encode(text) and len(table) <= 3


# -- packing

@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TOKENIZER = packing.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_ids_equal_the_tokenizers_library(tok):
    rng = random.Random(2)
    encoding = packing.byte_encoding(TOKENIZER.ranks_file, TOKENIZER.pattern, TOKENIZER.special)
    for _ in range(5000):
        t = "".join(rng.choice([" ", "a", "b'", "s", "\n", " \t", "é", "9", "!", "\u3000", "<|endoftext|>", "\xa0", "\x1c", "\x85", "\u200b", "Ǆ", "e\u0301", "½", "٣", "的", "😀"]) for _ in range(rng.randrange(10)))
        assert packing.token_ids(encoding, t).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(rows, clashing, no_docs, tok):
    got = packing.pack(clashing, TOKENIZER, 256, 1).collect()
    ids = [(d, tok.encode(t or "", add_special_tokens=False).ids + [1]) for d, t, *_ in rows]
    want = [(d, s, min(256, len(x) - s), zlib.crc32(np.array(x[s:s + 256], "<u4").tobytes()), len(x)) for d, x in ids for s in range(0, len(x), 256)]
    assert same_rows([tuple(r)[:5] for r in got], want)
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 256
    total = sum(len(x) for _, x in ids)
    assert len(fill) * 256 <= total * 1.05 + 256 * 8  # one open window a task
    assert packing.pack(no_docs, TOKENIZER).collect() == []


def test_best_fit_decreasing_against_scan():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 800)
    seq, off = packing.best_fit_decreasing(lengths, 100)
    left, seq2 = [], np.empty(len(lengths), int)
    for i in np.argsort(-lengths, kind="stable"):
        fits = [w for w, c in enumerate(left) if c >= lengths[i]]
        w = min(fits, key=lambda w: left[w], default=None)
        if w is None:
            left.append(100)
            w = len(left) - 1
        left[w] -= lengths[i]
        seq2[i] = w
    assert len(left) == seq.max() + 1
    assert sorted(np.bincount(seq, lengths)) == sorted(100 - np.array(left))


# -- lines

def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    rank = lambda d: -10 ** 18 if d is None else d
    held = defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(rank(d))
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and max(held[key(x)]) != rank(d))]
        out.append((d, len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    return out


@pytest.mark.parametrize("min_chars, min_docs", [(40, 5), (3, 2)])
def test_line_dedup(rows, clashing, no_docs, min_chars, min_docs):
    assert same_rows(line_dedup.dedup_lines(clashing, min_chars, min_docs).collect(), brute_lines(rows, min_chars, min_docs))
    assert line_dedup.dedup_lines(no_docs).collect() == []


def test_hot_line_spans_partitions(spark):
    hot, rng = "the one line that nearly all documents of this table share", random.Random(4)
    rows = [(i, f"{hot}\nown line {i} with enough characters to count, too\n{rng.choice('abc') * 45}", None, None, None) for i in range(3000)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(16))
    assert same_rows(got.collect(), brute_lines(rows))


# -- exact copies

def brute_groups(rows, norm=lambda t: WS.sub("", t)):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[norm(t or "")].append((d, t or ""))
    out = []
    for k, v in groups.items():
        keep = sorted(v, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        out += [(d, keep[0], len(v), d == keep[0] and len(t) == len(keep[1]), sha(k)) for d, t in v]
    return out


COLS = ["id", "keep_id", "group_size", "kept"]


def test_exact_groups(rows, clashing, no_docs):
    got = exact_dedup.exact_groups(clashing).select(*COLS, "digest").collect()
    assert same_rows(got, brute_groups(rows))
    assert exact_dedup.exact_groups(no_docs).collect() == []


def test_colliding_digests_are_told_apart_by_bytes(rows, docs):
    weak = lambda norm: F.pmod(F.length(norm), F.lit(7)).cast("string")
    got = exact_dedup.exact_groups(docs, digest=weak).select(*COLS).collect()
    assert same_rows(got, [r[:4] for r in brute_groups(rows)])


def test_state_goes_on_between_runs(docs, tmpdir_path):
    fp = exact_dedup._norm_rows(docs, exact_dedup.sha256_hex, None).select("digest", "id", "n_cp", "locator")
    once = {r.digest: r.group_size for r in exact_dedup.fold_into_state(fp, tmpdir_path + "/log", tmpdir_path + "/state").collect()}
    twice = {r.digest: r.group_size for r in exact_dedup.fold_into_state(fp, tmpdir_path + "/log", tmpdir_path + "/state").collect()}
    assert twice == {k: 2 * n for k, n in once.items()}


def test_drop_exact_copies(rows, clashing, no_docs):
    want = {(d, s) for d, _, _, kept, s in brute_groups(rows) if kept}
    for table in (clashing, stored(clashing, "test-docs")):
        got = exact_dedup.drop_exact_copies(table)
        assert got.columns == clashing.columns and set(CLASH) <= set(got.columns)
        left = [(r.doc_id, sha(WS.sub("", r.text or ""))) for r in got.collect()]
        assert set(left) == want
        assert len({s for _, s in left}) == len(left) == len(want)
    assert exact_dedup.drop_exact_copies(no_docs).collect() == []


# -- sharding

def jump(key, n):
    key, b, j = key & (2 ** 64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2 ** 64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_loop(spark):
    df = spark.range(0, 3000).select(F.xxhash64("id").alias("k"))
    got = df.select("k", sharding.jump_shard(F.col("k"), 24).alias("a"), sharding.jump_shard(F.col("k"), 25).alias("b"), sharding.jump_shard(F.col("k"), 1).alias("c")).collect()
    assert all((r.a, r.b, r.c) == (jump(r.k, 24), jump(r.k, 25), 0) for r in got)


def test_sharding(rows, clashing, no_docs):
    got = sharding.shard_documents(clashing.repartition(5), 24).collect()
    want = [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows]
    assert same_rows([tuple(r)[:3] for r in got], want)
    slots, place = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert place.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(no_docs).collect() == []


def test_growth_moves_the_necessary_fraction(spark):
    df = spark.range(0, 20_000).select(F.xxhash64("id").alias("k"))
    s = sharding.jump_state(F.col("k"), 24)
    moved = df.where(s["j"] == 24).count()
    assert abs(moved / 20_000 - 1 / 25) < 0.01
