"""Importance resampling: hashing against zlib, the draw against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DOC, clashing, docs, no_docs, rows, same_rows  # noqa: F401

from labelflow.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i: i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target, percent, min_words, buckets, seed):
    bag = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])
    s, t = bag(r[1] for r in rows), bag(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for d, text, *_ in rows:
        n, f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, [r[:4] for r in able[: percent * len(able) // 100]]


def test_crc_of_rows_and_spans():
    rng, table = np.random.default_rng(1), R.crc_table()
    m = rng.integers(0, 256, (50, 33), dtype=np.uint8)
    assert R.crc_rows(m, table).tolist() == [zlib.crc32(r.tobytes()) for r in m]
    buffer = rng.integers(0, 256, 5000, dtype=np.uint8)
    start, length = rng.integers(0, 3000, 400), np.where(rng.random(400) < 0.1, 1500, rng.integers(1, 40, 400))
    assert R.crc_spans(buffer, start, length, table).tolist() == [zlib.crc32(buffer[s: s + n].tobytes()) for s, n in zip(start, length)]


@pytest.mark.parametrize("block", [1 << 21, 300, 40])
def test_buckets_of_texts(monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK_BYTES", block)
    rng = random.Random(block)
    texts = ["", "a", "A b", "  ", "é É_z 9\x7f[]x", "one two three four", "x" * 5000 + " y", " ".join(f"w{rng.randrange(300)}" for _ in range(4000))]
    texts += ["".join(rng.choice(["a", "B", " ", "\n", "é", "1", "_", "的", "x y", "\x1c", " "]) for _ in range(rng.randrange(900))) for _ in range(200)]
    for t, (n_words, n, found, counts) in zip(texts, R.text_buckets(texts, 1000, R.crc_table())):
        words, f = features(t)
        want = np.bincount(np.array([zlib.crc32(x.encode()) % 1000 for x in f], int), minlength=1000)
        assert (n_words, n) == (words, len(f)) and (found is None) == (n > 1000)
        assert ((np.bincount(found, minlength=1000) if counts is None else counts) == want).all()


@pytest.mark.parametrize("buckets, min_words, percent", [(10_000, 20, 5), (50, 3, 30), (100_000, 1, 100)])
def test_resampling(spark, rows, clashing, buckets, min_words, percent):
    target = ["w1 w2 w3 and w4", "This shared line is long", None, rows[0][1]]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = R.resample(clashing.repartition(5), bench, percent, min_words, buckets, 42).collect()
    every, drawn = brute(rows, target, percent, min_words, buckets, 42)
    assert same_rows([tuple(r)[:4] + (r.n_words,) for r in got], every)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [tuple(r)[:4] for r in ranked] == drawn


def test_drawn_documents(spark, rows, clashing):
    from labelflow.llm.common import stored

    df = stored(clashing, "test-docs")
    bench = spark.createDataFrame([(1, rows[0][1])], "item_id bigint, text string")
    got = R.drawn_documents(df, R.resample(df, bench, 30, 3)).collect()
    _, drawn = brute(rows, [rows[0][1]], 30, 3, 10_000, 42)
    assert got[0].asDict().keys() == clashing.first().asDict().keys()
    assert Counter(r.doc_id for r in got) == Counter(d for d, *_ in drawn)


def test_the_draw_leans_to_the_target(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh" if i % 4 else "pqrstuvw") * 3 for _ in range(60)), None, None, None) for i in range(600)]
    bench = spark.createDataFrame([(1, " ".join(rng.choice("pqrstuvw") * 3 for _ in range(2000)))], "item_id bigint, text string")
    got = R.resample(spark.createDataFrame(rows, DOC), bench, 10).where("rank is not null").collect()
    assert len(got) == 60 and all(r.doc_id % 4 == 0 for r in got)


def test_empty_tables(spark, docs, no_docs):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert R.resample(no_docs, bench).collect() == []
    got = R.resample(docs, bench).collect()
    assert len(got) == docs.count() and sum(r["rank"] is not None for r in got) == sum(r.n_words >= 20 for r in got) * 5 // 100
