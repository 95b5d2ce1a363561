"""The n-gram Jaccard join against all pairs, its parts, and connected components."""

import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from helpers import CLASH, DOC, clashing, docs, no_docs, rows, same_rows, words  # noqa: F401

from labelflow.llm import near_dup
from labelflow.llm.components import components
from labelflow.llm.words import WordHash, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(t or "")
    return {tuple(w[i:i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=Fraction(4, 5)):
    """(doc_id, class_id, n_links) by comparing all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(find(i)), r[0]) if x is not None]
        least[find(i)] = min(ids, default=None)
    return [(r[0], least[find(i)], links[i]) for i, r in enumerate(rows)]


def test_all_pairs(rows, clashing, no_docs):
    got = near_dup.near_duplicates(clashing).select("doc_id", "class_id", "n_links").collect()
    assert same_rows(got, brute(rows))
    assert near_dup.near_duplicates(no_docs).collect() == []


def chains(n_groups, size, seed):
    """Groups in which each text differs a little from the one before: classes with distant ends."""
    rng, rows = random.Random(seed), []
    for _ in range(n_groups):
        w = words(rng, 120, 100_000).split(" ")
        for _ in range(size):
            w[rng.randrange(len(w))] = f"c{rng.randrange(10 ** 9)}"
            rows.append((len(rows), " ".join(w), None, None, None))
    rng.shuffle(rows)
    return rows


def test_chains_and_recall(spark):
    rows = chains(30, 12, 5)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOC)).select("doc_id", "class_id", "n_links").collect()
    want = {r[0]: r for r in brute(rows)}
    found, there = sum(r.n_links for r in got), sum(r[2] for r in want.values())
    assert found <= there and found >= 0.999 * there
    assert sum(r.class_id == want[r.doc_id][1] for r in got) >= 0.99 * len(rows)


def test_clusters_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_TEXTS", 5)
    rows = chains(4, 23, 6)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOC)).select("doc_id", "class_id", "n_links").collect()
    want = brute(rows)
    assert sum(r.n_links for r in got) >= 0.99 * sum(r[2] for r in want)
    assert {r.doc_id: r.class_id for r in got} == {r[0]: r[1] for r in want}


@pytest.mark.parametrize("left", [0, 7])
def test_verify_group(left):
    rng = np.random.default_rng(8)
    pool = rng.integers(1, 2 ** 63, 60, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(20, 60))) for _ in range(20)]
    weight = rng.integers(1, 5, 20)
    texts, docs, head = near_dup.verify_group(sets, weight, left, 1, 2)
    link = np.zeros((20, 20), bool)
    for i in range(20):
        for j in range(20):
            both = len(np.intersect1d(sets[i], sets[j]))
            link[i, j] = i != j and 2 * both >= len(sets[i]) + len(sets[j]) - both and (not left or (i < left) != (j < left))
    assert (texts == link.sum(1)).all() and (docs == link @ weight).all()
    assert link.any() and all(head[i] == head[j] for i in range(20) for j in range(20) if link[i, j]) and (head <= np.arange(20)).all()


def test_prefix_shortens_until_recall():
    depth = [near_dup.prefix_depth(Fraction(4, 5), r) for r in (0.5, 0.99, 0.999, 0.999999)]
    assert depth == sorted(depth, reverse=True)
    d = depth[2]
    assert 1 - (1 - 0.8 ** d) ** near_dup.TREES >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** near_dup.TREES


def test_minhash_estimates_jaccard():
    rng = np.random.default_rng(9)
    a, b = near_dup.permutations(near_dup.TREES, near_dup.DEPTH)
    x = np.unique(rng.integers(1, 2 ** 63, 1000, dtype=np.uint64))
    same = (near_dup.minhash(x[:900], a, b) == near_dup.minhash(x[100:], a, b)).mean()
    assert abs(same - 0.8) < 0.1


def test_words(rows):
    for _, t, *_ in rows:
        assert words_of(t or "") == WORD.findall(t or "")
    for t in ["a\x1cb c", "a　b", "\x85x y ", " "]:
        assert words_of(t) == WORD.findall(t)
    s = near_dup.shingle_set("a b c d e f a b c d e", WordHash(), 5)
    assert len(s) == 6 and (np.diff(s.astype(object)) > 0).all()


def test_keep_one_per_class(rows, clashing, no_docs):
    got = near_dup.keep_one_per_class(clashing)
    assert got.columns == clashing.columns and set(CLASH) <= set(got.columns)
    want = [d for d, c, _ in brute(rows) if d == c]
    assert sorted(map(repr, (r.doc_id for r in got.collect()))) == sorted(map(repr, want))
    assert near_dup.keep_one_per_class(no_docs).collect() == []


def test_one_of_each_class_stays(spark):
    rng = random.Random(17)
    near = lambda t, k: " ".join([*t.split(" ")[:-1], f"end{k}"])
    a, b, c, d = (words(rng, 100, 100_000) for _ in range(4))
    rows = [(i, t, None, None, None) for i, t in [
        (None, a), (None, near(a, 1)), (None, near(a, 2)),  # no identifier at all
        (3, b), (3, near(b, 1)), (9, near(b, 2)), (None, near(b, 3)),  # the smallest identifier twice
        (5, c), (None, near(c, 1)), (5, d), (None, None), (None, None)]]
    left = sorted((r.text or "" for r in near_dup.keep_one_per_class(spark.createDataFrame(rows, DOC)).select("text").collect()))
    of = lambda t: [x for x in left if x[:60] == t[:60]]
    assert len(of(a)) == len(of(b)) == 1 and of(c) == [c] and of(d) == [d] and len(left) == 6
    assert of(b)[0] in (b, near(b, 1))


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1700)] + [(5000 + i, 5001 + i) for i in range(200)] + [(9000, 9001 + i) for i in range(500)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    groups = defaultdict(list)
    for x in list(root):
        groups[find(x)].append(x)
    got = components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(6)).collect()
    assert sorted((r.node, r.comp) for r in got) == sorted((x, min(v)) for v in groups.values() for x in v)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []
