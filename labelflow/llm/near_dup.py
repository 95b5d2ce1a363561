"""N-gram Jaccard join through MinHash banding, followed by exact verification.

1. Each text becomes its set of word shingles; equal sets are one text (node) from here on, so copies cost nothing.
   Its signature is cut into labels, one per tree, of `depth` 16-bit values.
2. The labels are range-partitioned and sorted by (tree, label), and a linear scan compares a prefix of fixed depth with
   the label before it: the longest depth at which pairs at the threshold meet with the target recall in some tree, by
   formula and not by the data. Each run of equal prefixes gives a star of links to its
   first label; runs that cross a partition's edge are joined by one link per edge.
3. Connected nodes of these links form candidate clusters. A cluster's texts are dealt to blocks of bounded size, and
   each pair of blocks is one group, in which all pairs are compared exactly: shingles with the same holders are one
   weighted column, and the intersections are a matrix product. No pair leaves the group: it returns per node the
   number of links, and links to the first node of its class.
4. Classes are the connected components of the verified links.

Defined cases: null and empty texts have no shingle, link to nothing and are a class of their own; a text of one to
four words has one shingle, all its words; repeated rows and copies link to each other; identifiers may be null or
repeat (the class takes the smallest non-null one); an empty table gives no rows; extra columns are ignored.
Nodes are 63-bit hashes of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import sparing, stored, text_or_empty, unused
from labelflow.llm.components import components
from labelflow.llm.words import WordHash, mix, ngram_hashes, word_hashes, words_of

TREES, DEPTH = 32, 8
#: of a group of the exact comparison: texts and shingles per block
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 1 << 20


def prefix_depth(threshold: Fraction, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that pairs at the threshold share in some tree with at least this recall."""
    while depth > 1 and 1 - (1 - float(threshold) ** depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_set(text: str, table: WordHash, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    words = words_of(text)
    return np.unique(ngram_hashes(word_hashes(words, table), min(n, len(words)))) if words else np.empty(0, np.uint64)


def permutations(trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)


def minhash(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 64):
        np.minimum(best, ((x[lo: lo + 64, None] ^ b) * a).min(axis=0), out=best)
    return best


def signatures(docs: DataFrame, n: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, row, node (null: no shingle), n_shingles, labels (trees of `depth` 16-bit values, as bytes)."""
    a, b = permutations(trees, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        table = WordHash()
        for batch in batches:
            node, size, labels = [], [], []
            for t in batch.column(2):
                s = shingle_set(t.as_py(), table, n)
                size.append(len(s))
                node.append(xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 if len(s) else None)
                # the top bits are the even ones; big-endian bytes sort as the values do
                labels.append((mix(minhash(s, a, b).astype(np.uint64)) >> np.uint64(48)).astype(">u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(labels, pa.binary())],
                                             names=["doc_id", "row", "node", "n_shingles", "labels"])

    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    return rows.mapInArrow(sparing(run), "doc_id bigint, row bigint, node bigint, n_shingles int, labels binary")


def _scan_trie(prefix: int):
    """Links of a sorted partition of (tree, label, node): each label to the first of its run of equal prefixes.
    The partition's first and last run are also returned, to be joined over its edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, last_tree, last_key, head, first = TaskContext.get().partitionId(), None, None, None, None
        out = lambda u, v, kind, tree, key: pa.RecordBatch.from_arrays(
            [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(np.full(len(u), kind, np.int32)), pa.array(np.full(len(u), pid, np.int32)), pa.array([tree] * len(u), pa.int32()), pa.array([key] * len(u), pa.binary())],
            names=["u", "v", "kind", "pid", "tree", "key"])
        for b in batches:
            if not b.num_rows:
                continue
            tree, node = b.column(0).to_numpy(), b.column(2).to_numpy()
            label = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            # common prefix with the label before it, in values
            same = np.ones(len(node), bool)
            same[1:] = (tree[1:] == tree[:-1]) & (label[1:, : 2 * prefix] == label[:-1, : 2 * prefix]).all(axis=1)
            key0 = label[0, : 2 * prefix].tobytes()
            same[0] = last_key == key0 and last_tree == tree[0]
            at = np.maximum.accumulate(np.where(same, -1, np.arange(len(node))))
            heads = np.where(at >= 0, node[np.maximum(at, 0)], head if head is not None else 0)
            if first is None:
                first = (int(node[0]), int(tree[0]), key0)
            linked = same & (heads != node)
            yield out(node[linked], heads[linked], 0, None, None)
            last_tree, last_key, head = tree[-1], label[-1, : 2 * prefix].tobytes(), int(heads[-1])
        if first is not None:
            yield out(np.array([first[0]]), np.array([first[0]]), 1, first[1], first[2])
            yield out(np.array([head]), np.array([head]), 2, int(last_tree), last_key)

    return run


def candidate_links(texts: DataFrame, prefix: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(u, v) links from the sorted tries; texts: node, labels."""
    entries = texts.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda i: F.col("labels").substr(i * 2 * depth + 1, F.lit(2 * depth)))).alias("tree", "label"))
    ordered = entries.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    found = stored(ordered.select("tree", "label", "node").mapInArrow(_scan_trie(prefix), "u bigint, v bigint, kind int, pid int, tree int, key binary"), "near-dup-trie")
    # a run that goes on over one or more edges: all its parts share (tree, key); at most two rows a partition
    edges = found.where("kind > 0").groupBy("tree", "key").agg(F.min("u").alias("hub"), F.collect_set("u").alias("us"))
    over = edges.select(F.explode("us").alias("u"), F.col("hub").alias("v"))
    return found.where("kind = 0").select("u", "v").unionByName(over.where("u <> v"))


def verify_group(sets: list[np.ndarray], weight: np.ndarray, left: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact links among texts: (text links, document links, class head) of each text.
    The first `left` texts are compared with the rest; left 0 compares all with all."""
    k = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(k), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    start = np.flatnonzero(new)
    held = np.diff(np.append(start, len(flat)))
    # one column for all shingles with the same holders; shingles of one text meet no other
    mark = mix(np.arange(1, k + 1, dtype=np.uint64))[row]
    pattern = np.add.reduceat(mark, start)[held > 1] if len(start) else np.empty(0, np.uint64)
    start, held = start[held > 1], held[held > 1]
    _, which, many = np.unique(pattern, return_index=True, return_counts=True)
    inter = np.zeros((k, k), np.float32)
    for lo in range(0, len(which), 4096):
        cols = which[lo: lo + 4096]
        m = np.zeros((k, len(cols)), np.float32)
        n = held[cols]
        at = np.repeat(start[cols] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        m[row[at], np.repeat(np.arange(len(cols)), n)] = 1
        inter += (m * many[lo: lo + 4096].astype(np.float32)) @ m.T
    inter = np.rint(inter).astype(np.int64)
    link = inter * (num + den) >= num * (size[:, None] + size[None, :])
    np.fill_diagonal(link, False)
    if left:
        link[:left, :left] = False
        link[left:, left:] = False
    head = np.arange(k)
    while True:  # smallest index reachable, by repeated minima over neighbours
        near = np.where(link, head[None, :], k).min(axis=1)
        nxt = np.minimum(head, near)
        nxt = np.minimum(nxt, nxt[nxt])
        if (nxt == head).all():
            break
        head = nxt
    return link.sum(axis=1), link @ weight, head


def _verify(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, key, sets, nodes, weights, blocks = WordHash(), None, [], [], [], []

        def flush():
            left = 0 if key[1] == key[2] else blocks.count(key[1])  # sorted by block
            if len(sets) > 1 and (key[1] == key[2] or 0 < left < len(sets)):
                texts, docs, head = verify_group(sets, np.array(weights, np.int64), left, num, den)
                hit = np.flatnonzero(texts)
                ids = np.array(nodes, np.int64)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[head[hit]]), pa.array(texts[hit].astype(np.int64)), pa.array(docs[hit].astype(np.int64)), pa.array(np.full(len(hit), key[3]))],
                                                     names=["node", "head", "n_texts", "n_docs", "split"])

        for b in batches:
            for cluster, lo, hi, split, blk, node, w, text in zip(*(c.to_pylist() for c in b.columns)):
                if key != (cluster, lo, hi, split):
                    if key is not None:
                        yield from flush()
                    key, sets, nodes, weights, blocks = (cluster, lo, hi, split), [], [], [], []
                if nodes and nodes[-1] == node:
                    continue  # a repeated row
                sets.append(shingle_set(text, table, n))
                nodes.append(node)
                weights.append(w)
                blocks.append(blk)
        if key is not None:
            yield from flush()

    return run


def near_duplicates(docs: DataFrame, threshold: Fraction = Fraction(4, 5), n: int = 5, recall: float = 0.999) -> DataFrame:
    """One row per row of docs: doc_id, row (hash of the text), class_id (smallest doc_id of its class), n_links (other
    documents of at least this similarity), n_text_links (other texts of that kind), n_shingles, first (whether (doc_id,
    row) is the smallest of its class, null identifiers last)."""
    sig = stored(signatures(docs, n), "near-dup-signatures")
    one = sig.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels"))
    texts = stored(one, "near-dup-texts")
    clusters = components(candidate_links(texts, prefix_depth(threshold, recall)))
    members = stored(clusters.join(texts.select("node", "rep", "copies", "n_shingles"), "node"), "near-dup-members")
    need = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    blocks = members.groupBy("comp").agg(need.alias("nb"))
    dealt = (members.join(blocks, "comp")
             .select("comp", "node", "copies", "nb", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("blk"), F.col("rep.doc_id").alias("r_doc"), F.col("rep.row").alias("r_row")))
    text = text_or_empty()
    full = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    with_text = full.join(dealt.hint("shuffle_hash"), (F.col("row") == F.col("r_row")) & F.col("doc_id").eqNullSafe(F.col("r_doc")))
    paired = (with_text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
              .select("comp", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), (F.col("nb") > 1).alias("split"), "blk", "node", "copies", "text"))
    keys = ["comp", "lo", "hi"]
    found = paired.repartition(*keys).sortWithinPartitions(*keys, "blk", "node").mapInArrow(
        _verify(n, threshold.numerator, threshold.denominator), "node bigint, head bigint, n_texts bigint, n_docs bigint, split boolean")
    found = stored(found, "near-dup-verified")
    # a cluster of one group has its classes; those of several groups are joined over their links
    joined = components(found.where("split").select(F.col("node").alias("u"), F.col("head").alias("v")))
    heads = found.where("not split").select("node", F.col("head").alias("comp")).unionByName(joined)
    class_of = heads.join(texts.select("node", "rep"), "node").groupBy("comp").agg(F.min("rep").alias("first"))
    counts = found.groupBy("node").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    linked = heads.join(class_of, "comp").join(counts, "node").select("node", "first", "n_texts", "n_docs")
    per_text = texts.select("node", "rep", "copies").join(linked, "node", "left").select(
        "node", F.coalesce("first", "rep").alias("first"), (F.col("copies") - 1 + F.coalesce("n_docs", F.lit(0))).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_text_links"))
    return (sig.select("doc_id", "row", "node", "n_shingles").join(per_text, "node", "left")
            .select("doc_id", "row", F.coalesce("first.doc_id", F.when(F.col("node").isNull(), F.col("doc_id"))).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("bigint").alias("n_text_links"), "n_shingles",
                    (F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")))).alias("first")))


def keep_one_per_class(docs: DataFrame, **options) -> DataFrame:
    """The document of each class with the smallest (doc_id, hash of the text), null identifiers last, all columns (rows equal
    in both stay together; texts without a shingle all stay)."""
    mine, doc, row = unused(docs, "own row"), unused(docs, "kept doc"), unused(docs, "kept row")
    stay = near_duplicates(docs, **options).where("first").select(F.col("doc_id").alias(doc), F.col("row").alias(row)).distinct()
    keyed = docs.withColumn(mine, F.xxhash64(text_or_empty()))
    return keyed.join(stay.hint("shuffle_hash"), (F.col(mine) == F.col(row)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc)), "left_semi").drop(mine)
