"""Quality rules: gradient-boosted trees over document statistics, scored as numpy node arrays.

Every text gets statistics of its words, lines and characters. The fixed rules come first; what passes them is judged
by trees fitted to the labelled rows, at most `max_train_rows` of them (chosen by a hash of the identifier when there are
more). Symbols, repeats, duplicate lines, capitals and exclamation marks can only lower the score (monotonic
constraints).

Defined cases: a null or empty text has zero words and fails the rules; without labels, or with one class among them,
the rules alone decide; a label row is used for every row of its identifier, and of contradicting labels the lower one
holds; repeated rows are judged alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm import gbt
from labelflow.llm.common import WHITE, sparing
from labelflow.llm.words import WordHash, ngram_hashes, word_hashes, words_of

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: the features, and the direction in which the score may move with each (0: free)
FEATURES = {"log_words": 0, "word_length": 0, "symbol_rate": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "distinct_share": 0,
            "top_word_share": -1, "exclamation_rate": -1, "stop_rate": 0, "alpha_share": 0, "digit_rate": 0, "words_per_line": 0}
MONOTONE = {i: d for i, d in enumerate(FEATURES.values()) if d}


def statistics(text: str, table: WordHash) -> tuple[list[int], list[float]]:
    """The contract's counts and the features of one text."""
    words = words_of(text)
    n, chars = len(words), len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    dup = len(lines) - len(set(lines))
    h = word_hashes(words, table)
    repeated = 0
    if n >= 4:
        _, which, many = np.unique(ngram_hashes(h, 3), return_inverse=True, return_counts=True)
        twice = many[which] > 1
        hit = np.zeros(n, bool)
        for i in range(3):
            hit[i: n - 2 + i] |= twice
        repeated = int(hit.sum())
    d, k = max(n, 1), max(len(lines), 1)
    top = max(Counter(words).values(), default=0)
    features = [np.log1p(n), chars / d, symbols / d, dup / k, repeated / d, sum(len(w) > 1 and w.isupper() for w in words) / d, len(set(words)) / d, top / d,
                text.count("!") / d, text.count(".") / d, sum(map(str.isalpha, words)) / d, sum(map(text.count, "0123456789")) / max(chars, 1), n / k]
    return [n, chars, symbols, dup, repeated], features


def document_statistics(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """doc_id, the counts, the features as an array, and the columns of docs named in keep."""
    passed = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHash()
        for b in batches:
            got = [statistics(t.as_py() or "", table) for t in b.column(1)]
            counts = np.array([c for c, _ in got], np.int64).reshape(-1, len(COUNTS))
            features = [f for _, f in got]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(features, pa.list_(pa.float64())), *b.columns[2:]],
                                             names=["doc_id", *COUNTS, "features", *keep])

    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", features array<double>" + passed
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *keep).mapInArrow(sparing(run), schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """docs (doc_id, text) with their label as y: all labelled rows, or of more than max_rows a share chosen by hash."""
    clean = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("_l")).agg(F.min(F.col(label).cast("int")).alias("y"))
    n = clean.count()
    if n > max_rows:
        clean = clean.where(F.pmod(F.xxhash64("_l"), F.lit(1_000_000)) < F.lit(int(1_000_000 * max_rows / n)))
    # at most about max_rows pairs of an identifier and a label: small enough to broadcast
    return docs.join(F.broadcast(clean), F.col("doc_id").cast("bigint") == F.col("_l")).select("doc_id", "text", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000) -> gbt.Trees:
    """Trees for P(quality = 1), fitted to at most about max_train_rows labelled rows."""
    sample = document_statistics(labelled_sample(docs, labels, "quality", max_train_rows), ["y"])
    rows = sample.where("n_words > 0").select("doc_id", "features", "y").orderBy("doc_id", "features").toPandas()
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    return gbt.fit(x, rows["y"].to_numpy(float), MONOTONE)


def judge(docs: DataFrame, model: gbt.Trees, keep_at: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, p_good, kept."""
    trained = len(model.feature) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = {c: b.column(i + 1).to_numpy() for i, c in enumerate(COUNTS)}
            x = b.column(len(COUNTS) + 1).flatten().to_numpy().reshape(-1, len(FEATURES))
            failed = (t["n_words"] < 50) | (100 * t["n_repeat_words"] > 50 * t["n_words"])
            p = model.probability(x) if trained else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(COUNTS) + 1], pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))], names=["doc_id", *COUNTS, "base_failed", "p_good", "kept"])

    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, p_good double, kept boolean"
    return document_statistics(docs).mapInArrow(sparing(run), schema)


def keep_good(docs: DataFrame, model: gbt.Trees, keep_at: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, all columns: decided in the pass that reads the text, nothing is joined."""
    schema, names = docs.schema, docs.columns
    trained = len(model.feature) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at = WordHash(), names.index("text")
        for b in batches:
            got = [statistics(t.as_py() or "", table) for t in b.column(at)]
            counts = np.array([c for c, _ in got], np.int64).reshape(-1, len(COUNTS))
            x = np.array([f for _, f in got], float).reshape(-1, len(FEATURES))
            ok = (counts[:, 0] >= 50) & (100 * counts[:, 4] <= 50 * counts[:, 0])
            if trained:
                ok &= model.probability(x) >= keep_at
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(sparing(run), schema)
