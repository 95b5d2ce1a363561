"""Toxicity by maximum-scoring segments of token log-odds.

Weights: for every word, and every beginning of four to eight letters (inflected forms share it), the log-odds of its
document frequency among toxic against other labelled texts, under a Dirichlet prior in proportion to its frequency
overall. Of copies (equal shingle sets) with one label one text is counted; near copies of one label share the weight of one
text; all others count in full, whatever passages they share. Units whose log-odds lie within a few standard deviations of
zero, or are small, are left out. A word weighs as its most significant unit; without one it is neutral, a penalty
large enough that the expected score of clean text is negative. Texts are
scanned in linear time for all maximal scoring segments (Ruzzo and Tompa). Segment scores are calibrated by extreme
values: lambda solves sum p(w) exp(lambda s(w)) = 1 over clean text, and a segment of score S in n words is expected
n exp(-lambda S) times by chance. The text's score is a logistic function of its segments' calibrated scores. Counts, lambda
and the logistic function come from at most about `max_train_rows` labelled training rows.

Defined cases: a null or empty text has no segment and the score of a clean one; without training labels of
both classes every score is 0; repeated rows score alike; a null identifier is scored like any other; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import sparing, stored
from labelflow.llm.near_dup import minhash, permutations, shingle_set
from labelflow.llm.quality import labelled_sample
from labelflow.llm.words import TABLE_ROWS, WordHash, mix

TOKEN = re.compile(r"[^\W\d_]+")
#: score of a word without significant log-odds, at most (clean text with many weighted words needs a lower one)
NEUTRAL = -0.05
#: minima of a training text's signature (in bands), the share of equal ones that makes two texts near copies, and the integer
#: that stands for the weight of one text (sums of integers do not depend on their order)
BANDS, BAND, NEAR, ONE = 32, 8, 0.8, 1 << 20


def units_of(word: str) -> list[str]:
    """The word, and its beginnings (marked with a star)."""
    return [word, *(word[:k] + "*" for k in range(4, min(len(word), 8) + 1))]


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def maximal_segments(positions: list[int], scores: list[float], gap: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last) of a sequence in which position p[i] scores s[i] and all others
    score `gap` (negative). One pass over the scored positions."""
    # stack of candidates: (cumulative score left of it, cumulative score at its right end, first, last)
    stack: list[list[float]] = []
    total, at = 0.0, -1
    for p, s in zip(positions, scores):
        total += gap * (p - at - 1)
        at = p
        left, total = total, total + s
        if s <= 0:
            continue
        cur = [left, total, p, p]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= cur[0]:
                j -= 1
            if j < 0 or stack[j][1] >= cur[1]:
                stack.append(cur)
                break
            cur = [stack[j][0], cur[1], stack[j][2], cur[3]]
            del stack[j:]
    return [(r - l, int(a), int(b)) for l, r, a, b in stack]


class WordWeights(dict):
    """Word to the weight of its most significant unit (0 without one); emptied at a fixed number of entries."""

    def __init__(self, units: dict[str, tuple[float, float]]):
        super().__init__()
        self.units = units

    def __missing__(self, word: str) -> float:
        if len(self) >= TABLE_ROWS:
            self.clear()
        got = [u for u in map(self.units.get, units_of(word)) if u]
        self[word] = w = max(got, key=lambda u: abs(u[1]))[0] if got else 0.0
        return w

    def __reduce__(self):
        return WordWeights, (self.units,)


@dataclass
class ToxicityModel:
    #: unit to (log-odds, standard score)
    weights: WordWeights = field(default_factory=lambda: WordWeights({}))
    lam: float = 0.0
    gap: float = NEUTRAL
    coef: tuple[float, ...] = (-30.0, 0.0, 0.0)

    def segments(self, text: str) -> tuple[int, list[tuple[float, int, int]]]:
        """Number of words, and the maximal segments (score, first word, last word)."""
        w = list(map(self.weights.__getitem__, tokens_of(text)))
        at = [i for i, v in enumerate(w) if v]
        return len(w), maximal_segments(at, [w[i] for i in at], self.gap) if at else []

    def features(self, text: str) -> tuple[float, float]:
        """Calibrated score of the best segment, and the sum over all that are not expected by chance."""
        n, segs = self.segments(text)
        over = [max(0.0, self.lam * s - np.log(max(n, 1))) for s, _, _ in segs]
        return float(np.log1p(max(over, default=0.0))), float(np.log1p(sum(over)))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        z = self.coef[0] + self.coef[1] * a + self.coef[2] * b
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def solve_lambda(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1, by bisection; the mean score is negative."""
    if not (s > 0).any() or (p * s).sum() >= 0:
        return 0.0
    hi = 1.0
    while (p * np.exp(hi * s)).sum() < 1 and hi < 64:
        hi *= 2
    lo = 0.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * s)).sum() < 1 else (lo, mid)
    return lo


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, weight: np.ndarray | None = None) -> tuple[float, ...]:
    """Newton steps for a penalised logistic function of weighted rows; slopes are not negative."""
    weight = np.ones(len(x)) if weight is None else weight
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    pen = np.array([1e-4] + [l2] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (weight * (y - p)) - pen * w)
        w = w + np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def near_copy_weights(sig: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The weight (of ONE) of each training text, by its signature and label: texts of a label that share a band are compared
    with the first of them, and those of at least NEAR equal minima form a group, which weighs as one text."""
    if not len(sig):
        return np.empty(0, np.int64)
    root = np.arange(len(sig))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for lo in range(0, BANDS * BAND, BAND):
        band = np.ascontiguousarray(sig[:, lo: lo + BAND]).view(f"V{BAND * sig.itemsize}").ravel()
        _, which = np.unique(band, return_inverse=True)
        key = which * 2 + y
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1])
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        i, h = order[~new], head[~new]
        for at in range(0, len(i), 4096):
            near = (sig[i[at: at + 4096]] == sig[h[at: at + 4096]]).mean(axis=1) >= NEAR
            for a, b in zip(i[at: at + 4096][near].tolist(), h[at: at + 4096][near].tolist()):
                a, b = sorted((find(a), find(b)))
                root[b] = a
    group = np.array([find(i) for i in range(len(sig))], np.int64)
    return ONE // np.bincount(group)[group]


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000, prior: float = 100.0, z_scale: float = 0.9, min_log_odds: float = 1.5) -> ToxicityModel:
    """The model of the labelled rows that are not held out. Of the units of that bounded sample, all with
    significant log-odds come to the driver."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        perm = permutations(BANDS, BAND)
        table = WordHash()
        for b in batches:
            node, sig = [], []
            for t in b.column(0):
                s = shingle_set(t.as_py() or "", table, 5)
                node.append(xxhash.xxh3_64_intdigest(s.tobytes()) >> 1)
                sig.append((mix(minhash(s, *perm).astype(np.uint64)) >> np.uint64(48)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(sig, pa.binary())], names=["text", "y", "node", "sig"])

    sample = labelled_sample(docs, labels.where(~is_held_out(F.col("doc_id"))), "toxic", max_train_rows).select("text", "y")
    # the words of a text that was copied often would look significant: of copies with one label the smallest is counted
    once = stored(sample.mapInArrow(sparing(mark), "text string, y int, node bigint, sig binary").groupBy("node", "y").agg(F.min(F.struct("text", "sig")).alias("r"))
                  .select("r.text", "y", "node", "r.sig"), "toxicity-train")
    # the signatures of the bounded sample: half a kilobyte a text
    marked = once.select("node", "y", "sig").orderBy("y", "node").toPandas()
    y = marked["y"].to_numpy(np.int64)
    weight = near_copy_weights(np.frombuffer(b"".join(map(bytes, marked["sig"])), "<u2").reshape(-1, BANDS * BAND), y)
    shared = {(int(k), int(v)): int(w) for k, v, w in zip(marked["node"], y, weight) if w != ONE}

    # what every pass reads, each in one Python stage: a chain of them keeps two workers a core
    train = once.select("text", "y", "node")

    def weights(batch: pa.RecordBatch) -> list[int]:
        return [shared.get(k, ONE) for k in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]

    n1, n0 = (float(weight[y == v].sum()) / ONE for v in (1, 0))
    if not n1 or not n0:
        return ToxicityModel()

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part, unit, a, b0 = b.slice(lo, 64), [], [], []
                for t, v, w in zip(part.column(0), part.column(1).to_pylist(), weights(part)):
                    seen = {u for x in set(tokens_of(t.as_py() or "")) for u in units_of(x)}
                    unit += seen
                    a += [w * v] * len(seen)
                    b0 += [w * (1 - v)] * len(seen)
                yield pa.RecordBatch.from_arrays([pa.array(unit, pa.string()), pa.array(a, pa.int64()), pa.array(b0, pa.int64())], names=["unit", "a", "b"])

    freq = (train.mapInArrow(sparing(units), "unit string, a bigint, b bigint").groupBy("unit")
            .agg((F.sum("a") / ONE).alias("a"), (F.sum("b") / ONE).alias("b")))
    # the largest of n standard normal scores is about sqrt(2 log n): more texts need stronger evidence
    z_min = z_scale * float(np.sqrt(2 * np.log(max(n1 + n0, 2))))
    # Dirichlet prior: `prior` pseudo-documents that hold each unit at its frequency overall
    m = prior * (F.col("a") + F.col("b")) / (n1 + n0)
    a, b = F.col("a") + m, F.col("b") + m
    delta = F.log(a / (n1 + prior - a + 1)) - F.log(b / (n0 + prior - b + 1))
    rows = (freq.select("unit", delta.alias("d"), (delta / F.sqrt(1 / a + 1 / b)).alias("z"))
            .where((F.abs("z") > z_min) & (F.abs("d") >= min_log_odds)).orderBy(F.abs("z").desc(), "unit").collect())
    model = ToxicityModel(WordWeights({r["unit"]: (float(r["d"]), float(r["z"])) for r in rows}))
    if not rows:
        return model

    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [list(map(model.weights.__getitem__, tokens_of(t.as_py() or ""))) for t in batch.column(0)]
            s, which = np.unique(np.array([v for x in words for v in x], np.float64), return_inverse=True)
            many = np.bincount(which, np.repeat(weights(batch), list(map(len, words))), len(s))
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(many.astype(np.int64))], names=["s", "n"])

    # how often clean text has each weight: at most one row per unit
    back = train.where("y = 0").mapInArrow(sparing(background), "s double, n bigint").groupBy("s").agg(F.sum("n").alias("n")).orderBy("s").toPandas()
    s, p = back["s"].to_numpy(float), back["n"].to_numpy(float)
    p = p / p.sum()
    weighted = s != 0
    # twice the mean gain of clean text from weighted words, spread over its neutral ones
    model.gap = min(NEUTRAL, -2 * float((p * s)[weighted].sum()) / max(float(p[~weighted].sum()), 1e-9))
    model.lam = solve_lambda(p, np.where(weighted, s, model.gap)) or 1.0

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [model.features(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in f], pa.float64()), pa.array([v[1] for v in f], pa.float64()), batch.column(1), pa.array(weights(batch), pa.int64())], names=["best", "total", "y", "w"])

    x = train.mapInArrow(sparing(features), "best double, total double, y int, w bigint").toPandas().sort_values(["best", "total", "y", "w"])
    model.coef = logistic(x[["best", "total"]].to_numpy(float), x["y"].to_numpy(float), weight=x["w"].to_numpy(float) / ONE)
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, and the significant passages (score, first and last word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("score", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))
        for b in batches:
            score, found = [], []
            for t in b.column(2):
                text = t.as_py() or ""
                n, segs = model.segments(text)
                score.append(model.score(text) if segs else model.score(""))
                found.append([{"score": s, "first": i, "last": j} for s, i, j in segs if model.lam * s > np.log(max(n, 1))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array(found, kind)],
                                             names=["doc_id", "held_out", "score", "predicted", "passages"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, passages array<struct<score:double,first:int,last:int>>")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of docs scored below the threshold, all columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py() or "") < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(sparing(run), docs.schema)
