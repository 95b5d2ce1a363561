"""Site-profile label predictors.

Three deterministic predictors stand in for the reference's three encoders (one-hot, zero-shot
and fine-tuned embeddings) so that every downstream operator can be checked exactly in SQL:

- ``msa``:          position-specific profile, key = (pos, aa)
- ``contrastive``:  block profile, key = (block of 8 positions, aa)
- ``foundation``:   composition profile, key = aa only

Fit = one aggregation of the labelled sites into integer counts n(method, label, bucket, aa).
Score of class c for a sequence = sum over its sites of n / (n_seq(c) * m * L), where m is the
number of positions per bucket and L the window; p = s^8 / sum_c s^8 (a sharpened vote).

Plan shape of ``predict_profiles``: the fitted counts are model parameters, an array of
positions x symbols x classes per predictor; every query row is scored on its own inside an Arrow
batch (gather and sum over its positions), so prediction is a narrow pass over the rows: no site
table, no join, no shuffle, and rows that share a header stay separate predictions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.constants import ALPHABET, Q, RANK_DIGITS, WINDOW
from labelflow.operators.common import materialize
from labelflow.sources.sequences import sites

# Fixed predictor definitions: (name, bucket expression over 1-based pos, positions per bucket)
PREDICTORS = (
    ("msa", "pos", 1),
    ("contrastive", "cast(floor((pos - 1) / 8) as int)", 8),
    ("foundation", "0", WINDOW),
)
#: bytes that all models of a grid may take: they are sent to every task
MODEL_BYTES = 1 << 28
_LUT = np.full(256, Q, dtype=np.int64)
for _i, _ch in enumerate(ALPHABET):
    _LUT[ord(_ch)] = _i


def fit_profiles(train_seqs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """profile(*by, method, label, bucket, aa, m, n): labelled site counts, materialised (the fitted model, or one
    model per value of the ``by`` columns).

    One aggregation of the labelled sites by (label, pos, aa) (map-side combined to at most
    classes x L x q groups); the block and composition profiles are re-aggregations of that small
    table, so the large site stream is read once and never multiplied by the predictor count."""
    s = sites(train_seqs, keep=(*by, "label"))
    site_counts = s.groupBy(*by, "label", "pos", "aa").agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for name, b, m in PREDICTORS:
        parts.append(site_counts.select(*by, F.lit(name).alias("method"), "label", F.expr(b).cast("int").alias("bucket"),
                                        "aa", F.lit(m).alias("m"), "n")
                     .groupBy(*by, "method", "label", "bucket", "aa", "m").agg(F.sum("n").cast("long").alias("n")))
    prof = parts[0]
    for p in parts[1:]:
        prof = prof.unionByName(p)
    return materialize(prof)


@dataclass
class ProfileModel:
    """Sorted labels, sequences per label, counts[method] of shape (window, q + 1, labels); the last symbol slot
    stays zero and stands for anything outside the alphabet."""

    labels: list[str]
    n_seq: np.ndarray
    counts: dict[str, np.ndarray]


def profile_models(profile: DataFrame, by: str, window: int = WINDOW) -> dict:
    """One model per value of the ``by`` column."""
    rows = profile.toPandas()
    return {k: _model(part, window) for k, part in rows.groupby(by)}


def profile_model(profile: DataFrame, window: int = WINDOW) -> ProfileModel:
    """Model parameters, sized by their shape."""
    return _model(profile.toPandas(), window)


def _model(rows, window: int) -> ProfileModel:
    sizes = rows[(rows.method == "msa") & (rows.bucket == 1)].groupby("label")["n"].sum().sort_index()
    labels = [str(c) for c in sizes.index]
    at = {c: i for i, c in enumerate(labels)}
    counts = {}
    for name, _, m in PREDICTORS:
        mine = rows[rows.method == name]
        per_bucket = np.zeros((window + 1, Q + 1, len(labels)))
        per_bucket[mine.bucket.to_numpy(int), [ALPHABET.find(x) for x in mine.aa], [at[c] for c in mine.label]] = mine.n.to_numpy(float)
        bucket = {1: np.arange(1, window + 1), 8: np.arange(window) // 8, WINDOW: np.zeros(window, int)}[m]
        counts[name] = per_bucket[bucket]
    return ProfileModel(labels, sizes.to_numpy(float), counts)


def predict_wide(profile: DataFrame, query_seqs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (),
                 seq: str = "sequence_align") -> tuple[DataFrame, list[str]]:
    """(header, *keep, p_<method> array<double> over sorted classes) per row; and the class list. A row without any
    symbol seen in training has the same probability for every class."""
    model = profile_model(profile, window)
    return score_rows({"": model}, query_seqs, window, keep, seq), model.labels


def score_rows(models: dict[str, ProfileModel], query_seqs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (),
               seq: str = "sequence_align") -> DataFrame:
    """(header, *keep, p_<method><suffix> array<double> over that model's classes) per row, for every model by suffix, in
    one pass over the rows. A sequence of more than `window` sites is an error."""
    names = ("header",) + tuple(keep)
    methods = [(name, m, suffix, model) for suffix, model in models.items() for name, _, m in PREDICTORS]

    def run(batches):
        pos = np.arange(window)[None, :]
        for batch in batches:
            probs = [[] for _ in methods]
            for lo in range(0, batch.num_rows, 1024):
                texts = [(t or "").ljust(window, "\0") for t in batch.column(0).slice(lo, 1024).to_pylist()]
                if (longest := max(map(len, texts), default=0)) > window:
                    raise ValueError(f"sequence of {longest} sites, the profile has {window}")
                raw = np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8).reshape(len(texts), window)
                codes = _LUT[raw]
                for parts, (name, m, _, model) in zip(probs, methods):
                    score = model.counts[name][pos, codes].sum(axis=1) / (model.n_seq * m * window)
                    e = score ** 8
                    total = e.sum(axis=1, keepdims=True)
                    parts.append(np.where(total > 0, e / np.where(total > 0, total, 1), 1 / max(len(model.labels), 1)))
            cols = []
            for parts, (_, _, _, model) in zip(probs, methods):
                x = np.concatenate(parts) if parts else np.empty((0, len(model.labels)))
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(model.labels))
                cols.append(pa.ListArray.from_arrays(offsets, pa.array(x.ravel())))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=[*names, *(f"p_{n}{suffix}" for n, _, suffix, _ in methods)])

    passed = ", ".join(f"`{c}` {query_seqs.schema[c].dataType.simpleString()}" for c in names)
    schema = passed + "".join(f", p_{n}{suffix} array<double>" for n, _, suffix, _ in methods)
    return query_seqs.select(F.col(seq).alias("_s"), *names).mapInArrow(run, schema)


def best_by_model(models: dict[tuple[str, int], ProfileModel], rows: DataFrame, dataset: str, keep: tuple[str, ...] = (), window: int = WINDOW,
                  seq: str = "sequence_align") -> DataFrame:
    """(*keep, dataset, n_train, method, label): the label that every model of a row's dataset, one per training size, gives it, by every
    method, in one pass over the rows; ties (after rounding) to the smaller label. Rows of datasets without a model are left out."""
    size = sum(c.nbytes for m in models.values() for c in m.counts.values())
    if size > MODEL_BYTES:
        raise ValueError(f"{len(models)} models take {size} bytes, more than {MODEL_BYTES}")
    sizes: dict[str, list[int]] = {}
    for d, n in sorted(models):
        sizes.setdefault(d, []).append(n)
    names = [*keep, dataset, "n_train", "method", "label"]

    def run(batches):
        pos = np.arange(window)[None, :]
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                sets = np.array(part.column(1).to_pylist(), object)
                for d in sorted({x for x in sets if x in sizes}):
                    mine = part.take(pa.array(np.flatnonzero(sets == d)))
                    texts = [(t or "").ljust(window, "\0") for t in mine.column(0).to_pylist()]
                    if (longest := max(map(len, texts))) > window:
                        raise ValueError(f"sequence of {longest} sites, the profile has {window}")
                    codes = _LUT[np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8).reshape(len(texts), window)]
                    for n in sizes[d]:
                        model = models[d, n]
                        for method, _, m in PREDICTORS:
                            e = (model.counts[method][pos, codes].sum(axis=1) / (model.n_seq * m * window)) ** 8
                            total = e.sum(axis=1, keepdims=True)
                            p = np.where(total > 0, e / np.where(total > 0, total, 1), 1 / len(model.labels))
                            label = np.array(model.labels, object)[np.round(p, RANK_DIGITS).argmax(axis=1)]
                            fixed = [pa.array([v] * len(texts), t) for v, t in ((n, pa.int32()), (method, pa.string()))]
                            yield pa.RecordBatch.from_arrays([*mine.columns[2:], mine.column(1), *fixed, pa.array(label, pa.string())], names=names)

    passed = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*keep, dataset))
    return rows.select(F.col(seq).alias("_s"), dataset, *keep).mapInArrow(run, passed + ", n_train int, method string, label string")


def long_preds(wide: DataFrame, labels: list[str], keep: tuple[str, ...] = ("header",)) -> DataFrame:
    """Wide probabilities -> preds(method, *keep, label, p), one row per class."""
    lab = F.array(*[F.lit(c) for c in labels])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("method"), F.col(f"p_{name}").alias("p"))
                               for name, _, _ in PREDICTORS]))
    x = wide.select(*keep, rows.alias("r")).select(*keep, "r.method", "r.p")
    z = F.explode(F.arrays_zip(lab.alias("label"), F.col("p").alias("p")))
    return x.select("method", *keep, z.alias("z")).select("method", *keep, "z.label", "z.p")


def argmax(p: Column, labels: list[str]) -> tuple[Column, Column]:
    """(label, p) of the largest probability, ties (after rounding) to the smaller label:
    classes are sorted, and array_position returns the first maximum."""
    rp = F.transform(p, lambda v: F.round(v, RANK_DIGITS))
    idx = F.array_position(rp, F.array_max(rp)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in labels]), idx), F.element_at(p, idx)


def predict_profiles(profile: DataFrame, query_seqs: DataFrame, window: int = WINDOW) -> DataFrame:
    wide, labels = predict_wide(profile, query_seqs, window)
    return long_preds(wide, labels)
