"""Embedding-table operators: feature moments and standardisation, L2 normalisation, projection
head with supplied weights, token-vector lookup with masked mean pooling, and an in-batch
contrastive loss used as an embedding-quality metric.

Vectors stay arrays inside their row: normalising and scaling are array expressions, products with
weight or token-vector matrices are numpy products per Arrow batch. The matrices are parameters,
sized by their shapes (dims x hidden, symbols x dims), and travel with the task. Long form
(id, dim, x) is only made for output and for per-dimension aggregation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.constants import ALPHABET


def as_doubles(vec: Column | str) -> Column:
    return (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>")


def long_vectors(df: DataFrame, vec_col: str, keep: tuple[str, ...], dim: str = "dim", value: str = "x") -> DataFrame:
    """(*keep, dim, x): one row per vector component, x as double."""
    return df.select(*keep, F.posexplode(as_doubles(vec_col)).alias(dim, value))


def feature_moments(df: DataFrame, vec_col: str) -> DataFrame:
    """Per dimension mean and population std; zero std -> scale 1 (scaler convention)."""
    m = long_vectors(df, vec_col, ()).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return m.withColumn("scale", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))


def standardize(df: DataFrame, vec_col: str, moments: DataFrame, out: str = "z") -> DataFrame:
    """z = (x - mean) / scale per component. The moments become one row of two arrays (one entry per dimension)."""
    one = moments.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "scale"))).alias("_m"))
    z = F.zip_with(as_doubles(vec_col), F.col("_m"), lambda x, m: (x - m["mean"]) / m["scale"])
    return df.join(F.broadcast(one)).withColumn(out, z).drop("_m")


def l2_normalize(vec: Column | str) -> Column:
    """x / ||x||_2; a zero vector stays zero."""
    v = as_doubles(vec)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def matrix(weights: DataFrame, row: str, col: str, value: str) -> np.ndarray:
    """A dense parameter matrix from its long table (indices from 0)."""
    w = weights.select(row, col, value).toPandas()
    out = np.zeros((int(w[row].max()) + 1, int(w[col].max()) + 1))
    out[w[row].to_numpy(int), w[col].to_numpy(int)] = w[value].to_numpy(float)
    return out


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def map_matrix(df: DataFrame, vec_col: str, keep: tuple[str, ...], fn, out: str) -> DataFrame:
    """(*keep, out): fn applied to the batch's vectors as one (rows, dims) matrix. A vector that is null or holds a null gives null."""
    def run(batches):
        for b in batches:
            good = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            whole = b.column(0).take(pa.array(np.flatnonzero(good)))
            if not len(whole):
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.nulls(b.num_rows, pa.list_(pa.float64()))], names=[*keep, out])
                continue
            lists = _lists(np.asarray(fn(whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)), dtype=np.float64))
            if not good.all():
                lists = lists.take(pa.array(np.where(good, np.cumsum(good) - 1, 0), mask=~good))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], lists], names=[*keep, out])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", {out} array<double>"
    v = as_doubles(vec_col)
    return df.select(F.when(~F.exists(v, lambda x: x.isNull()), v).alias("_v"), *keep).mapInArrow(run, schema)


def projection_head(df: DataFrame, vec_col: str, w1: np.ndarray, w2: np.ndarray, keep: tuple[str, ...], out: str = "x") -> DataFrame:
    """linear -> ReLU -> linear -> L2 normalise."""
    head = map_matrix(df, vec_col, keep, lambda x: np.maximum(x @ w1, 0.0) @ w2, "_o")
    return head.select(*keep, l2_normalize("_o").alias(out))


def token_vectors(df: DataFrame, vec_col: str, token: str = "token") -> DataFrame:
    """C10 table: (token, dim, v), the mean vector of the rows that carry a token."""
    return long_vectors(df, vec_col, (token,)).groupBy(token, "dim").agg(F.avg("x").alias("v"))


def masked_mean_pool(df: DataFrame, tokens: str, mask: str, vectors: np.ndarray, keep: tuple[str, ...], out: str = "pooled") -> DataFrame:
    """D8 (+C10): sum over unmasked tokens of vec[token] / number of unmasked tokens, per row; null when every token is
    masked. ``tokens`` and ``mask`` are arrays of a row."""
    n_tokens = len(vectors)

    def run(batches):
        for b in batches:
            tok, keep_mask = b.column(0), b.column(1).flatten().to_numpy(zero_copy_only=False).astype(bool)
            row = np.repeat(np.arange(b.num_rows), np.diff(tok.offsets.to_numpy()))
            t = tok.flatten().to_numpy(zero_copy_only=False)
            count = np.bincount(row[keep_mask] * n_tokens + t[keep_mask], minlength=b.num_rows * n_tokens).reshape(b.num_rows, n_tokens)
            n = count.sum(axis=1)
            pooled = (count @ vectors) / np.maximum(n, 1)[:, None]
            cols = _lists(pooled) if n.all() else pa.array([p if k else None for p, k in zip(pooled.tolist(), n)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], cols], names=[*keep, out])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", {out} array<double>"
    return df.select(F.col(tokens).cast("array<int>"), F.col(mask).cast("array<int>"), *keep).mapInArrow(run, schema)


def embed_sequences(df: DataFrame, seq: str, encoder, keep: tuple[str, ...], out: str = "embedding", batch: int = 1024, factory: bool = False) -> DataFrame:
    """(*keep, out): one vector per sequence from ``encoder``, a function from a list of at most ``batch`` strings to a (rows,
    dims) matrix (a token-vector model, a k-mer composition). With ``factory`` it is instead a function without arguments that makes such
    an encoder, called once in each task that has rows: a backbone is loaded where it runs and never shipped. A null sequence
    is encoded as the empty one."""
    def run(batches):
        encode = None
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                encode = encode or (encoder() if factory else encoder)
                x = encode([s or "" for s in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], _lists(np.asarray(x, dtype=np.float64))], names=[*keep, out])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", {out} array<double>"
    return df.select(F.col(seq).alias("_s"), *keep).mapInArrow(run, schema)


def kmer_encoder(k: int = 2, symbols: str = ALPHABET[1:]):
    """Encoder of k-mer composition: counts of the overlapping k-mers over ``symbols``, in symbol order; k-mers with any
    other letter are not counted."""
    code = np.full(256, -1, dtype=np.int64)
    code[[ord(c) for c in symbols]] = np.arange(len(symbols))
    dims = len(symbols) ** k

    def encode(seqs: list[str]) -> np.ndarray:
        raw = code[np.frombuffer("".join(seqs).encode("ascii", "replace"), np.uint8)]
        row = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
        n = max(len(raw) - k + 1, 0)
        at, ok = np.zeros(n, np.int64), row[:n] == row[k - 1: k - 1 + n]
        for i in range(k):
            at = at * len(symbols) + raw[i: i + n]
            ok = ok & (raw[i: i + n] >= 0)
        return np.bincount(row[:n][ok] * dims + at[ok], minlength=len(seqs) * dims).reshape(len(seqs), dims)

    return encode


def contrastive_batch_loss(feat: DataFrame, temperature: float = 0.05) -> DataFrame:
    """In-batch contrastive loss per batch. ``feat``: (batch_id, pair_id, side 0/1, x array) with L2-normalised
    features; each pair is a positive, every other feature of the batch a negative, negatives re-weighted by
    neg / mean(neg). A batch is bounded by construction (E10), so its similarities are one small matrix."""
    def loss(pdf):
        import pandas as pd

        x = np.stack(pdf["x"].to_numpy())
        e = np.exp(x @ x.T / temperature)
        pair, side = pdf["pair_id"].to_numpy(), pdf["side"].to_numpy()
        same = pair[:, None] == pair[None, :]
        pos = (e * (same & (side[:, None] != side[None, :]))).sum(axis=1)
        neg = np.where(same, 0.0, e)
        n_neg = (~same).sum(axis=1)
        ok = (n_neg > 0) & (pos > 0)
        if not ok.any():
            return pd.DataFrame({"batch_id": pd.Series([], dtype="int64"), "loss": pd.Series([], dtype="float64"), "n_features": pd.Series([], dtype="int64")})
        s2, mean = (neg * neg).sum(axis=1)[ok], neg.sum(axis=1)[ok] / n_neg[ok]
        l = -np.log(pos[ok] / (s2 / mean + pos[ok]))
        return pd.DataFrame({"batch_id": [int(pdf["batch_id"].iloc[0])], "loss": [float(l.mean())], "n_features": [int(ok.sum())]})

    return feat.select("batch_id", "pair_id", "side", "x").groupBy("batch_id").applyInPandas(loss, "batch_id long, loss double, n_features long")
