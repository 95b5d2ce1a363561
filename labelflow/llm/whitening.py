"""Embedding whitening by a bit-sliced scatter.

Entries are put on a lattice, x = floor(scale * c) as integers, so the scatter matrix is a matter of counting and exact.
Each block of vectors is shifted by its smallest entry per dimension and sliced: one bit plane per dimension and bit,
packed across the rows into 64-bit words. The cross-product of two dimensions is the sum over their planes a and b of
2^(a + b) times the set bits of the planes' AND. A dimension that is always 1 goes along, so the counts and sums come
out of the same products. Blocks are shifted back and added as integers in 32-bit limbs; Spark sums the limbs, and the
driver holds one row per pair of dimensions, whatever the number of vectors. The covariance is centred in integers,
n * sum(x_i x_j) - sum(x_i) * sum(x_j), before it becomes floating point for eigh.

Defined cases: vectors that are null or hold a null, non-finite or (scaled) beyond 64-bit entry have no row; the
dimension is the length that most of the others have (of ties the longest), vectors of other lengths have no row, nor have
empty ones. Repeated vectors are fitted once and whitened each for itself. A component without spread (no variance beyond
rounding; all of them for a single distinct vector) is whitened to 0 and left out of the identity error, which is null
if no component has any; its explained share is 0. A deviation beyond 64 bits is null. An empty table gives no rows;
null or repeated identifiers and extra columns do no harm. Very long vectors: planes are made for blocks of rows whose
size falls with the dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import stored

LATTICE_DDL = "vec_id bigint, dim int, x binary"
LIMBS = 5
CELL_DDL = "i int, j int, " + ", ".join(f"l{k} bigint" for k in range(LIMBS))
#: entries of a block: rows times dimensions
BLOCK_ENTRIES = 1 << 20


def _narrow(x: np.ndarray) -> list[bytes]:
    """Each row in the fewest bytes per entry that hold it, so equal vectors are equal bytes."""
    low, high = x.min(axis=1), x.max(axis=1)
    out: list[bytes] = [b""] * len(x)
    width = np.full(len(x), 8)
    for w in (4, 2, 1):
        width[(low >= -(1 << 8 * w - 1)) & (high < 1 << 8 * w - 1)] = w
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        for i, row in zip(at.tolist(), x[at].astype(f"<i{w}")):
            out[i] = row.tobytes()
    return out


def _wide(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, integers) of the rows of a binary column, whose order may change."""
    size = pc.binary_length(col).to_numpy(zero_copy_only=False)
    at, rows = [], []
    for n in np.unique(size).tolist():
        here = np.flatnonzero(size == n)
        at.append(here)
        rows.append(np.frombuffer(b"".join(col.take(pa.array(here)).to_pylist()), f"<i{n // dim}").reshape(-1, dim).astype(np.int64))
    return (np.concatenate(at), np.concatenate(rows)) if at else (np.empty(0, np.int64), np.empty((0, dim), np.int64))


def lattice(embeddings: DataFrame, scale: float, vector: str, key: str) -> DataFrame:
    """(vec_id, dim, x): the usable vectors as packed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, col = b.column(0), b.column(1)
            size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
            at, dims, packed = [], [], []
            for d in np.unique(size[size > 0]).tolist():
                here = np.flatnonzero(size == d)
                v = pc.list_flatten(col.take(pa.array(here)))
                c = np.asarray(pc.fill_null(v, float("nan")).to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
                x = np.floor(scale * c)
                # NaN and infinities fail the comparison too
                good = (np.abs(x) < 2.0 ** 63).all(axis=1)
                at += here[good].tolist()
                packed += _narrow(x[good].astype(np.int64)) if good.any() else []
                dims += [d] * int(good.sum())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "dim", "x"])

    return embeddings.select(F.col(key).cast("bigint"), F.col(vector).cast("array<double>")).mapInArrow(run, LATTICE_DDL)


def bit_planes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes, dimension, bit): every bit of every column of non-negative integers, packed across the rows into words."""
    bits = np.array([int(m).bit_length() for m in u.max(axis=0)])
    words = -(-len(u) // 64)
    dims, which = np.repeat(np.arange(u.shape[1]), bits), np.concatenate([np.arange(b) for b in bits])
    planes = np.zeros((len(dims), words * 8), np.uint8)
    columns = np.ascontiguousarray(u.T)
    for b in range(bits.max(initial=0)):
        here = which == b
        on = (columns[dims[here]] >> np.uint64(b)).astype(np.uint8) & 1
        planes[here, : -(-len(u) // 8)] = np.packbits(on, axis=1)
    return planes.view(np.uint64), dims, which


def cross_products(u: np.ndarray) -> np.ndarray:
    """Exact u^T u of non-negative integers, from the planes. 64-bit integers where the result fits them, else Python's."""
    planes, dims, which = bit_planes(u)
    d = u.shape[1]
    exact = np.int64 if 2 * int(which.max(initial=0)) + 2 + len(u).bit_length() < 63 else object
    out = np.zeros((d, d), exact)
    first = np.searchsorted(dims, np.arange(d + 1))
    held = np.unique(dims)
    weight = np.array([1 << int(b) for b in which], exact)
    for p in range(len(planes)):
        i = int(dims[p])
        lo = first[i]  # dimensions from i on: the rest follows by symmetry
        n = np.bitwise_count(planes[p] & planes[lo:]).sum(axis=1, dtype=np.int64).astype(exact) * weight[lo:]
        to = held[np.searchsorted(held, i):]
        out[i, to] += weight[p] * np.add.reduceat(n, first[to] - lo)
    return np.triu(out) + np.triu(out, 1).T


def block_scatter(x: np.ndarray) -> np.ndarray:
    """Exact scatter of the rows (1, x): entry 0, 0 counts them, 0, j sums column j."""
    rows = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
    low = rows.min(axis=0)
    low[0] = 0
    u = rows.view(np.uint64) - low.view(np.uint64)  # wraps to the right value
    g = cross_products(u)
    small = g.dtype != object and int(np.abs(rows.astype(np.float64)).max()) ** 2 * len(rows) < 1 << 60
    g, low = (g, low) if small else (g.astype(object), low.astype(object))
    s, n = g[0], g[0, 0]
    return g + np.outer(low, s) + np.outer(s, low) + n * np.outer(low, low)


def _limbs(g: np.ndarray) -> list[np.ndarray]:
    """32-bit limbs, lowest first; the last one is signed."""
    out, many = [], LIMBS if g.dtype == object else 2
    for _ in range(many - 1):
        out.append((g & 0xFFFFFFFF).astype(np.int64))
        g = g >> 32
    return [*out, g.astype(np.int64)]


def _scatter(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((LIMBS, dim + 1, dim + 1), np.int64)
        step, held, seen = max(64, BLOCK_ENTRIES // dim), [], 0

        def add(x: np.ndarray) -> None:
            for k, limb in enumerate(_limbs(block_scatter(x))):
                total[k] += limb

        for b in batches:
            x = _wide(b.column(0), dim)[1]
            seen += len(x)
            held.append(x)
            if sum(map(len, held)) >= step:
                x = np.concatenate(held)
                for lo in range(0, len(x) - len(x) % step, step):
                    add(x[lo: lo + step])
                held = [x[len(x) - len(x) % step:]]
        if held and (x := np.concatenate(held)).size:
            add(x)
        if seen:
            i, j = np.triu_indices(dim + 1)
            for lo in range(0, len(i), 65_536):
                a, b = i[lo: lo + 65_536], j[lo: lo + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), *(pa.array(t[a, b]) for t in total)], names=["i", "j", *(f"l{k}" for k in range(LIMBS))])

    return run


@dataclass(frozen=True)
class Whitening:
    """A fitted model: number of fitted vectors, their sums, unit components as rows, variances, and the trace."""

    scale: float
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def spread(self) -> np.ndarray:
        """Which components have variance beyond the rounding of eigh."""
        return self.variances > 16 * self.dim * np.finfo(float).eps * max(self.trace, 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in 64 bits where it fits them."""
        s = np.array(self.sums, object)
        peak = (max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + 1) * self.n + max(map(abs, self.sums))
        return self.n * x - s.astype(np.int64) if peak < 1 << 62 else self.n * x.astype(object) - s

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        y = (centred / self.n).astype(np.float64) @ self.components.T
        return np.divide(y, np.sqrt(np.where(self.spread, self.variances, 1.0)), out=np.zeros_like(y), where=self.spread)


def _deviations(centred: np.ndarray) -> list[int | None]:
    """Exact sums of squares, or None beyond 64 bits."""
    if centred.dtype != object and np.square(centred.astype(np.float64)).sum(axis=1).max(initial=0.0) < 2.0 ** 62:
        return np.square(centred).sum(axis=1).tolist()
    return [s if (s := sum(int(c) ** 2 for c in row)) < 1 << 63 else None for row in centred]


def eigen(n: int, sums: list[int], products: list[list[int]], top: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(components as rows, variances, trace) of the covariance with divisor n, centred as integers before the division."""
    d = len(sums)
    v = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)], float)
    w, q = np.linalg.eigh(v)
    order = np.argsort(-w, kind="stable")[:top]
    c = q[:, order].T
    # one sign for all rows: the largest entry of a component is positive
    c = c * np.sign(c[np.arange(len(c)), np.abs(c).argmax(axis=1)])[:, None]
    return np.ascontiguousarray(c), np.maximum(w[order], 0.0), float(np.trace(v))


def fit(lattice_rows: DataFrame, scale: float, top: int) -> tuple[Whitening | None, DataFrame]:
    """The model of the distinct vectors of the usual length, and these vectors' rows."""
    usual = lattice_rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if usual is None:
        return None, lattice_rows
    dim = usual["dim"]
    rows = lattice_rows.where(F.col("dim") == dim)
    distinct = stored(rows.select("x").distinct(), "whitening-fit")
    cells = distinct.mapInArrow(_scatter(dim), CELL_DDL).groupBy("i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).collect()
    g = [[0] * (dim + 1) for _ in range(dim + 1)]
    for r in cells:
        g[r.i][r.j] = g[r.j][r.i] = sum(r[f"l{k}"] << 32 * k for k in range(LIMBS))
    n, sums = g[0][0], g[0][1:]
    model = Whitening(scale, n, tuple(sums), *eigen(n, sums, [r[1:] for r in g[1:]], top))
    return Whitening(**{**model.__dict__, "identity_error": _identity_error(distinct, model)}), rows


def _identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the fitted vectors' whitened covariance minus the identity, measured on them."""
    k = int(model.spread.sum())
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            y = model.whiten(model.centred(_wide(b.column(0), model.dim)[1]))[:, model.spread]
            y = np.concatenate([np.ones((len(y), 1)), y], axis=1)
            total += y.T @ y
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    got = np.zeros((k + 1, k + 1))
    for r in distinct.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        got[r.i, r.j] = r.v / model.n
    return float(np.abs(got[1:, 1:] - np.outer(got[0, 1:], got[0, 1:]) - np.eye(k)).max())


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """A row per vector and component, from 1 by falling variance."""
    k = len(model.variances)
    share = np.where(model.spread, model.variances / (model.trace or 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                at, x = _wide(part.column(1), model.dim)
                c = model.centred(x)
                y = model.whiten(c)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), pa.array(np.full(len(at) * k, model.n)),
                    pa.array(_deviations(c), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))), pa.array(y.ravel()), pa.array(np.tile(share, len(at))),
                    pa.array([model.identity_error] * (len(at) * k), pa.float64())], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whiten(embeddings: DataFrame, top: int = 4, scale: float = 256.0, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable vector and each of the top components."""
    packed = stored(lattice(embeddings, scale, vector, key), "whitening-rows")
    model, rows = fit(packed, scale, top)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    return apply(rows, model)
