"""Bit-sliced whitening against exact integer arithmetic and numpy."""

from fractions import Fraction

import numpy as np
import pytest

from labelflow.llm import whitening as W

VEC = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("low, high, rows", [(-150, 150, 137), (0, 1, 5), (5, 6, 64), (-2 ** 40, 2 ** 40, 65), (-2 ** 62, 2 ** 62, 63), (-2 ** 63, 2 ** 63 - 1, 9)])
def test_scatter_is_exact(low, high, rows):
    x = np.random.default_rng(rows).integers(low, high, (rows, 6))
    one = np.concatenate([np.ones((rows, 1), object), x.astype(object)], axis=1)
    g = W.block_scatter(x)
    assert (g == one.T.dot(one)).all()
    back = sum(limb.astype(object) << 32 * k for k, limb in enumerate(W._limbs(g)))
    assert (back == one.T.dot(one)).all()


def test_planes_hold_every_bit():
    u = np.random.default_rng(3).integers(0, 900, (130, 4)).astype(np.uint64)
    planes, dims, bits = W.bit_planes(u)
    back = np.zeros((192, 4), np.uint64)
    for p, d, b in zip(planes, dims, bits):
        back[:, d] |= np.unpackbits(p.view(np.uint8)).astype(np.uint64) << np.uint64(b)
    assert (back[:130] == u).all() and not back[130:].any()


def brute(vectors, scale=256):
    """n, sums, covariance over the distinct lattice vectors, in exact fractions; the lattice of every vector."""
    x = [tuple(int(np.floor(scale * np.float64(np.float32(c)))) for c in v) for v in vectors]
    fit = sorted(set(x))
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    cov = [[Fraction(n * sum(v[i] * v[j] for v in fit) - s[i] * s[j], n * n) for j in range(d)] for i in range(d)]
    return x, n, s, cov


def table(rng, n=300, d=9):
    mix = rng.normal(size=(d, d)) * np.linspace(3, 0.3, d)[:, None]
    v = (rng.normal(size=(n, d)) @ mix).astype(np.float32)
    return [v[0]] * 120 + list(v)  # one vector is very common


def test_whitening(spark):
    vectors = table(np.random.default_rng(4))
    d = len(vectors[0])
    rows = [(i % 400 if i % 50 else None, [float(c) for c in v], 0) for i, v in enumerate(vectors)]
    odd = [(900, None, 0), (901, [], 0), (902, [1.0] * d + [2.0], 0), (903, [None] + [1.0] * (d - 1), 0), (904, [float("nan")] + [0.0] * (d - 1), 0),
           (905, [float("inf")] + [0.0] * (d - 1), 0), (906, [3e38] + [0.0] * (d - 1), 0), (907, [1.0, 2.0], 0)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows + odd, VEC).select("*", *(F.lit("z").alias(c) for c in ("x", "dim", "n", "component"))).repartition(5)
    got = W.whiten(df).collect()
    x, n, s, cov = brute(vectors)
    v = np.array([[float(c) for c in r] for r in cov])
    w, q = np.linalg.eigh(v)
    w, q = w[::-1], q[:, ::-1]
    assert len(got) == 4 * len(vectors) and {r.n for r in got} == {n}
    dev = sorted(sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x)
    for k in range(4):
        mine = [r for r in got if r.component == k + 1]
        assert sorted(r.deviation for r in mine) == dev
        want = (np.array(x) - np.array(s) / n) @ q[:, k] / np.sqrt(w[k])
        have = np.sort([r.whitened for r in mine])
        assert np.allclose(have, np.sort(want), atol=1e-9) or np.allclose(have, np.sort(-want), atol=1e-9)
        assert abs(mine[0].explained - w[k] / w.sum()) < 1e-12
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 <= got[0].identity_error < 1e-9
    ids = sorted((r.vec_id is not None, r.vec_id or 0) for r in got if r.component == 1)
    assert ids == sorted((r[0] is not None, r[0] or 0) for r in rows)


def test_partitioning_changes_nothing(spark):
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(table(np.random.default_rng(5), 200, 5))]
    a, b = ({(r.vec_id, r.component): r for r in W.whiten(spark.createDataFrame(rows, VEC).repartition(n)).collect()} for n in (1, 6))
    assert all(a[k].deviation == b[k].deviation and a[k].whitened == b[k].whitened for k in a) and a.keys() == b.keys()


def test_blocks_add_up(spark, monkeypatch):
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(table(np.random.default_rng(6), 700, 3))]
    df = spark.createDataFrame(rows, VEC).repartition(1)
    packed = W.lattice(df, 256.0, "embedding", "vec_id")
    batches = [r.x for r in packed.select("x").distinct().collect()]
    import pyarrow as pa
    for block in (1 << 20, 64 * 3):
        monkeypatch.setattr(W, "BLOCK_ENTRIES", block)
        out = list(W._scatter(3)(iter([pa.RecordBatch.from_arrays([pa.array(batches[i: i + 90], pa.binary())], names=["x"]) for i in range(0, len(batches), 90)])))
        assert out[0].column("l0")[0].as_py() == len(batches)
        totals = [sum(limb << 32 * k for k, limb in enumerate(row[2:])) for row in zip(*out[0].to_pydict().values())]
        if block == 1 << 20:
            first = totals
    assert totals == first


def test_no_spread(spark):
    one = [(i, [0.5, -0.25, 3.0], 0) for i in range(5)]
    got = W.whiten(spark.createDataFrame(one, VEC)).collect()
    assert len(got) == 15 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, 0.0, 0.0, None) for r in got)
    line = [(i, [float(i), float(-i), 2.0], 0) for i in range(6)]
    got = W.whiten(spark.createDataFrame(line, VEC)).collect()
    assert {r.whitened for r in got if r.component > 1} == {0.0} and got[0].identity_error < 1e-9
    assert abs(np.mean([r.whitened ** 2 for r in got if r.component == 1]) - 1) < 1e-12


def test_large_entries(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate((rng.normal(size=(40, 3)) * 1e11).astype(np.float32))]
    got = W.whiten(spark.createDataFrame(rows, VEC)).collect()
    x, n, s, cov = brute([r[1] for r in rows])
    want = {i: sum((n * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None) for r in got) and got[0].identity_error < 1e-9


def test_empty(spark):
    for rows in ([], [(1, None, 0)]):
        assert W.whiten(spark.createDataFrame(rows, VEC)).collect() == []
