"""Vector operators: null vectors, and encoders made inside of tasks."""

import numpy as np

from labelflow.operators import embeddings as E


def test_null_vectors_stay_null(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [3.0, None]), (3, [0.0, 0.0]), (4, [-1.0, 1.0])]
    w1, w2 = np.array([[1.0, -1.0, 0.5], [0.0, 2.0, 1.0]]), np.array([[1.0, 0.0], [0.5, 1.0], [0.0, -1.0]])
    for n in (1, 5):  # also batches without any vector
        got = {r.id: r.x for r in E.projection_head(spark.createDataFrame(rows, "id int, v array<double>").repartition(n), "v", w1, w2, ("id",)).collect()}
        assert got[1] is None and got[2] is None and got[3] == [0.0, 0.0] and len(got) == 5
        for i in (0, 4):
            y = np.maximum(np.array(rows[i][1]) @ w1, 0) @ w2
            assert np.allclose(got[i], y / np.linalg.norm(y))


def test_an_encoder_is_made_once_in_a_task(spark):
    def make():
        calls = []

        def encode(seqs):
            calls.append(len(seqs))
            return np.array([[len(s), len(calls), max(calls)] for s in seqs], float)

        return encode

    df = spark.createDataFrame([(i, None if i == 4 else "A" * i) for i in range(10)], "id int, s string").coalesce(1)
    got = {r.id: r.embedding for r in E.embed_sequences(df, "s", make, ("id",), batch=3, factory=True).collect()}
    assert [got[i][0] for i in range(10)] == [0.0 if i == 4 else float(i) for i in range(10)]
    assert got[9][1] >= 4 and all(v[2] <= 3 for v in got.values())
    plain = {r.id: r.embedding for r in E.embed_sequences(df, "s", E.kmer_encoder(1, "AC"), ("id",)).collect()}
    assert plain[3] == [3.0, 0.0] and plain[4] == [0.0, 0.0]
