"""Hand-made micro tables for edge cases and brute-force checks of the distributed operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.operators import augment as A
from labelflow.operators import evaluate as V
from labelflow.operators import identity as I
from labelflow.operators import pairstats as P
from labelflow.operators import sitestats as T
from labelflow.operators.windows import consecutive_ids, running_agg, running_sums


def test_running_sums_match_window_under_skew(spark):
    # one key holds most rows; sums must equal a plain ordered window
    rows = [("hot", i, i % 7) for i in range(3000)] + [("cold", i, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {(r.k, r.o): r.v_cum for r in running_sums(df, ["k"], ["o"], ["v"], descending=False).collect()}
    for k in ("hot", "cold"):
        xs = sorted((o, v) for kk, o, v in rows if kk == k)
        acc = 0
        for o, v in xs:
            acc += v
            assert got[(k, o)] == acc


def test_running_min_exclusive(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([5, 3, 4, 1, 2])], "o int, v double")
    r = {x.o: x.v_xrunmin for x in running_agg(df, [], ["o"], ["v"], "min", exclusive=True).collect()}
    assert r == {0: None, 1: 5.0, 2: 3.0, 3: 3.0, 4: 1.0}


def test_consecutive_ids_dense(spark):
    df = spark.range(0, 1000).withColumn("g", (F.col("id") % 3).cast("int"))
    ids = consecutive_ids(df, ["id"], "rid", keys=["g"]).collect()
    for g in range(3):
        got = sorted((r.id, r.rid) for r in ids if r.g == g)
        assert [rid for _, rid in got] == list(range(len(got)))


def test_roc_ties_and_auc(spark):
    # tied scores collapse into one step; AUC counts ties one half
    rows = [("m", "h1", "a", "a", 0.9), ("m", "h2", "b", "a", 0.9), ("m", "h3", "a", "a", 0.5), ("m", "h4", "b", "a", 0.1)]
    sc = V.binarize(spark.createDataFrame(rows, "method string, header string, label_true string, label string, p double"))
    pts = sorted((r.fpr, r.tpr) for r in V.roc_points(sc, ["method", "label"]).collect())
    assert pts == [(0.0, 0.0), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]
    auc = V.auc(sc, ["method", "label"]).collect()[0]["auc"]
    assert auc == pytest.approx(0.625)  # pairs: tie 1/2 + 1 + 0 + 1 over 4


def test_auc_null_without_negatives(spark):
    rows = [("m", "h1", "a", "a", 0.9), ("m", "h2", "a", "a", 0.3)]
    sc = V.binarize(spark.createDataFrame(rows, "method string, header string, label_true string, label string, p double"))
    assert V.auc(sc, ["method", "label"]).collect()[0]["auc"] is None


def test_f1_absent_class_scores_zero(spark):
    rows = [("m", "h1", "a", "a"), ("m", "h2", "a", "c"), ("m", "h3", "b", "b")]
    best = spark.createDataFrame(rows, "method string, header string, label_true string, label string")
    r = V.f1_scores(best, ["method"]).collect()[0]
    # classes a (f1 2/3), b (1), c (0, predicted only)
    assert r.f1_macro == pytest.approx((2 / 3 + 1 + 0) / 3)


def test_macro_roc_interpolation(spark):
    pts = spark.createDataFrame([("m", "a", 0.0, 0.0), ("m", "a", 1.0, 1.0), ("m", "b", 0.0, 0.0), ("m", "b", 0.5, 0.5),
                                 ("m", "b", 0.5, 1.0), ("m", "b", 1.0, 1.0)], "method string, label string, fpr double, tpr double")
    got = {r.fpr: r.mean_tpr for r in V.macro_roc(pts, ["method"]).collect()}
    # at 0.5: class a interpolates 0.5, class b takes the highest tpr at the repeated fpr (1.0)
    assert got[0.5] == pytest.approx(0.75) and got[0.0] == 0.0 and got[1.0] == 1.0


def test_duplicate_headers_join_fan_out_and_last_wins(spark):
    base = spark.createDataFrame([("h1",), ("h2",)], "header string")
    preds = spark.createDataFrame([("h1", "x"), ("h1", "y")], "header string, label string")
    fan = A.join_predictions(base, {"m": preds})
    assert fan.where("header = 'h1'").count() == 2
    train = spark.createDataFrame([("h1", "a", 0), ("h1", "b", 1)], "header string, label string, seq_no int")
    lt = {r.header: r.label_train for r in A.train_label_lookup(base, train).collect()}
    assert lt == {"h1": "b", "h2": ""}


@pytest.mark.parametrize("length, block", [(12, 4096), (70, 64)])
def test_max_identity_matches_brute_force(spark, monkeypatch, length, block):
    monkeypatch.setattr(I, "T_BLOCK", block)
    rng = np.random.default_rng(length)
    alpha = np.array(list("-ACDE" if length < 64 else "-ACDEFGHIKLMNPQRSTVWY"))
    q = ["".join(rng.choice(alpha, length)) for _ in range(40)]
    t = ["".join(rng.choice(alpha, length)) for _ in range(300)] + [q[0]] * 200  # a heavily duplicated train row
    t += [q[1][:i] + "K" + q[1][i + 1:] for i in range(length)]  # many equally near ones
    names = [f"t{i * 7919 % 1000:03d}" for i in range(len(t))]
    qdf = spark.createDataFrame([(f"q{i}", s) for i, s in enumerate(q)] + [("long", "A" * 300), ("none", None), ("empty", "")], "header string, sequence_align string")
    tdf = spark.createDataFrame(list(zip(names, t)) + [("x", ""), ("y", None)], "header string, sequence_align string")
    got = {r.header: r for r in I.max_train_identity(qdf, tdf, q_group=7).collect()}
    for i, s in enumerate(q):
        best = min((-sum(a == b for a, b in zip(s, x)), h) for h, x in zip(names, t))
        assert got[f"q{i}"].seq_id_train == pytest.approx(-best[0] / length) and got[f"q{i}"].nearest == best[1]
    assert all(got[h].seq_id_train is None and got[h].nearest is None for h in ("long", "none", "empty"))  # no training sequence of that length
    none = I.max_train_identity(qdf, tdf.where("false")).collect()
    assert len(none) == 43 and all(r.seq_id_train is None and r.nearest is None for r in none)


def test_identity_split(spark):
    train = spark.createDataFrame([("t", "AAAAAAAAAA")], "header string, sequence_align string")
    rows = [(f"q{i}", "A" * i + "C" * (10 - i)) for i in range(11)]
    got = {r.header: r.t1s for r in I.identity_split(spark.createDataFrame(rows, "header string, sequence_align string"), train, (0.4, 0.7)).collect()}
    assert got == {f"q{i}": [t for t in (0.4, 0.7) if i / 10 <= t] for i in range(11)}


def test_bit_planes_count_any_symbol_and_length():
    rng = np.random.default_rng(6)
    for L in (1, 63, 64, 65, 300):
        q = [bytes(rng.integers(33, 127, L, dtype=np.uint8)) for _ in range(9)]
        t = [bytes(rng.integers(33, 127, L, dtype=np.uint8)) for _ in range(30)] + [q[4]]
        near = I.Nearest(q, L, I.symbol_codes({ord('x'): 3, 200: 1}))
        near.see(t[:20], [f"h{j:02d}" for j in range(20)])
        near.see(t[20:], [f"h{j:02d}" for j in range(20, 31)])
        best = [min((L - sum(a == b for a, b in zip(x, z)), f"h{j:02d}") for j, z in enumerate(t)) for x in q]
        assert list(zip(near.wrong.tolist(), near.header)) == best


def test_roc_of_a_class_without_positives_is_null_and_left_out(spark):
    rows = [("m", "h1", "a", "a", 0.9), ("m", "h2", "a", "a", 0.3), ("m", "h1", "a", "b", 0.1), ("m", "h2", "a", "b", 0.7),
            ("m", "h3", "c", "c", 0.9), ("m", "h1", "a", "c", 0.2)]
    sc = V.binarize(spark.createDataFrame(rows, "method string, header string, label_true string, label string, p double"))
    pts = V.roc_points(sc, ["method", "label"])
    assert {r.tpr for r in pts.where("label = 'b' and threshold is not null").collect()} == {None}
    assert {r.fpr: r.mean_tpr for r in V.macro_roc(pts, ["method"]).collect()} == {0.0: 1.0, 1.0: 1.0}


def test_last_training_label_needs_an_order(spark):
    base = spark.createDataFrame([("h1",)], "header string")
    with pytest.raises(ValueError, match="order column"):
        A.train_label_lookup(base, spark.createDataFrame([("h1", "z"), ("h1", "a")], "header string, label string"))


def test_repeated_headers_keep_their_own_predictions(spark):
    from labelflow.operators.profile import fit_profiles, predict_wide
    train = spark.createDataFrame([("x", "A" * 64), ("y", "C" * 64)], "label string, sequence_align string")
    rows = spark.createDataFrame([("h", "A" * 64, "A" * 64, "x", False), ("h", "C" * 64, "C" * 64, "y", False), ("t", "C" * 64, "C" * 64, "x", True), ("u", "?" * 64, "?" * 64, "x", False)],
                                 "header string, sequence string, sequence_align string, label string, is_train boolean")
    wide, labels = predict_wide(fit_profiles(train), rows, keep=("sequence", "sequence_align", "label", "is_train"))
    got = sorted((r.header, r.sequence[0], r.label_msa, r.label_msa_hi, r.label_train) for r in A.augment_labels(wide, labels).collect())
    # a row without any known symbol has no confident label
    assert got == [("h", "A", "x", "x", ""), ("h", "C", "y", "y", ""), ("t", "C", "x", "", "x"), ("u", "?", "x", "", "")]
    assert [list(r.p_msa) for r in wide.where("header = 'u'").collect()] == [[0.5, 0.5]]


def test_zero_vector_stays_zero(spark):
    from labelflow.operators import embeddings as EM
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    assert [list(r[0]) for r in df.select(EM.l2_normalize("v")).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_masked_pool_and_hidden_means_against_loops(spark):
    from labelflow.operators import embeddings as EM, rbm as RB
    vec = np.arange(12.0).reshape(4, 3)
    df = spark.createDataFrame([("a", [0, 1, 1, 3], [0, 1, 1, 1]), ("b", [2], [0]), ("c", [3], [1])], "header string, tok array<int>, mask array<int>")
    got = {r.header: r.pooled for r in EM.masked_mean_pool(df, "tok", "mask", vec, ("header",)).collect()}
    assert np.allclose(got["a"], (2 * vec[1] + vec[3]) / 3) and got["b"] is None and np.allclose(got["c"], vec[3])
    w = spark.createDataFrame([(h, p, a, 0.1 * h + p * (1 if a == "A" else -1)) for h in range(2) for p in (1, 2) for a in "AC"], "h int, pos int, aa string, w double")
    b = spark.createDataFrame([(0, 0.5), (1, -0.5)], "h int, b double")
    s = spark.createDataFrame([("x", "AC"), ("y", "C?")], "header string, sequence_align string")
    act = {(r.header, r.h): r.act for r in RB.hidden_mean(s, w, b).collect()}
    sig = lambda v: 1 / (1 + np.exp(-v))
    assert act["x", 1] == pytest.approx(sig(0.1 + 1 + 0.1 - 2 - 0.5)) and act["y", 0] == pytest.approx(sig(-1 + 0.5))


def test_pair_counts_gram_equals_self_join(spark):
    rows = [("a", "AC-D"), ("a", "ACDD"), ("b", "CC-A"), ("b", "AC-D")]
    df = spark.createDataFrame(rows, "label string, sequence_align string")
    got = {(r.grp, r.i, r.a, r.j, r.b): r.n for r in P.pair_counts(df, L=4).collect()}
    from labelflow.constants import ALPHABET
    exp = {}
    for lab, s in rows:
        for g in (lab, "global"):
            for i in range(4):
                for j in range(i + 1, 4):
                    k = (g, i + 1, ALPHABET.index(s[i]), j + 1, ALPHABET.index(s[j]))
                    exp[k] = exp.get(k, 0) + 1
    assert got == exp


def test_pair_correlation_counts_zero_cells(spark):
    # identical sets correlate perfectly; fij = 0 cells with fi fj > 0 are included
    rows = [("a", "ACDE"), ("a", "CADE"), ("a", "ACED")]
    df = spark.createDataFrame(rows, "label string, sequence_align string")
    r = {x.label: x.pearson for x in P.pair_correlation(df, df, L=4).collect()}
    assert r["a"] == pytest.approx(1.0) and r["global"] == pytest.approx(1.0)


def test_density_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.0,)], "x double").withColumn("g", F.lit(1))
    h = {r.bin: r.density for r in I.density_histogram(df, "x", ["g"], width=0.5).collect()}
    assert h == {0: pytest.approx(0.5), 1: pytest.approx(1.5)}


def test_factorised_pearson_matches_dense_brute_force(spark):
    from labelflow.constants import ALPHABET, Q
    rng = np.random.default_rng(1)
    L = 5
    alpha = list("-ACDEG")

    def rand_set(n, lab):
        return [(lab, "".join(rng.choice(alpha, L))) for _ in range(n)]
    data = rand_set(30, "a") + rand_set(20, "b")
    model = rand_set(25, "a") + rand_set(15, "b")

    def dense_c(rows):
        codes = np.array([[ALPHABET.index(ch) for ch in s] for _, s in rows])
        oh = np.zeros((len(rows), L, Q))
        oh[np.arange(len(rows))[:, None], np.arange(L)[None, :], codes] = 1
        fi = oh.mean(0)
        fij = np.einsum("nia,njb->iajb", oh, oh) / len(rows)
        c = fij - np.einsum("ia,jb->iajb", fi, fi)
        iu = [(i, j) for i in range(L) for j in range(i + 1, L)]
        return np.concatenate([c[i, :, j, :].ravel() for i, j in iu])

    exp = {}
    for g in ("a", "b", "global"):
        d = [r for r in data if g == "global" or r[0] == g]
        m = [r for r in model if g == "global" or r[0] == g]
        exp[g] = np.corrcoef(dense_c(d), dense_c(m))[0, 1]
    dd = spark.createDataFrame(data, "label string, sequence_align string")
    mm = spark.createDataFrame(model, "label string, sequence_align string")
    got = {r.label: r.pearson for r in P.pair_correlation(dd, mm, L=L).collect()}
    for g, v in exp.items():
        assert got[g] == pytest.approx(v, abs=1e-9)


def test_kmer_composition(spark):
    from labelflow.operators import embeddings as EM
    seqs = ["ACAC", "", None, "A", "AB-CC", "WYW"]
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(seqs)], "id string, s string")
    letters = "ACDEFGHIKLMNPQRSTVWY"
    got = {int(r.id): r.v for r in EM.embed_sequences(df, "s", EM.kmer_encoder(2), ("id",), out="v").collect()}
    for i, s in enumerate(seqs):
        want = {}
        for a, b in zip(s or "", (s or "")[1:]):
            if a in letters and b in letters:
                want[letters.index(a) * 20 + letters.index(b)] = want.get(letters.index(a) * 20 + letters.index(b), 0) + 1
        assert {j: n for j, n in enumerate(got[i]) if n} == want


def test_macro_roc_over_many_partitions_equals_interpolation(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for m in ("m", "n"):
        curves = {}
        for c in "abc":
            x = np.sort(np.append(rng.integers(0, 400, 300) / 400, [0.0, 1.0]))
            y = np.sort(np.append(rng.uniform(size=300), [0.0, 1.0]))
            curves[c] = (x, y)
            rows += [(m, c, float(a), float(b)) for a, b in zip(x, y)]
        for g in np.unique(np.concatenate([x for x, _ in curves.values()])):
            ys = []
            for x, y in curves.values():
                i = np.searchsorted(x, g, side="right") - 1  # the highest tpr at a repeated fpr
                ys.append(y[i] if x[i] == g else y[i] + (g - x[i]) * (y[i + 1] - y[i]) / (x[i + 1] - x[i]))
            want[m, float(g)] = np.mean(ys)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "method string, label string, fpr double, tpr double")
        got = {(r.method, r.fpr): r.mean_tpr for r in V.macro_roc(df, ["method"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


@pytest.mark.parametrize("name, columns", [("space_residues", {"doc_id", "text"}), ("one_hot", {"doc_id", "text"}), ("encode_residues", {"doc_id", "text"})])
def test_one_pass_queries_scan_once_without_exchange(spark, name, columns):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == columns


def test_split_filter_reaches_the_documents(spark):
    from conftest import SF_SMALL
    from labelflow.plans.fixtures import seq_table
    plan = seq_table(spark, SF_SMALL).where("is_train").select("header")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join Inner")  # windows are cut from labelled documents only
