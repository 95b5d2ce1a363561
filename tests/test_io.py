"""Sources and sinks round trips."""

import os

import pytest
from pyspark.sql import functions as F

from labelflow.sources import annotated as S


def test_fasta_reader_handles_wrapping_crlf_and_empty(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "q.fasta")
    with open(p, "w", newline="") as f:
        f.write(">id1 first protein\r\nACD\r\nEF\r\n>id2\nGH\n>empty\n>id3 x y\nkl\n")
    rows = {r.header: r.sequence for r in S.read_fasta(spark, p).collect()}
    assert rows == {"id1": "ACDEF", "id2": "GH", "empty": "", "id3": "kl"}
    q = S.read_query(spark, p)
    assert q.columns == ["header", "sequence", "sequence_align", "label"]


def test_csv_reader_overridable_columns_and_required(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "t.csv")
    with open(p, "w") as f:
        f.write("name,seq,lab\nh1,ACD,x\nh2,EF,\n")
    df = S.read_annotated(spark, p, header="name", sequence="seq", align=None, label="lab")
    r = {x.header: (x.sequence, x.label) for x in df.collect()}
    assert r == {"h1": ("ACD", "x"), "h2": ("EF", None)}
    with pytest.raises(ValueError, match="missing required"):
        S.read_annotated(spark, p)


def test_labelled_csv_empty_labels(spark, tmpdir_path):
    df = spark.createDataFrame([("h1", None), ("h2", "x")], "header string, label string")
    out = os.path.join(tmpdir_path, "out")
    S.write_labelled_csv(df, out, rename={"label": "label_msa_0.8"})
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".csv"))
    assert "label_msa_0.8" in text and "h1,\n" in text


def test_prediction_archive_partition_pruning(spark, tmpdir_path):
    df = spark.createDataFrame([("h1", "x", "RR", 0.4, 100, "msa"), ("h2", "y", "RR", 0.4, 500, "msa")],
                               "header string, label string, dataset string, t1 double, n_train int, method string")
    path = os.path.join(tmpdir_path, "arch")
    S.write_predictions(df, path)
    got = S.read_predictions(spark, path, dataset="RR", n_train=500)
    assert [r.header for r in got.collect()] == ["h2"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "dataset" in filters and "n_train" in filters


def test_fasta_arrows_in_descriptions(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "arrow.fasta")
    with open(p, "w") as f:
        f.write(">id1 A->B transporter > x\nACD\nEF\n>id2 >y\nGh-k\n")
    assert {r.header: r.sequence for r in S.read_fasta(spark, p).collect()} == {"id1": "ACDEF", "id2": "Gh-k"}


def test_rbm_params_latest_update(spark, tmpdir_path):
    df = spark.createDataFrame([(0, 1, 0.1), (2, 1, 0.3), (1, 1, 0.2)], "update int, h int, w double")
    path = os.path.join(tmpdir_path, "rbm")
    df.write.parquet(path)
    assert [r.w for r in S.read_rbm_params(spark, path).collect()] == [0.3]
    assert [r.w for r in S.read_rbm_params(spark, path, update=1).collect()] == [0.2]


def test_experiment_catalog(spark):
    g = S.experiment_catalog(spark)
    assert g.count() == 2 * 4 + 3 + 1 + 1
    assert g.where((F.col("dataset") == "RR") & (F.col("t1") == 0.4) & (F.col("n_train") == 100)) \
        .first().train_path.endswith("RR/t10.4_t20.7/train_100.csv")


def test_annotate_files_writes_archive_and_labels(spark, tmpdir_path):
    from labelflow.operators.classify import annotate_files
    train, query = os.path.join(tmpdir_path, "train.csv"), os.path.join(tmpdir_path, "q.fasta")
    with open(train, "w") as f:
        f.write("header,sequence,sequence_align,label\n" + "".join(f"t{i},{s},{s},{c}\n" for i, (s, c) in enumerate([("A" * 64, "x"), ("C" * 64, "y")] * 10)) + f"u,{'D' * 64},{'D' * 64},\n")
    with open(query, "w") as f:
        f.write(f">q1 first\n{'A' * 40}\n{'A' * 24}\n>q2\n{'C' * 64}\n")
    out = os.path.join(tmpdir_path, "out")
    got = {r.header: (r.label, r.p) for r in annotate_files(spark, train, query, out, "D", 0.4, 20).collect()}
    assert got["q1"][0] == "x" and got["q2"][0] == "y" and min(p for _, p in got.values()) > 0.6
    arch = S.read_predictions(spark, out + "/archive", dataset="D", n_train=20).collect()
    assert {r.header: r.label for r in arch} == {"q1": "x", "q2": "y"} and all(abs(sum(r.probs) - 1) < 1e-6 for r in arch)
    csv = spark.read.option("header", True).csv(out + "/labels_csv")
    assert {r.header: r.label for r in csv.collect()} == {"q1": "x", "q2": "y"}


def test_annotate_files_uses_the_whole_alignment(spark, tmpdir_path):
    from labelflow.operators.classify import annotate_files
    train, query = os.path.join(tmpdir_path, "train.csv"), os.path.join(tmpdir_path, "q.fasta")
    x, y = "A" * 64 + "CCCCCC", "A" * 64 + "DDDDDD"  # alike up to site 64
    with open(train, "w") as f:
        f.write("header,sequence,sequence_align,label\n" + "".join(f"t{i},{s},{s},{c}\n" for i, (s, c) in enumerate([(x, "x"), (y, "y")] * 10)))
    with open(query, "w") as f:
        f.write(f">q1\n{x}\n>q2\n{y}\n>q3\n{y[:67]}\n")
    got = {r.header: (r.label, r.p) for r in annotate_files(spark, train, query, os.path.join(tmpdir_path, "out"), "D", 0.4, 20).collect()}
    assert {h: c for h, (c, _) in got.items()} == {"q1": "x", "q2": "y", "q3": "y"} and got["q1"][1] > 0.6 and got["q2"][1] > 0.6
    with open(query, "a") as f:
        f.write(f">q4\n{x}A\n")
    with pytest.raises(ValueError, match="71 sites"):
        annotate_files(spark, train, query, os.path.join(tmpdir_path, "none"), "D", 0.4, 20)
    assert not os.path.exists(os.path.join(tmpdir_path, "none"))


def test_longer_sequences_are_not_cut(spark):
    from labelflow.operators import classify, profile, rbm
    import numpy as np
    q = spark.createDataFrame([("h", "ACDEF")], "header string, sequence_align string")
    w = spark.createDataFrame([(0, i, "A", 0.5) for i in range(1, 5)], "h int, pos int, aa string, w double")
    b = spark.createDataFrame([(0, 0.0)], "h int, b double")
    model = profile.ProfileModel(["x"], np.ones(1), {n: np.ones((4, 22, 1)) for n, _, _ in profile.PREDICTORS})
    for rows in (classify.onehot_features(q, L=4), profile.score_rows({"": model}, q, 4), rbm.hidden_vectors(q, w, b)):
        with pytest.raises(Exception, match="sequence of 5 sites"):
            rows.collect()
