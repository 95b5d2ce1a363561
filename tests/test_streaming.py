"""Structured Streaming annotation over files, scored per micro-batch."""

import os

from pyspark.sql import functions as F

from labelflow.operators.profile import fit_profiles
from labelflow.plans.fixtures import seq_table
from labelflow.streaming.annotate import annotate_batch, start_annotation_stream
from conftest import SF_SMALL


def test_stream_equals_batch(spark, tmpdir_path):
    s = seq_table(spark, SF_SMALL)
    prof = fit_profiles(s.where("is_train").select("label", "sequence_align"))
    q = s.where(~F.col("is_train")).select("header", "sequence_align")
    src = os.path.join(tmpdir_path, "src")
    q.repartition(3).write.parquet(src)
    sink, ck = os.path.join(tmpdir_path, "sink"), os.path.join(tmpdir_path, "ck")
    h = start_annotation_stream(spark, src, "header string, sequence_align string", prof, sink, ck, trigger_once=True)
    h.awaitTermination(300)
    got = spark.read.parquet(sink).drop("batch")
    exp = annotate_batch(q, prof)
    assert got.count() == exp.count()
    assert got.select("header", "label_msa", "label_msa_hi").subtract(exp.select("header", "label_msa", "label_msa_hi")).count() == 0
