"""Streaming annotation: query windows arriving as files are scored by a fitted (materialised)
site-profile model in every micro-batch, and high-confidence labels are appended to a Parquet
sink. The scorer is a batch operator (it aggregates each sequence's sites), so it runs inside
``foreachBatch`` on the static micro-batch DataFrame; no streaming state is kept, and each batch
writes its own directory so a replayed batch overwrites rather than duplicates (exactly-once)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.constants import CONFIDENCE, METHODS
from labelflow.operators.profile import argmax, predict_wide


def annotate_batch(batch: DataFrame, profile: DataFrame, thr: float = CONFIDENCE) -> DataFrame:
    wide, labels = predict_wide(profile, batch.select("header", "sequence_align"))
    cols = []
    for m in METHODS:
        lab, p = argmax(F.col(f"p_{m}"), labels)
        cols += [lab.alias(f"label_{m}"), p.alias(f"p_{m}"),
                 F.when(F.round(p, 9) >= thr, lab).otherwise(F.lit("")).alias(f"label_{m}_hi")]
    return wide.select("header", *cols)


def start_annotation_stream(spark, source_dir: str, schema: str, profile: DataFrame, sink_dir: str,
                            checkpoint: str, thr: float = CONFIDENCE, trigger_once: bool = False):
    """readStream (parquet files with header, sequence_align) -> foreachBatch(score) -> parquet."""
    stream = spark.readStream.schema(schema).parquet(source_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        annotate_batch(batch, profile, thr).write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch={batch_id}"))

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
