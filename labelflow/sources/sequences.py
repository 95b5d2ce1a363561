"""Annotated sequence tables derived from the given `documents` and `labels` tables.

Every document's residue letters are cut into consecutive windows of ``window`` symbols
(the last window is padded with gaps), so the whole text of every document is used. Each
window is one aligned sequence: header ``<doc_id>_<k>``, label = document language, and it
belongs to the labelled (training) split when its document appears in ``labels``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.constants import GAP, WINDOW
from labelflow.functions.residues import residue_letters, strip_gaps
from labelflow.sources.tables import table


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per window: doc_id, k, sequence_align (narrow, no shuffle).

    The chunks are cut inside the document row first and only the chunk is exploded, so a row
    never carries the whole text (linear in text length, also for very long documents)."""
    d = docs.select("*", residue_letters("text").alias("_s")).drop("text").where(F.length("_s") > 0)
    # one linear regex pass cuts all chunks (substr per chunk would rescan the UTF-8 prefix each time)
    chunks = F.regexp_extract_all(F.col("_s"), F.lit(f"(.{{1,{window}}})"), 1)
    w = d.select(*[c for c in d.columns if c != "_s"], F.posexplode(chunks).alias("k", "_c"))
    return w.withColumn("sequence_align", F.rpad("_c", window, GAP)).drop("_c")


#: session setting for inputs that come as few large row groups, which a scan can't split: the number of partitions
#: that documents are dealt to before any work. Unset (the default), the scan's own splits are used.
SCAN_PARTITIONS = "spark.labelflow.scanPartitions"


def seqs(spark: SparkSession, sf_dir: str, window: int = WINDOW, with_split: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """seqs(header, sequence, sequence_align, label, is_train, doc_id, k, *keep) with columns of the documents carried along; without the
    split column, `labels` is not read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label"), *keep)
    spread = spark.conf.get(SCAN_PARTITIONS, None)
    if spread:
        docs = docs.repartition(int(spread), "doc_id")
    header = F.concat_ws("_", F.col("doc_id").cast("string"), F.col("k").cast("string")).alias("header")
    cols = [header, strip_gaps("sequence_align").alias("sequence"), "sequence_align", "label"]
    if not with_split:
        return windows(docs, window).select(*cols, "doc_id", F.col("k").cast("int").alias("k"), *keep)
    # labelled documents; distinct guards against duplicate doc ids fanning out the join. Joined before the windows
    # are cut, so a filter on is_train becomes a semi or anti join of documents
    lab = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("is_train", F.lit(True))
    docs = docs.join(lab, "doc_id", "left").withColumn("is_train", F.coalesce("is_train", F.lit(False)))
    return windows(docs, window).select(*cols, "is_train", "doc_id", F.col("k").cast("int").alias("k"), *keep)


def split(seq_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, query) halves of a seqs table."""
    return seq_df.where(F.col("is_train")), seq_df.where(~F.col("is_train"))


def sites(seq_df: DataFrame, keep: tuple[str, ...] = ("header", "is_train", "label")) -> DataFrame:
    """Long site table: one row per (sequence, position); pos is 1-based. Narrow (no shuffle)."""
    return seq_df.select(*keep, F.posexplode(F.split("sequence_align", "")).alias("pos0", "aa")) \
        .select(*keep, (F.col("pos0") + 1).cast("int").alias("pos"), "aa")
