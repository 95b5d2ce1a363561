"""Spark-side building blocks shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.operators.profile import PREDICTORS, argmax, fit_profiles, long_preds, predict_wide
from labelflow.sources.sequences import seqs


def seq_table(spark: SparkSession, sf_dir: str, with_split: bool = True) -> DataFrame:
    """All windows, as a plain scan: every query prunes and filters it for itself. Queries that do not look at the
    train/query split ask for the windows alone."""
    return seqs(spark, sf_dir, with_split=with_split)


def profile_wide(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = (), rows: str = "not is_train"):
    """(seq table, wide preds(header, *keep, p_<method> arrays), sorted class labels) for the chosen rows."""
    s = seq_table(spark, sf_dir)
    prof = fit_profiles(s.where(F.col("is_train")).select("label", "sequence_align"))
    wide, labels = predict_wide(prof, s.where(rows).select("header", "sequence_align", *(c for c in keep if c != "sequence_align")), keep=keep)
    return s, wide, labels


def profile_preds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(seq table, preds(method, header, label, p)) for the query split, one row per class."""
    s, wide, labels = profile_wide(spark, sf_dir)
    return s, long_preds(wide, labels)


def scored_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """preds with their row's true label: (method, header, label_true, label, p). The label is carried through the
    scoring pass, so truth and scores need no join."""
    _, wide, labels = profile_wide(spark, sf_dir, keep=("label",))
    return long_preds(wide.withColumnRenamed("label", "label_true"), labels, ("header", "label_true"))


def _best(wide: DataFrame, labels: list[str], keep: tuple[str, ...]) -> DataFrame:
    rows = []
    for name, _, _ in PREDICTORS:
        lab, p = argmax(F.col(f"p_{name}"), labels)
        rows.append(F.struct(F.lit(name).alias("method"), lab.alias("label"), p.alias("p")))
    return wide.select(*keep, F.explode(F.array(*rows)).alias("r")).select("r.method", *keep, "r.label", "r.p")


def best_preds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(seq table, best(method, header, label, p)): the argmax per method, computed in-row."""
    s, wide, labels = profile_wide(spark, sf_dir)
    return s, _best(wide, labels, ("header",))


def best_with_truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(seq table, best(method, header, label_true, sequence_align, label, p)), carried through the scoring pass."""
    s, wide, labels = profile_wide(spark, sf_dir, keep=("label", "sequence_align"))
    return s, _best(wide.withColumnRenamed("label", "label_true"), labels, ("header", "label_true", "sequence_align"))
