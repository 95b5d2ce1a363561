"""The corpus pipeline: quality rules, toxicity, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and reread as the next one's
docs. All but the last return the columns of `documents`. Models are fitted to the labelled rows of the whole
`documents` table of sf_dir (at most about 20,000 of them), so a stage's decisions do not depend on what came before.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from labelflow.llm import exact_dedup, near_dup, packing, quality, toxicity
from labelflow.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one_per_class(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), window=2048, end_id=1)


STAGES = [("quality", quality_rules), ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dup", drop_near_copies), ("packing", pack)]

#: fitted models and a tokenizer have no SQL; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
