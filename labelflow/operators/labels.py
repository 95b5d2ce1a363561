"""Label dimension operators: distinct labels, label index and one-hot, abundance, sizes, relabel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelflow.functions.residues import label_one_hot


def label_index(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Dimension (label, label_idx) with a dense index in sorted label order. The distinct set
    is tiny (classes), so the un-partitioned window runs over that small table only."""
    d = df.select(F.col(label_col).alias("label")).where(F.col("label").isNotNull()).distinct()
    return d.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int").alias("label_idx"))


def with_label_index(df: DataFrame, dim: DataFrame, label_col: str = "label") -> DataFrame:
    """Join rows to the label dimension (one row per class; the planner chooses the join)."""
    return df.join(dim.withColumnRenamed("label", label_col), label_col, "left")


def to_label(df: DataFrame, dim: DataFrame, idx_col: str, out_col: str = "label") -> DataFrame:
    """C9 inverse: index -> label text."""
    d = dim.select(F.col("label_idx").alias(idx_col), F.col("label").alias(out_col))
    return df.join(d, idx_col, "left")


def one_hot_labels(df: DataFrame, dim: DataFrame, n_classes: int) -> DataFrame:
    """F16: label -> dense one-hot array (n_classes from the fitted dimension)."""
    return with_label_index(df, dim).withColumn("label_one_hot", label_one_hot("label_idx", n_classes))


def distinct_labels(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """Labels in sorted order and in first-appearance order (by ``order_cols``)."""
    first = df.groupBy("label").agg(F.min(F.struct(*order_cols)).alias("_first"))
    return first.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int").alias("sorted_idx"),
                        (F.row_number().over(Window.orderBy("_first")) - 1).cast("int").alias("appearance_idx"),
                        *[F.col(f"_first.{c}").alias(f"first_{c}") for c in order_cols])


def class_abundance(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per (split, label)."""
    return df.groupBy(split_col, "label").agg(F.count(F.lit(1)).alias("n"))


def dataset_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    """D3: rows, distinct labels and same-label pair count sum n(n-1)/2 per split."""
    per = df.groupBy(split_col, "label").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(split_col).agg(F.sum("n").cast("long").alias("n_rows"),
                                      F.count("label").alias("n_labels"),
                                      F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"))


def relabel(df: DataFrame, col: str, mapping: dict[str, str]) -> DataFrame:
    """Value -> display value through a literal map; other values unchanged."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return df.withColumn(col, F.coalesce(F.element_at(m, F.col(col)), F.col(col)))
