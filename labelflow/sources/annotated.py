"""Readers and writers for annotated sequence tables, FASTA files and prediction archives.

- A1 read_annotated: CSV with overridable column names -> canonical (header, sequence,
  sequence_align, label); all strings, no schema inference.
- A2 read_fasta: records split at lines that start with '>' by the text reader (no whole-file reads);
  id = first whitespace token of the description, sequence = the remaining lines joined.
- A3 read_query: FASTA if the first line starts with '>', else CSV (one line is read to decide).
- A4/A5 predictions archive: Parquet partitioned by experiment keys; reads filter on partition
  columns so only the matching directories are listed and scanned (partition pruning).
- A6 write_labelled_csv: CSV with empty strings for missing labels.
- A7 read_rbm_params: versioned parameter table; default = last saved update.
- A8 experiment_catalog: the grid of experiment keys as a DataFrame.
- A9 require_columns: readable error before any job runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.functions.residues import fasta_header_id

CANONICAL = ("header", "sequence", "sequence_align", "label")
PARTITION_KEYS = ("dataset", "t1", "n_train", "method")


def require_columns(df: DataFrame, cols, what: str = "input") -> DataFrame:
    """A9."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required column(s) {missing}; available: {df.columns}")
    return df


def read_annotated(spark: SparkSession, path: str, header: str = "header", sequence: str = "sequence",
                   align: str | None = "sequence_align", label: str | None = "label",
                   required: tuple[str, ...] = ("header", "sequence")) -> DataFrame:
    """A1: CSV -> canonical columns; optional columns that are absent become NULL."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", False).csv(path)
    names = {"header": header, "sequence": sequence, "sequence_align": align, "label": label}
    require_columns(raw, [names[c] for c in required if names[c]], f"CSV {path}")
    cols = []
    for canon, src in names.items():
        if src and src in raw.columns:
            c = F.col(f"`{src}`")
            cols.append((F.when(F.trim(c) == "", F.lit(None)).otherwise(c) if canon == "label" else c).alias(canon))
        else:
            cols.append(F.lit(None).cast("string").alias(canon))
    return raw.select(*cols)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """A2: FASTA -> (header, sequence), residues as written. Empty records are dropped; CR characters are ignored.
    Only a '>' at the start of a line begins a record (the first one keeps its own and loses it here)."""
    rec = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace(F.regexp_replace("value", "\r", ""), r"^\s*>", "").alias("r"))
    rec = rec.where(F.length(F.trim("r")) > 0)
    first_nl = F.instr(F.col("r"), "\n")
    desc = F.when(first_nl > 0, F.expr("substr(r, 1, instr(r, '\n') - 1)")).otherwise(F.col("r"))
    body = F.when(first_nl > 0, F.expr("substr(r, instr(r, '\n') + 1)")).otherwise(F.lit(""))
    return rec.select(fasta_header_id(desc).alias("header"),
                      F.regexp_replace(body, r"\s", "").alias("sequence"))


def read_query(spark: SparkSession, path: str, **csv_names) -> DataFrame:
    """A3: sniff the first line; FASTA gets NULL sequence_align and label columns."""
    first = spark.read.text(path).limit(1).collect()
    if first and first[0][0].lstrip().startswith(">"):
        f = read_fasta(spark, path)
        return f.select("header", "sequence", F.lit(None).cast("string").alias("sequence_align"),
                        F.lit(None).cast("string").alias("label"))
    return read_annotated(spark, path, **csv_names)


def write_predictions(df: DataFrame, path: str, keys: tuple[str, ...] = PARTITION_KEYS, mode: str = "append") -> None:
    """A5: archive rows (header, label, probs/embedding ...) partitioned by the experiment keys."""
    require_columns(df, keys, "prediction archive")
    df.write.mode(mode).partitionBy(*keys).parquet(path)


def read_predictions(spark: SparkSession, path: str, **keys) -> DataFrame:
    """A4: archive scan filtered on partition keys (pruned at listing time)."""
    df = spark.read.parquet(path)
    for k, v in keys.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def write_labelled_csv(df: DataFrame, path: str, rename: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    """CSV sink; NULL labels become empty fields (the reference's na_rep="")."""
    out = df
    for a, b in (rename or {}).items():
        out = out.withColumnRenamed(a, b)
    out.write.mode(mode).option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def read_rbm_params(spark: SparkSession, path: str, update: int | None = None) -> DataFrame:
    """A7 (+E5): parameters at ``update``; the last saved update when None."""
    df = spark.read.parquet(path)
    if update is None:
        last = df.agg(F.max("update").alias("update"))
        return df.join(F.broadcast(last), "update", "left_semi")
    return df.where(F.col("update") == update)


# The experiment grid of the reference (dataset -> split thresholds t1, training sizes)
GRID = {
    "RR": ([0.4, 0.7], [100, 500, 1000, 2000]),
    "SH3": ([0.7], [100, 500, 1000]),
    "Globin": ([0.7], [1393]),
    "CM": ([0.7], [529]),
}


def experiment_catalog(spark: SparkSession, grid: dict | None = None, root: str = "experiments/datasets") -> DataFrame:
    """Dataset x t1 x n_train rows with the derived input paths as columns."""
    grid = grid or GRID
    rows = [(d, float(t), int(n)) for d, (ts, ns) in grid.items() for t in ts for n in ns]
    g = spark.createDataFrame(rows, "dataset string, t1 double, n_train int")
    base = F.concat_ws("/", F.lit(root), "dataset", F.concat(F.lit("t1"), F.col("t1").cast("string"), F.lit("_t20.7")))
    return g.select("dataset", "t1", "n_train", F.concat_ws("/", base, F.concat(F.lit("train_"), F.col("n_train").cast("string"),
                                                                              F.lit(".csv"))).alias("train_path"),
                    F.concat_ws("/", base, F.lit("test.csv")).alias("test_path"))
