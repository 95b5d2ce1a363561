"""Plan helpers shared by operators: reliable materialisation, rounding."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.constants import OUT_DIGITS, RANK_DIGITS
from labelflow.session import checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or checkpoint_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_files(address: str):
    """(file system, path) of a shared folder for use inside of tasks: a mount, or a store that pyarrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address if "://" in address or address.startswith("/") else f"/{address.removeprefix('file:').lstrip('/')}")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to the session's shuffle partitions where they come in fewer (a file of one large row group, which a scan
    cannot split): what follows is heavier than moving them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def rank_value(p) -> Column:
    """Probability used for ranking and thresholds (rounded so both engines agree on ties)."""
    return F.round(F.col(p) if isinstance(p, str) else p, RANK_DIGITS)


def out(c, name: str) -> Column:
    """Round a double result for output."""
    return F.round(F.col(c) if isinstance(c, str) else c, OUT_DIGITS).alias(name)
