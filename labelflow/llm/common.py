"""Helpers shared by the operators: table access, shared scratch tables, text columns."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.session import checkpoint_dir

#: ASCII white space, as the contracts define it: [\x20\x09-\x0D]
WHITE = " \t\n\x0b\x0c\r"
#: rows that a Python stage works on at a time
SLICE = 1024
#: a word is a maximal run of anything but white space
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: later steps survive a lost executor
    and run the work behind it once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def stripped(c: Column) -> Column:
    """The text without any ASCII white space."""
    return F.regexp_replace(c, r"[\x20\x09-\x0D]+", "")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sparing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same for batches of SLICE rows (a batch of whole texts is large), returning to the system, at the end of the task, the memory
    that Arrow and the C library would hold on to: a worker outlives its task, and idle ones count."""

    def slices(batches):
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                yield b.slice(lo, SLICE)

    def frugal(batches):
        try:
            yield from run(slices(batches))
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return frugal
