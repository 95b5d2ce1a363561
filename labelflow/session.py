"""Session helpers.

On a cluster the session is created by the platform; we only read its settings. The
checkpoint directory must be a shared folder named by ``spark.checkpoint.dir``; a local
temporary folder is only used when the setting is absent and the master is local (tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


# numpy inside tasks: one BLAS thread per task (the task slots already use every core)
for _v in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_v, "1")


def get_spark(master: str | None = None, app: str = "labelflow", shuffle_partitions: int | None = None,
              driver_memory: str = "16g") -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor, its heap is the only memory knob
            b = b.config("spark.driver.memory", driver_memory)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.executorEnv.OMP_NUM_THREADS", "1")
         .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a scratch one only where none is configured."""
    d = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="labelflow-ckpt-")  # one machine: driver and executors share its disk
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d
