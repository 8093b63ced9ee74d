"""Cutting lineage through storage that every executor can read."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

#: Seconds between two requests to the driver to collect garbage.
_EVERY = 1.0
_last = [0.0]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir. Where nothing is set, a local session gets a folder of its own; a
    cluster needs one that all executors reach, so there it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plumbline-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint, so a lost executor costs no recomputation of what is above.

    Shuffle files and checkpoints (with spark.cleaner.referenceTracking.cleanCheckpoints) of what is no longer referred
    to stay on disk until the driver collects garbage, so ask it to, now and then.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    if time.monotonic() - _last[0] > _EVERY:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        _last[0] = time.monotonic()
    return out
