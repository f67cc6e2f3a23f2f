"""SparkSession helpers.

The library never creates its own cluster settings inside an operator; it
only reads what the session says.  ``get_session`` is for tests, benches
and command-line use.
"""
from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "splitcraft") -> SparkSession:
    """A session with this package's defaults.  Master and number of shuffle
    partitions are set only when passed in, so that those of spark-submit hold."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPLITCRAFT_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` must point at shared storage and
    is taken as given.  Only when it is unset and the master is local (tests) a
    fresh scratch folder is created and registered; on a cluster executors
    would write to different disks, so that is an error.
    """
    current = spark.conf.get(_CHECKPOINT_KEY, None)
    try:
        sc = spark.sparkContext
    except Exception:  # no driver-side context (remote session): the server owns the folder
        return current
    current = current or sc.getCheckpointDir()
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError(f"{_CHECKPOINT_KEY} has to name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="splitcraft-ckpt-")
    spark.conf.set(_CHECKPOINT_KEY, path)
    sc.setCheckpointDir(path)
    return path


def materialize(df):
    """Write ``df`` to the session's checkpoint folder and continue from the
    written copy.  Cuts the lineage (later jobs neither re-run nor re-plan
    the upstream regex chains) and survives executor loss, unlike cached or
    locally checkpointed blocks."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
