"""Session helpers.

Library code never builds its own session; it takes the caller's.  ``local_session``
is for tests and the bench only.  ``checkpoint_dir`` reads the shared folder the
cluster names in ``spark.checkpoint.dir`` and only falls back to a scratch folder
when the setting is absent (tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "scoreplane") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # small inputs still get one split per core (parsing is CPU-bound per byte)
        .config("spark.sql.files.minPartitionNum", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        # no Python call-site capture per Column call: plan construction is ~5x cheaper
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: Scratch folder of each application that names no shared one (local masters only); Spark refuses to set the key at run time.
_SCRATCH: dict[str, str] = {}


def _context_dir(spark: SparkSession):
    try:
        return spark.sparkContext.getCheckpointDir()
    except Exception:  # sessions without a local SparkContext
        return None


def _scratch(spark: SparkSession) -> str | None:
    try:
        return _SCRATCH.get(spark.sparkContext.applicationId)
    except Exception:  # as above
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master that names none (tests) gets a scratch folder; on a cluster each
    executor would write to a disk of its own, so there it is an error."""
    current = spark.conf.get("spark.checkpoint.dir", None) or _scratch(spark) or _context_dir(spark)
    if not current:
        if not spark.conf.get("spark.master", "").startswith("local") or "cluster" in spark.conf.get("spark.master"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _SCRATCH:
            _SCRATCH[app] = tempfile.mkdtemp(prefix="scoreplane-ckpt-")
        current = _SCRATCH[app]
    try:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
    except Exception:
        pass
    return current
