"""Spark session and checkpoint-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.errors import PySparkAttributeError
from pyspark.sql import SparkSession

# Settings every job wants: AQE (runtime coalescing, skew-join splitting,
# broadcast switch on measured sizes), UTC dates, Arrow for pandas exchange.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoints in the shared folder are deleted once no plan refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(
    app: str = "ledgerspark",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    ``master`` and ``shuffle_partitions`` are only set when given, so a
    cluster submit keeps its own values.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be configured (a shared file system).
    Only a local-mode session (tests, bench) gets a scratch folder of its own.
    A Spark Connect session has no ``SparkContext``: the server's
    ``spark.checkpoint.dir`` is used as configured.
    """
    try:
        sc = spark.sparkContext
    except PySparkAttributeError:  # Spark Connect: checkpoints are server-side
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir()
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):  # local-cluster has executors of its own
        raise RuntimeError(
            "spark.checkpoint.dir is not set: configure a shared folder for checkpoints"
        )
    path = tempfile.mkdtemp(prefix="ledgerspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def reliable_checkpoint(df, eager: bool = True):
    """Cut lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
