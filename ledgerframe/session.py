"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that change results (not just speed) are pinned here so that the
# library, the tests and the benchmark agree with the DuckDB oracle.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "ledgerframe") -> SparkSession:
    """Session for tests and the benchmark. On a cluster, use the cluster's own
    session and call :func:`prepare` on it instead."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEDGERFRAME_DRIVER_MEMORY", "8g"))
    )
    for key, value in RESULT_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply result-relevant settings to an existing session (idempotent)."""
    for key, value in RESULT_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    On a cluster this is whatever the cluster names in ``spark.checkpoint.dir``
    (a shared file system). Only when nothing is configured, as in local tests,
    a fresh scratch folder is created and registered.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerframe-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, the same for every application (Spark's
    own checkpoint folder below it is one per application); see :func:`checkpoint_dir`."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (named or checkpoint_dir(spark)).rstrip("/")
