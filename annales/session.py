"""Session settings shared by tests, bench and scripts."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-JVM session for tests and bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("annales")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ANNALES_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Without one a single-machine session gets a folder of its own; a cluster must name one."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError(f"{CHECKPOINT_KEY} names no folder: on a cluster it must be one that all executors share")
    where = named or "file://" + tempfile.mkdtemp(prefix="annales-checkpoint-")
    spark.sparkContext.setCheckpointDir(where)
    return spark.sparkContext.getCheckpointDir() or where
