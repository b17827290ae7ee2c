"""Session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where it is unset and the session runs on one machine (tests, bench) one is made; a cluster without it is refused, for a
    machine's own folder is not shared.
    """
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; name a folder that all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="ledgerweave-")
        spark.conf.set("spark.checkpoint.dir", have)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(have)
    return have


def local_session(cores: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """The session of tests and benchmarks on one machine."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName("ledgerweave")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
