"""Session settings and the shared folder used for files that outlive a task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE settings the plans rely on: joins switch to broadcast on the measured size of a side, and a hot key's partition is
# split even when the split costs a further shuffle for a later aggregate on the same key.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Parquet files grow about fourfold in memory; without this a side is broadcast by its compressed size.
    "spark.sql.sources.fileCompressionFactor": "4.0",
}


def tune(spark: SparkSession) -> SparkSession:
    """Turn on the adaptive settings in a running session."""
    for name, value in ADAPTIVE.items():
        spark.conf.set(name, value)
    return spark


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "ovenplan") -> SparkSession:
    """A session for tests and benchmarks; on a cluster, pass the cluster's own session to the operators."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "America/Chicago")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in ADAPTIVE.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, as every task then sees this machine's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="ovenplan-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
