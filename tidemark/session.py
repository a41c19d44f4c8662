"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job needs for right results, not for speed.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# AQE coalesces small shuffles and splits hot partitions of joins at run time.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter sets resources."""
    builder = SparkSession.builder.appName("tidemark")
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        builder = builder.config("spark.ui.showConsoleProgress", "false")
    for key, value in {**REQUIRED_CONF, **ADAPTIVE_CONF}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder comes from ``spark.checkpoint.dir`` so that it is shared by all
    executors and survives their loss.  A folder of our own is set only where
    the session names none (local tests).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables a job writes between its steps.

    It lies under ``spark.checkpoint.dir`` (shared, survives executors); only a
    local session without that setting gets a folder on this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
