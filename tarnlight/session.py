"""Session settings that every plan in this package assumes."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SHARED_SETTING = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", app: str = "tarnlight", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench: UTC, adaptive plans, a partition count sized to the machine.

    On a cluster the deployment's own session is used instead; nothing in the package
    depends on the values here except the UTC time zone.
    """
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which the driver and all executors share; on a single machine one is set where none is."""
    folder = spark.conf.get(SHARED_SETTING, "")
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"{SHARED_SETTING} must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tarnlight-")
        spark.conf.set(SHARED_SETTING, folder)
    return folder.rstrip("/")
