"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """On a cluster leave master and shuffle_partitions to its own configuration."""
    b = SparkSession.builder.appName("gablestone").config(map=SETTINGS | more)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """df computed once and cut off from what made it, in the cluster's checkpoint folder.

    A local folder is set only where the session names none, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="gablestone-")
        sc.setCheckpointDir(named)
    return df.checkpoint()
