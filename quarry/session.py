"""Session settings that the operators assume, and a folder for what queries write."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Times are UTC; adaptive execution re-plans joins and small partitions."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; the machine's
    temporary folder only in a local session without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "quarry-checkpoints")
    return f"{base.rstrip('/')}/written-{uuid.uuid4().hex}"
