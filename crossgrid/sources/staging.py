"""Tables between the passes of one computation, in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def for_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, also where the driver's path was changed after the session had begun; for the few places that need one."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="crossgrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(rows: DataFrame) -> DataFrame:
    """The rows, written once as Parquet and read back: what made them runs once, and a lost executor loses nothing."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
