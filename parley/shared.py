"""The folder that driver and executors share, and frames made there once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local master gets a temporary folder of its own; a cluster
    without the setting is refused, since a machine-local folder would lose data there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="parley-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def made(df: DataFrame) -> DataFrame:
    """df by way of a table in the shared folder: it takes less room than a checkpoint, and later steps read only the columns they need."""
    at = f"{shared_dir(df.sparkSession)}/made-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
