"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session without the setting gets a temporary folder; on a cluster
    that would be another disk on every machine, so there the setting is demanded."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    set_before = context._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    path = "file://" + tempfile.mkdtemp(prefix="lodestar-")
    context.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends here and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that ``stored`` has made in the shared folder; results that still read them must have been taken."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodestar")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
