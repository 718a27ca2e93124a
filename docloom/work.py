"""Folders for intermediate tables, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder for one run's intermediate tables, in ``spark.checkpoint.dir``; with its file system, as Spark takes it on the driver.

    Tasks that write files themselves have a working folder of their own and know no default file system, so a
    bare or relative path would be another folder to each. Where the setting is unset (a running session can't
    be given it), the context's own checkpoint folder counts; without one, a local session gets a temporary
    folder, and any other is refused.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        root = context.getCheckpointDir()
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it back, so it is made once and lineage ends."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, path: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """``stored``, with aggregates of the rows that were written, taken as they pass."""
    seen = Observation()
    return stored(df.observe(seen, *metrics), path), seen.get
