"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to a Python task; whole texts are kept, so the bound is on rows.
ARROW_ROWS = 1000
#: Low bits of a row's number that hold its place in its file.
ROW_BITS = 40


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings that the Arrow operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Where that is
    unset, a local session (as in tests) gets a temporary folder, and any other is
    refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/docloom/{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, *, by: str | None = None, drop: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and no stage runs twice.

    ``by`` is a column to partition the table by. ``drop`` is an earlier staged
    table that nothing needs any more; its files go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    for old in {f.rpartition("/")[0] for f in drop.inputFiles()} if drop is not None else ():
        folder = spark._jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    back = spark.read.schema(df.schema).parquet(path)
    return back.select(df.columns) if by else back


def numbered(docs: DataFrame, name: str = "rid") -> DataFrame:
    """``docs``, a stored Parquet table (columns may be chosen), with a number of each row: the place of its file by path, and its place there.

    Unlike ``monotonically_increasing_id`` the numbers don't depend on how a job
    splits the files, so separate jobs and plans give a row the same one.
    """
    files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    order = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), "__file string, __place long")
    placed = docs.select(*docs.columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")).join(F.broadcast(order), "__file")
    return placed.select(*docs.columns, (F.shiftleft("__place", ROW_BITS) + F.col("__row")).alias(name))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
