"""Counts of responses, storage and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import megabytes
from docloom.schemas import FAILED, INGESTED, RESPONSE


def _count_if(condition):
    return F.count_if(condition).cast("long")


def batch_summary(responses: DataFrame, collect: bool = False) -> DataFrame:
    """total_processed, successful (duplicates of ingested documents too), failed, duplicates; ``collect`` adds the responses and error messages of one request."""
    more = []
    if collect:
        more = [
            F.array_sort(F.collect_list(F.struct("original_filename", "document_id", "storage_path", "type", "status", "message", "is_duplicate"))).alias("documents"),
            F.array_sort(F.collect_list(F.when(F.col("status") == FAILED, F.col("message")))).alias("errors"),
        ]
    return responses.agg(
        F.count(F.lit(1)).alias("total_processed"),
        _count_if(F.col("status") == INGESTED).alias("successful"),
        _count_if(F.col("status") == FAILED).alias("failed"),
        _count_if(F.col("is_duplicate")).alias("duplicates"),
        *more,
    )


def directory_results(answers: DataFrame) -> DataFrame:
    """(file, success, response, error): what came of each file; ``answers`` has a response's columns, ``path``, and ``error`` where an exception ended it."""
    failed = F.col("error").isNotNull()
    return answers.select(F.col("path").alias("file"), (~failed).alias("success"), F.when(~failed, F.struct(*RESPONSE.names)).alias("response"), "error")


def directory_answer(results: DataFrame, directory: str) -> DataFrame:
    """One row: message, directory, total_files, successful and failed; without files instead of the counts ``files_processed``, 0."""
    n, any_ = F.count(F.lit(1)), F.count(F.lit(1)) > 0
    return results.agg(
        F.when(any_, "Directory processing complete").otherwise("No PDF files found in directory").alias("message"),
        F.lit(directory).alias("directory"),
        F.when(any_, n).alias("total_files"),
        F.when(any_, _count_if(F.col("success"))).alias("successful"),
        F.when(any_, _count_if(~F.col("success"))).alias("failed"),
        F.when(~any_, F.lit(0).cast("long")).alias("files_processed"),
    )


def directory_summary(results: DataFrame) -> DataFrame:
    """total_files, successful and failed as to exceptions (``error``), and the same as to status."""
    return results.agg(
        F.count(F.lit(1)).alias("total_files"),
        _count_if(F.col("error").isNull()).alias("successful"),
        _count_if(F.col("error").isNotNull()).alias("failed"),
        _count_if(F.col("status") == INGESTED).alias("ingested"),
        _count_if(F.col("status") == FAILED).alias("processing_failed"),
    )


def storage_stats(files: DataFrame) -> DataFrame:
    """total_files, total_size_bytes and total_size_mb of (path, length)."""
    size = F.coalesce(F.sum("length"), F.lit(0)).cast("long")
    return files.agg(F.count(F.lit(1)).alias("total_files"), size.alias("total_size_bytes")).withColumn("total_size_mb", megabytes(F.col("total_size_bytes")))


def service_stats(files: DataFrame, max_file_size: int, retry_attempts: int) -> DataFrame:
    own = storage_stats(files)
    return own.select(
        F.struct(*own.columns).alias("storage"), F.lit(max_file_size).cast("long").alias("limit")
    ).selectExpr("storage", "limit div 1048576 AS max_file_size_mb", f"{int(retry_attempts)} AS retry_attempts")


def counts_by_folder(files: DataFrame, folders: DataFrame, folder: str = "folder") -> DataFrame:
    """Every folder with its number of files, 0 if none; ``exists`` says whether any was seen."""
    counts = files.groupBy(folder).agg(F.count(F.lit(1)).alias("n"))
    return folders.join(counts, folder, "left").select(*folders.columns, F.col("n").isNotNull().alias("exists"), F.coalesce("n", F.lit(0)).cast("long").alias("pdf_count"))


def preview(files: DataFrame, key: str, name: str, n: int = 3) -> DataFrame:
    """(key, preview, total): the first names of each group, and dots if there are more.

    Names are ranked and cut before they are gathered, so a large group isn't collected.
    """
    from pyspark.sql import Window

    total = files.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    first = files.withColumn("__at", F.row_number().over(Window.partitionBy(key).orderBy(name))).where(F.col("__at") <= n)
    names = first.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(name)), ", ").alias("names"))
    return total.join(names, key).select(key, F.concat("names", F.when(F.col("total") > n, "...").otherwise("")).alias("preview"), "total")


def extract_metrics() -> list[Column]:
    """successful, failed, total_time and start_time as aggregates of (error, elapsed, started)."""
    return [
        _count_if(F.col("error").isNull()).alias("successful"),
        _count_if(F.col("error").isNotNull()).alias("failed"),
        F.coalesce(F.sum("elapsed"), F.lit(0.0)).alias("total_time"),
        F.min("started").alias("start_time"),
    ]


def extract_stats(results: DataFrame) -> DataFrame:
    """successful, failed, total_time and start_time of (error, elapsed, started)."""
    return results.agg(*extract_metrics())
