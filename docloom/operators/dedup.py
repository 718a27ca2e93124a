"""Exact duplicates by content hash: within a run, against the catalog, and storage that no row points to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, order: str = "path", key: str = "hash", **firsts: Column) -> DataFrame:
    """``rows`` with ``is_first`` and ``first`` (the value of ``order`` that comes first among rows of equal ``key``).

    ``firsts`` are further columns, each with its value in the first row. The
    first is an aggregate that is combined before anything moves, and rows meet it
    by a join, so a key with very many rows is no single task's.
    """
    least = rows.groupBy(key).agg(F.min(order).alias("first"), *(F.min_by(c, order).alias(name) for name, c in firsts.items()))
    return rows.join(least, key, "left").withColumn("is_first", F.col(order).eqNullSafe(F.col("first")))


def against_catalog(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """``rows`` with ``known``, the catalog's row of the same hash, or null; types don't matter.

    Of rows that repeat a hash (there should be none) the first by id and storage path
    is known, so a row never comes out twice.
    """
    own = F.struct("id", "original_filename", "storage_path", "type", "status")
    return rows.join(catalog.groupBy("hash").agg(F.min_by(own, F.struct("id", "storage_path")).alias("known")), "hash", "left")


def unknown_only(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    return rows.join(catalog.select("hash"), "hash", "left_anti")


def orphans(storage: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stored files that no catalog row points to."""
    return storage.join(catalog.select(F.col("storage_path").alias("path")), "path", "left_anti")


def repeated_hashes(catalog: DataFrame) -> DataFrame:
    """Hashes that a catalog holds more than once; there should be none."""
    return catalog.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def latest_status(log: DataFrame, tie: str = "ts") -> DataFrame:
    """(id, status): the status of each id's latest row; ``tie`` orders rows of one time."""
    return log.groupBy("id").agg(F.max_by("status", F.struct("ts", tie) if tie != "ts" else F.col("ts")).alias("status"))

