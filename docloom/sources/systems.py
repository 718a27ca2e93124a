"""File systems by path, on the driver and in tasks alike: local paths, ``file:`` and the URIs that pyarrow knows."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import SparkSession


def system_of(path: str) -> tuple[Any, str, str]:
    """(file system, path in it, what such paths begin with as URIs). Raises ``ValueError`` for what pyarrow doesn't know."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
        return system, inner, path[: path.index(inner)] if inner in path else ""
    inner = "/" + path[5:].lstrip("/") if path.startswith("file:") else os.path.abspath(path)
    return fs.LocalFileSystem(), inner, "file:"


def is_known(path: str) -> bool:
    try:
        system_of(path)
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


def is_local(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


def refuse_unshared(spark: SparkSession, path: str, mounted: bool = False) -> None:
    """Refuse a local path on a cluster, where each executor would write to a disk of its own, unless it is a mount that all share."""
    if is_local(path) and not mounted and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{path} is local to each executor: give a URI of a shared file system, or declare the folder a shared mount")
