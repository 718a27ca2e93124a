"""File sources: folders, single files, uploads, and listings without contents.

Folders are listed and files read by tasks (``listing``), so a folder of any size is taken in
parallel. Every file counts: an empty or hidden one is a row, and one that can't be
read is a row with its ``error``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.metadata import with_values
from docloom.functions.text import basename, is_pdf
from docloom.schemas import FILES, TYPES
from docloom.sources.listing import LISTED, MOST_READABLE, list_folder, list_folders, with_contents_of
from docloom.sources.systems import is_local

PDF_GLOB = "*.[pP][dD][fF]"
#: Characters of a name that are kept in the store.
MOST_STORED = 100


class SourceError(ValueError):
    """A source that can't be read as asked."""


def _check_type(type_: str) -> None:
    if type_ not in TYPES:
        raise SourceError(f"type must be one of {', '.join(TYPES)}: {type_}")


def _status(spark: SparkSession, path: str):
    """The path's status by its own file system; None if it is missing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(at) if fs.exists(at) else None


def as_files(df: DataFrame, type_: str, metadata: str | None, **more: Column) -> DataFrame:
    """(path, length, content, error) as ``FILES``, with an ``error``."""
    out = df.select("path", basename(F.col("path")).alias("name"), "length", "content", F.lit(type_).alias("type"), F.lit(metadata).alias("metadata"), "error")
    return out.withColumn("metadata", with_values(F.col("metadata"), **more)) if more else out


def scan_directory(spark: SparkSession, path: str, type_: str, recursive: bool = False, metadata: str | None = None, most: int = MOST_READABLE) -> DataFrame:
    """PDF files of a folder (``FILES`` and ``error``), with where they come from in their metadata; files longer than ``most`` are not read.

    A missing path and one that is no folder are errors; a folder without PDF
    files gives no rows, and one that can't be listed a row with its error.
    """
    _check_type(type_)
    status = _status(spark, path)
    if status is None:
        raise SourceError(f"Directory not found: {path}")
    if not status.isDirectory():
        raise SourceError(f"Path is not a directory: {path}")
    found = list_folder(spark, path, recursive, failures=True).where(is_pdf(F.col("path")) | (F.col("path") == F.col("folder" if recursive else "root")))
    return as_files(with_contents_of(spark, found, most), type_, metadata, source_path=F.col("path"), source_type=F.lit("directory_scan"), directory=F.lit(path))


def scan_file(spark: SparkSession, path: str, type_: str, metadata: str | None = None, batch: bool = False, most: int = MOST_READABLE) -> DataFrame:
    """One PDF file (``FILES`` and ``error``); a missing file and other extensions are errors."""
    _check_type(type_)
    status = _status(spark, path)
    if status is None or status.isDirectory():
        raise SourceError(f"File not found: {path}")
    if not path.lower().endswith(".pdf"):
        raise SourceError("Only PDF files are supported")
    kind = "local_batch_file" if batch else "local_file"
    at = status.getPath().toString() if is_local(path) else path
    one = spark.createDataFrame([(at, at.rpartition("/")[0], at, status.getLen(), False, None)], LISTED).drop("is_folder")
    return as_files(with_contents_of(spark, one, most), type_, metadata, source_path=F.lit(path), source_type=F.lit(kind))


def uploads(spark: SparkSession, files: Sequence[tuple[str, bytes]], type_: str, metadata: str | None = None) -> DataFrame:
    """Contents that a client sent, with their names (``FILES``); each needs a name that ends in ``.pdf``. Paths are by position, so files of one name stay apart."""
    _check_type(type_)
    for name, _ in files:
        if not name or not name.lower().endswith(".pdf"):
            raise SourceError("Only PDF files are supported")
    rows = [(f"upload:{n:09d}", name, len(content), bytearray(content), type_, metadata) for n, (name, content) in enumerate(files)]
    return spark.createDataFrame(rows, FILES)


def scan_storage(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every file below a folder, empty and hidden ones too; contents are not read. What can't be listed is an ``OSError``, never a row less."""
    return list_folder(spark, path, recursive=True).select("path", "length")


def pdf_listing(spark: SparkSession, folders: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(root, name, path, exists, pdf_count, error) of (root, name, path) folders, not looking below them: one listing for all. One that can't be listed has its error and no count, and doesn't ``exists``."""
    rows = [(root, name, path, (s := _status(spark, path)) is not None and s.isDirectory()) for root, name, path in folders]
    places = spark.createDataFrame(rows, "root string, name string, path string, exists boolean")
    there = sorted({r[2] for r in rows if r[3]})
    if not there:
        return places.withColumns({"pdf_count": F.lit(0).cast("long"), "error": F.lit(None).cast("string")})
    own = F.col("path") == F.col("root")
    found = list_folders(spark, there, failures=True).groupBy(F.col("root").alias("path")).agg(F.count_if(is_pdf(F.col("path")) & ~own).alias("n"), F.min(F.when(own, F.col("error"))).alias("error"))
    count = F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0).cast("long")))
    return places.join(found, "path", "left").select("root", "name", "path", (F.col("exists") & F.col("error").isNull()).alias("exists"), count.alias("pdf_count"), "error")


def only_pdf(files: DataFrame) -> DataFrame:
    return files.where(is_pdf(F.col("name")))


def safe_name(name: Column) -> Column:
    """A name that is one part of a path and nothing else: what stands after the last slash or backslash, without control characters, and its end if it is long."""
    last = F.regexp_replace(F.regexp_replace(name, r"(?s)^.*[/\\\\]", ""), r"[\x00-\x1f\x7f]", "_")
    plain = F.when(last.isin("", ".", "..") | last.isNull(), "file").otherwise(last)
    return F.when(F.length(plain) > MOST_STORED, F.substring(plain, -MOST_STORED, MOST_STORED)).otherwise(plain)
