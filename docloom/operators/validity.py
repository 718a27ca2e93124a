"""Which files are taken in: extension, size, and whether their pages make a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import strip

LEAST_CHARACTERS = 10


def too_large(length: Column, most: int) -> Column:
    """Files of exactly the maximum pass."""
    return length > most


def size_message(length: Column, most: int) -> Column:
    return F.concat(F.lit("File size "), length.cast("string"), F.lit(f" bytes exceeds maximum {most} bytes"))


def page_counts(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, pages): page_no of null are rows of files without pages."""
    return pages.groupBy(key).agg(F.countDistinct("page_no").alias("pages"))


def valid_light(pages: DataFrame, key: str = "path", least: int = LEAST_CHARACTERS) -> DataFrame:
    """(key, valid): at least one page, and ``least`` characters besides white space about them on page 0."""
    first = F.max(F.when(F.col("page_no") == 0, F.length(strip(F.coalesce(F.col("text"), F.lit(""))))))
    return pages.groupBy(key).agg(F.coalesce((F.count("page_no") > 0) & (first >= least), F.lit(False)).alias("valid"))


def valid_layout(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, valid): at least one page."""
    return pages.groupBy(key).agg((F.count("page_no") > 0).alias("valid"))
