"""Files of several documents: key words on the first pages, or first pages that differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import BATCH_KEYWORDS, SIMILARITY_THRESHOLD
from docloom.functions.text import FIRST_CHARACTERS, block_text, contains_any, is_different

LOOKED_AT = 3


def page_texts(blocks: DataFrame, key: str = "path") -> DataFrame:
    """(key, page_no, text): the texts of a page's blocks, in order, joined by blanks."""
    found = F.sort_array(F.collect_list(F.when(F.col("block_text").isNotNull(), F.struct("block_no", "block_text"))))
    texts = blocks.withColumn("block_text", block_text(F.col("text"), F.col("html")))
    return texts.groupBy(key, "page_no").agg(F.array_join(F.transform(found, lambda b: b["block_text"]), " ").alias("text"))


def is_batch(pages: DataFrame, key: str = "path", keywords: tuple[str, ...] = BATCH_KEYWORDS, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """(key, pages, is_batch) from (key, page_no, text).

    A single page never is a batch; a key word on one of the first three pages
    is; else three pages or more are if the first two differ. Only the first
    pages' texts are looked at, and only 200 characters of two are moved.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    head = lambda n: F.max(F.when(F.col("page_no") == n, F.substring(text, 1, FIRST_CHARACTERS)))
    found = pages.groupBy(key).agg(
        F.count("page_no").alias("pages"),
        F.coalesce(F.bool_or((F.col("page_no") < LOOKED_AT) & contains_any(text, keywords)), F.lit(False)).alias("keyword"),
        head(0).alias("page0"),
        head(1).alias("page1"),
    )
    verdict = F.when(F.col("pages") <= 1, False).when(F.col("keyword"), True).when(F.col("pages") > 2, is_different(F.col("page0"), F.col("page1"), threshold)).otherwise(False)
    return found.select(key, "pages", verdict.alias("is_batch"))


def is_batch_layout(blocks: DataFrame, key: str = "path", keywords: tuple[str, ...] = BATCH_KEYWORDS, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """As ``is_batch``, from blocks: a key word has to stand in the ``text`` of one block; markup counts for the comparison only."""
    texts = page_texts(blocks.where("page_no < 2"), key)
    counts = blocks.groupBy(key).agg(
        F.countDistinct("page_no").alias("pages"),
        F.coalesce(F.bool_or((F.col("page_no") < LOOKED_AT) & contains_any(F.coalesce(F.col("text"), F.lit("")), keywords)), F.lit(False)).alias("keyword"),
    )
    heads = texts.groupBy(key).agg(
        *(F.max(F.when(F.col("page_no") == n, F.substring("text", 1, FIRST_CHARACTERS))).alias(f"page{n}") for n in (0, 1))
    )
    verdict = F.when(F.col("pages") <= 1, False).when(F.col("keyword"), True).when(F.col("pages") > 2, is_different(F.col("page0"), F.col("page1"), threshold)).otherwise(False)
    return counts.join(heads, key, "left").select(key, "pages", verdict.alias("is_batch"))
