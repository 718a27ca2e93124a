"""Page headers: header blocks, or else paragraphs in capitals; and a document's text under its headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import SENTINEL, is_upper, paragraphs, strip, strip_html

LONGER_THAN = 5


def capital_paragraphs(html: Column) -> Column:
    """Stripped plain paragraphs of more than five characters, all in capitals."""
    found = F.transform(paragraphs(html), strip)
    return F.filter(found, lambda p: (F.length(p) > LONGER_THAN) & is_upper(p))


def page_headers(blocks: DataFrame, pages_html: DataFrame, key: str = "path") -> DataFrame:
    """(key, page_no, headers) of pages that have any.

    ``blocks`` has (key, page_no, block_no, block_type, html), ``pages_html``
    (key, page_no, html). Header blocks come in order; only a page without any
    falls back on its paragraphs in capitals.
    """
    text = strip_html(F.col("html"))
    own = blocks.where(F.col("block_type") == "PageHeader").withColumn("header", text).where((F.col("header") != "") & (F.col("header") != SENTINEL))
    first = own.groupBy(key, "page_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "header"))), lambda b: b["header"]).alias("own"))
    spare = pages_html.select(key, "page_no", capital_paragraphs(F.col("html")).alias("spare"))
    return spare.join(first, [key, "page_no"], "full_outer").select(key, "page_no", F.coalesce("own", "spare").alias("headers")).where(F.size("headers") > 0)


def header_text(headers: DataFrame, key: str = "path") -> DataFrame:
    """(key, header_text): the headers of all pages in order; pages are numbered from 1 there."""
    page = F.concat(F.lit("\n--- Page "), (F.col("page_no") + 1).cast("string"), F.lit(" Header ---\n"), F.array_join("headers", "\n"), F.lit("\n---\n\n"))
    parts = F.sort_array(F.collect_list(F.struct("page_no", page.alias("text"))))
    return headers.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("header_text"))


def with_headers(headers: Column, text: Column) -> Column:
    """A text under its headers."""
    return F.when(F.coalesce(headers, F.lit("")) != "", F.concat(headers, F.lit("\n\n"), text)).otherwise(text)
