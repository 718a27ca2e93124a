"""Extraction: blocks to one markdown text and one metadata record per file, and the sinks for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.functions.metadata import merged
from docloom.functions.text import stem
from docloom.operators.batch import page_texts
from docloom.operators.headers import header_text, page_headers, with_headers
from docloom.operators.stats import extract_metrics
from docloom.plans.storage import written
from docloom.sources.markdown import render_pages
from docloom.sources.pdf import Reader, read_blocks, reader_of
from docloom.sources.systems import refuse_unshared
from docloom.work import measured, stored, work_dir


def extracted(blocks: DataFrame, settings: Settings, processor: str = "layout") -> DataFrame:
    """(path, text, metadata, error, started, elapsed) of stored blocks with their errors.

    The text is the pages as paginated markdown under the page headers. The
    metadata is what the reader told, and what is known of the run, which wins. A
    file that couldn't be read has its error, no text, and ``{}`` for metadata.
    ``blocks`` is used several times: store it first, as ``extract`` does.
    """
    good = blocks.where(F.col("error").isNull() & F.col("page_no").isNotNull())
    markdown = render_pages(page_texts(good), "path")
    html = good.groupBy("path", "page_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "html"))), lambda b: b["html"]), "").alias("html"))
    headers = header_text(page_headers(good, html))
    own = [c for c in ("metadata", "started", "elapsed") if c in blocks.columns]
    told = {c: F.max(c) if c in own else F.lit(None).cast(kind) for c, kind in (("metadata", "string"), ("started", "double"), ("elapsed", "double"))}
    files = blocks.groupBy("path").agg(F.max("error").alias("error"), F.countDistinct("page_no").alias("pages"), *(c.alias(name) for name, c in told.items()))
    facts = F.struct(
        F.col("pages"), F.lit(processor).alias("processor"), F.lit(settings.use_llm).alias("use_llm"), F.lit(settings.extract_images).alias("extract_images"),
        (F.unix_micros(F.current_timestamp()) / 1e6).alias("processing_timestamp"),
    )
    done = F.col("error").isNull()
    text = with_headers(F.col("header_text"), F.coalesce("markdown", F.lit("")))
    return files.join(markdown, "path", "left").join(headers, "path", "left").select(
        "path", F.when(done, text).alias("text"), F.when(done, merged(F.col("metadata"), F.to_json(facts), pretty=True)).otherwise("{}").alias("metadata"), "error", "started", "elapsed"
    )


def extract(files: DataFrame, settings: Settings, work: str, reader: Reader | None = None) -> tuple[DataFrame, dict]:
    """``extracted`` of (path, content), and the run's statistics: files are read once, and what was read and made of it is stored below ``work``.

    The statistics (see ``stats.extract_stats``) are taken as the results pass, without another scan.
    """
    blocks = stored(read_blocks(files, reader or reader_of(settings)), f"{work}/blocks")
    return measured(extracted(blocks, settings, settings.reader), f"{work}/extracts", *extract_metrics())


def write_extracts(extracts: DataFrame, path: str) -> DataFrame:
    """Write ``{stem}.md`` and ``{stem}.json`` of each file, by one sink for both; return (path, storage_path, error)."""
    names = F.explode(F.array(F.struct(F.lit(".md").alias("end"), F.col("text").alias("body")), F.struct(F.lit(".json").alias("end"), F.col("metadata").alias("body"))))
    spark = extracts.sparkSession
    refuse_unshared(spark, path)
    out = extracts.where(F.col("text").isNotNull()).select("path", names.alias("file")).withColumn("storage_path", F.concat(F.lit(f"{path}/"), stem(F.col("path")), "file.end"))
    done = stored(written(out.select("storage_path", F.col("file.body").cast("binary").alias("content"))), f"{work_dir(spark)}/written")
    return out.select("path", "storage_path").join(done, "storage_path").select("path", "storage_path", "error")
