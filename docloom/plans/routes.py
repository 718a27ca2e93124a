"""The ways files come in, each from its source to its answer: uploads, local files, batches and folders.

Each route reads its files once to judge them (validity and batch detection, by
the reader that the settings name), ingests them, and answers with a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.functions.text import basename
from docloom.operators import batch as detection
from docloom.operators.stats import batch_summary, directory_answer, directory_results
from docloom.operators.validity import too_large, valid_layout, valid_light
from docloom.plans.ingest import ingest
from docloom.schemas import RESPONSE
from docloom.sources.files import scan_directory, scan_file, uploads
from docloom.sources.pdf import Reader, read_blocks, reader_of
from docloom.work import work_dir


def judged(files: DataFrame, settings: Settings, work: str, reader: Reader | None = None) -> DataFrame:
    """(path, valid, is_batch) of files that aren't too large; files that can't be read are missing.

    Of what was read, page numbers and the first pages' blocks are stored below ``work``.
    """
    spark = files.sparkSession
    blocks = read_blocks(files.where(~too_large(F.col("length"), settings.max_file_size) & F.col("content").isNotNull()), reader or reader_of(settings)).where("error IS NULL")
    first = F.col("page_no") < detection.LOOKED_AT
    blocks.select("path", "page_no", "block_no", *(F.when(first, F.col(c)).alias(c) for c in ("text", "html"))).write.parquet(f"{work}/pages")
    seen = spark.read.parquet(f"{work}/pages")
    if settings.reader == "light":
        pages = detection.page_texts(seen)
        valid, several = valid_light(pages), detection.is_batch(pages, keywords=settings.keywords, threshold=settings.similarity_threshold)
    else:
        valid, several = valid_layout(seen), detection.is_batch_layout(seen, keywords=settings.keywords, threshold=settings.similarity_threshold)
    return valid.join(several.select("path", "is_batch"), "path", "left")


def take_in(files: DataFrame, settings: Settings, reader: Reader | None = None, batch: bool = False) -> DataFrame:
    """The responses of ``files``, judged and ingested."""
    spark = files.sparkSession
    work = work_dir(spark)
    return ingest(spark, files, judged(files, settings, work, reader), settings, work, batch)


def _single(answers: DataFrame, message: str, **more: str) -> DataFrame:
    return answers.select(F.lit(True).alias("success"), F.struct(*RESPONSE.names).alias("document"), F.lit(message).alias("message"), *(F.lit(v).alias(k) for k, v in more.items()))


def ingest_upload(spark: SparkSession, name: str, content: bytes, type_: str, settings: Settings, metadata: str | None = None, reader: Reader | None = None) -> DataFrame:
    """One uploaded file: success, document, message and source."""
    return _single(take_in(uploads(spark, [(name, content)], type_, metadata), settings, reader), "Document ingested successfully", source="upload")


def ingest_local(spark: SparkSession, path: str, type_: str, settings: Settings, metadata: str | None = None, reader: Reader | None = None) -> DataFrame:
    """One file by its path: success, document, message, source and file_path."""
    return _single(take_in(scan_file(spark, path, type_, metadata, most=settings.max_file_size), settings, reader), "Local document ingested successfully", source="local_file", file_path=path)


def ingest_upload_batch(spark: SparkSession, name: str, content: bytes, type_: str, settings: Settings, metadata: str | None = None, reader: Reader | None = None) -> DataFrame:
    """One uploaded file of several documents, kept as one: its counts and documents."""
    return _counted(take_in(uploads(spark, [(name, content)], type_, metadata), settings, reader, batch=True))


def ingest_local_batch(spark: SparkSession, path: str, type_: str, settings: Settings, metadata: str | None = None, reader: Reader | None = None) -> DataFrame:
    """One file of several documents by its path: its counts and documents."""
    return _counted(take_in(scan_file(spark, path, type_, metadata, batch=True, most=settings.max_file_size), settings, reader, batch=True))


def _counted(answers: DataFrame) -> DataFrame:
    return batch_summary(answers, collect=True)


def ingest_directory(spark: SparkSession, path: str, type_: str, settings: Settings, recursive: bool = False, reader: Reader | None = None) -> tuple[DataFrame, DataFrame]:
    """A folder's files: the answer as one row, and the result of each file as rows (file, success, response, error)."""
    answers = take_in(scan_directory(spark, path, type_, recursive, most=settings.max_file_size), settings, reader)
    results = directory_results(answers)
    return directory_answer(results, path), results


def extract_inputs(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, name, content, error) of the PDF files of a folder, or of one file."""
    own = scan_file(spark, path, "publication") if path.lower().endswith(".pdf") else scan_directory(spark, path, "publication", recursive)
    return own.select("path", basename(F.col("path")).alias("name"), "content", "error")
