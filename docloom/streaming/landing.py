"""A landing folder as a stream: each micro-batch of new files goes through the ingestion plan.

Duplicates are found against the catalog, so the stream keeps no state that
grows with what it has seen. What a batch decides is stored under its number before anything is
catalogued, so a batch that was killed and runs again finishes what it began and gives the same answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.config import Settings
from docloom.functions.text import basename, is_pdf
from docloom.plans.claims import folder_of
from docloom.plans.ingest import ingest
from docloom.sources.files import PDF_GLOB, as_files
from docloom.sources.listing import list_folder, with_contents_of
from docloom.work import stored

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def landing_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as they land, as a stream (path, length); contents are not read."""
    return spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", PDF_GLOB).load(path).select("path", "length")


def _passed_over(spark: SparkSession, path: str, work: str) -> DataFrame:
    """(path, length) of files that Spark's source never shows, empty or hidden ones, and that are not answered yet."""
    name = basename(F.col("path"))
    found = list_folder(spark, path).where(is_pdf(name) & ((F.col("length") == 0) | name.startswith(".") | name.startswith("_"))).select("path", "length")
    answered = [f"{work}/{n}/files" for n in folder_of(spark, work).names(work) if n.startswith("passed=")]
    return found.join(spark.read.schema(found.schema).parquet(*answered), ["path", "length"], "left_anti") if answered else found


def ingest_landing(
    spark: SparkSession, path: str, type_: str, settings: Settings, work: str, validity: Callable[[DataFrame], DataFrame], on_responses: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Ingest what has landed and stop (start again for more); ``validity`` gives (path, valid), and maybe is_batch, of a batch of files.

    ``on_responses`` gets each batch's answers and number. Files that Spark's source passes over
    come first, in batches of negative numbers. It is called again for a batch that was killed, with the same answers.
    """

    def take(own: SparkSession, listed: DataFrame, at: str, number: int) -> None:
        rows = listed.select(F.lit(path).alias("root"), "path", "length", F.lit(None).cast("string").alias("error"))
        files = as_files(with_contents_of(own, rows, settings.max_file_size), type_, None, source_path=F.col("path"), source_type=F.lit("landing"), directory=F.lit(path))
        found = ingest(own, files, validity(files.where("content IS NOT NULL")), settings, at, resume=True)
        if on_responses:
            on_responses(found, number)

    def one(listed: DataFrame, batch: int) -> None:
        take(listed.sparkSession, listed, f"{work}/batch={batch}", batch)

    folder = folder_of(spark, work)
    passed = len([n for n in folder.names(work) if n.startswith("passed=")])
    if passed and "_ANSWERED" not in folder.names(f"{work}/passed={passed - 1}"):
        passed -= 1  # its answers were not given
        rest = spark.read.parquet(f"{work}/passed={passed}/files")
    else:
        rest = stored(_passed_over(spark, path, work), f"{work}/passed={passed}/files")
    if not rest.isEmpty():
        take(spark, rest, f"{work}/passed={passed}", -1 - passed)
    folder.put_if_absent(f"{work}/passed={passed}/_ANSWERED", "")
    writer = landing_files(spark, path).writeStream.foreachBatch(one).option("checkpointLocation", f"{work}/checkpoint")
    return writer.trigger(availableNow=True).start()
