"""Ingestion of a set of files: one plan where a service would take one file after the other.

The order of the checks is size, validity, (batch, for information), content
hash, and duplicates, first against the catalog and then within the run, where
the first path wins. Files that fail a check are never stored, never catalogued
and take no part in finding duplicates.

Files that look like several documents in one are noted and taken in as one.

Identifiers of ingested documents are derived from their content's hash, so they
are the same however often a task runs; failures have none.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.functions.metadata import metadata_error, parsed
from docloom.functions.text import normalised_uuid
from docloom.operators.dedup import against_catalog, first_wins
from docloom.operators.validity import size_message, too_large
from docloom.plans.catalog import Catalog, shard_of
from docloom.plans.claims import folder_of
from docloom.plans.storage import FileStore, PackStore
from docloom.schemas import FAILED, INGESTED, MOST_CHARACTERS, RESPONSE
from docloom.work import measured, stored

#: The answers' texts.
INVALID = "Invalid or corrupted PDF file"
INGESTED_MESSAGE, KNOWN_MESSAGE = "Document successfully ingested", "Document already exists"
TOO_LONG = f"the file name has more than {MOST_CHARACTERS['original_filename']} characters"
#: So many new files (their paths) are sent to all tasks that read contents; beyond that, contents are shuffled.
MOST_BROADCAST = 100_000
SINGLE, BATCH = "Processing failed: ", "Batch processing failed: "

log = logging.getLogger(__name__)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def document_id(hash_: Column) -> Column:
    return normalised_uuid(F.substring(hash_, 1, 32))


def checked(files: DataFrame, validity: DataFrame, max_file_size: int, prefix: str = SINGLE) -> DataFrame:
    """``files`` with ``failure``, the message of the first check that fails, or null, and ``error``, what reading it ended with, or null.

    ``validity`` has (path, valid) and maybe is_batch; files it doesn't have are
    invalid. A file that couldn't be read fails by that.
    """
    noted = [F.col(c) for c in validity.columns if c == "is_batch"] or [F.lit(None).cast("boolean").alias("is_batch")]
    known = files.join(validity.select("path", "valid", *noted), "path", "left")
    known = known if "error" in files.columns else known.withColumn("error", F.lit(None).cast("string"))
    large = F.coalesce(too_large(F.col("length"), max_file_size), F.lit(False))  # what can't be listed has no length
    why = (
        F.when(large, size_message(F.col("length"), max_file_size))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.coalesce("valid", F.lit(False)), INVALID)
        .when(F.length("name") > MOST_CHARACTERS["original_filename"], TOO_LONG)
        .otherwise(metadata_error(F.col("metadata")))
    )
    return known.withColumn("failure", F.concat(F.lit(prefix), why)).withColumn("error", F.when(~large, F.col("error"))).drop("valid")


def resolved(files: DataFrame, catalog: DataFrame, where: Column) -> DataFrame:
    """Checked ``files`` with what becomes of them: the columns of a response, ``hash``, and ``is_new``.

    ``files`` has (path, name, type, metadata, hash, is_batch, failure, error), ``catalog`` the
    catalog's rows; ``where`` is the path that a new content gets. A duplicate answers with the row it repeats: its id, name,
    path, type and status.
    """
    good = files.where(F.col("failure").isNull()).withColumn("storage_path", where)
    winner = F.struct(document_id(F.col("hash")).alias("id"), F.col("name").alias("original_filename"), "storage_path", "type", F.lit(INGESTED).alias("status"))
    own = against_catalog(first_wins(good, winner=winner), catalog)
    is_new = F.col("known").isNull() & F.col("is_first")
    row = F.coalesce("known", "winner")
    answers = own.select(
        "path", "hash", "metadata", "is_batch", "error",
        row["id"].alias("document_id"), row["original_filename"].alias("original_filename"), row["storage_path"].alias("storage_path"),
        row["type"].alias("type"), row["status"].alias("status"),
        F.when(is_new, INGESTED_MESSAGE).otherwise(KNOWN_MESSAGE).alias("message"), (~is_new).alias("is_duplicate"), is_new.alias("is_new"),
    )
    failures = files.where(F.col("failure").isNotNull()).select(
        "path", F.lit(None).cast("string").alias("hash"), "metadata", "is_batch", "error",
        F.lit(None).cast("string").alias("document_id"), F.col("name").alias("original_filename"), F.lit("").alias("storage_path"),
        "type", F.lit(FAILED).alias("status"), F.col("failure").alias("message"), F.lit(False).alias("is_duplicate"), F.lit(False).alias("is_new"),
    )
    return answers.unionByName(failures)


def responses(outcome: DataFrame) -> DataFrame:
    """The responses, with the path that each is for, whether the file looks like a batch, and the error that reading it ended with."""
    return outcome.select(*RESPONSE.names, "path", "is_batch", "error")


def catalog_rows(outcome: DataFrame) -> DataFrame:
    """Rows to add to the catalog, dated by when they were ``decided``."""
    now = F.col("decided")
    return outcome.where("is_new").select(
        F.col("document_id").alias("id"), "original_filename", "storage_path", "type", now.alias("upload_date"), "hash",
        "status", parsed(F.col("metadata")).alias("metadata"), now.alias("created_at"), now.alias("updated_at"),
    )


def unwritten(outcome: DataFrame, errors: DataFrame, prefix: str) -> DataFrame:
    """``outcome`` where files whose content couldn't be stored (hash, error) have failed, and those that repeat them."""
    own = errors.where("error IS NOT NULL").groupBy("hash").agg(F.min("error").alias("why"))
    found = outcome.join(own, "hash", "left")
    bad = F.col("why").isNotNull() & (F.col("storage_path") != "")
    values = {
        "document_id": F.lit(None).cast("string"), "storage_path": F.lit(""), "status": F.lit(FAILED), "message": F.concat(F.lit(prefix), "why"), "is_duplicate": F.lit(False), "is_new": F.lit(False),
    }
    return found.select(*(F.when(bad, values[c]).otherwise(F.col(c)).alias(c) if c in values else c for c in outcome.columns))


def store_of(spark: SparkSession, settings: Settings) -> FileStore | PackStore:
    """The content sink that the settings name."""
    kind = PackStore if settings.packed else FileStore
    return kind(spark, settings.storage_dir, settings.storage_mounted)


def _left(catalog: Catalog, outcome: DataFrame) -> list[str]:
    """Shards of an outcome whose new rows aren't in the catalog: of a shard all are or none, and they bear the outcome's date."""
    new = outcome.where("is_new").select("hash", "decided", shard_of(F.col("hash")).alias("shard"))
    shards = [r[0] for r in new.select("shard").distinct().collect()]
    there = catalog.rows(catalog.heads(shards)).select("hash", F.col("upload_date").alias("decided"))
    return sorted(r[0] for r in new.join(there, ["hash", "decided"], "left_anti").select("shard").distinct().collect())


def ingest(spark: SparkSession, files: DataFrame, validity: DataFrame, settings: Settings, work: str, batch: bool = False, resume: bool = False) -> DataFrame:
    """Take files in: store contents, add to the catalog, return the responses.

    ``work`` is a folder that all executors share. The hashes are written there, so
    contents are read once for them, and what was decided, so storing and
    cataloguing see one decision. Of the catalog only the shards of these hashes
    are read. Where another writer was first with some shards, their files are
    decided anew against what it brought in. With ``resume``, what an earlier run with this
    ``work`` decided holds: it is finished, and answered as it would have been.
    """
    catalog, store = Catalog(spark, settings.catalog_dir), store_of(spark, settings)
    catalog.create()
    store.bootstrap()
    prefix = BATCH if batch else SINGLE
    rows = checked(files, validity, settings.max_file_size, prefix)
    hashed = stored(rows.withColumn("hash", F.when(F.col("failure").isNull(), content_hash(F.col("content")))).drop("content"), f"{work}/hashed")
    counted = [F.count_if("is_new").alias("new"), F.count_if(F.col("is_batch") & (F.col("status") == INGESTED)).alias("several")]
    begun = resume and "_SUCCESS" in folder_of(spark, work).names(f"{work}/outcome")
    if begun:
        outcome = spark.read.parquet(f"{work}/outcome")
        counts = outcome.agg(*counted).first().asDict()
    else:
        base = catalog.heads([r[0] for r in hashed.where("hash IS NOT NULL").select(shard_of(F.col("hash"))).distinct().collect()])
        outcome, counts = measured(resolved(hashed, catalog.rows(base), store.path()).withColumn("decided", F.current_timestamp()), f"{work}/outcome", *counted)
    new = outcome.where("is_new").select("path", "hash", "storage_path")
    if counts["several"] and not batch:
        log.info("%d batch files taken in as single documents", counts["several"])
    contents = files.where(~too_large(F.col("length"), settings.max_file_size)).select("path", "content")
    done = store.write(contents.join(F.broadcast(new) if counts["new"] <= MOST_BROADCAST else new, "path"), work)
    if not done.where("error IS NOT NULL").isEmpty():
        outcome = stored(unwritten(outcome, done, prefix), f"{work}/stored")
    lost, attempt = _left(catalog, outcome) if begun else catalog.append(catalog_rows(outcome), base), 0
    while lost:
        attempt += 1
        again = catalog.heads(lost)
        inside = F.coalesce(shard_of(F.col("hash")).isin(lost), F.lit(False))
        mine = hashed.join(outcome.where(inside & (F.col("storage_path") != "")).select("path"), "path", "left_semi")
        redone = resolved(mine, catalog.rows(again), store.path()).withColumn("decided", F.current_timestamp())
        before = outcome
        outcome = stored(outcome.join(mine.select("path"), "path", "left_anti").unionByName(redone), f"{work}/outcome{attempt}")
        lost = catalog.append(catalog_rows(outcome.where(inside)), again)
        store.remove(before.where("is_new").select("path", "storage_path").join(outcome.where("NOT is_new").select("path", F.col("storage_path").alias("kept")), "path").where("storage_path != kept"))
    return responses(outcome)
