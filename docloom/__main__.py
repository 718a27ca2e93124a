"""Command line: ``python -m docloom ingest --file F --type abstract`` and so on."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession

from docloom.config import Settings, app_info
from docloom.operators.stats import batch_summary, service_stats
from docloom.plans.extract import extract, write_extracts
from docloom.plans.ingest import store_of
from docloom.plans.routes import extract_inputs, take_in
from docloom.schemas import RESPONSE, TYPES
from docloom.sources.files import SourceError, scan_directory, scan_file, scan_storage
from docloom.work import work_dir


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="docloom")
    out.add_argument("--log-level", default="INFO", choices=("DEBUG", "INFO", "WARNING", "ERROR"))
    commands = out.add_subparsers(dest="command", required=True)
    take = commands.add_parser("ingest", help="ingest a file or a folder")
    where = take.add_mutually_exclusive_group(required=True)
    where.add_argument("--file")
    where.add_argument("--directory")
    take.add_argument("--type", required=True, choices=TYPES)
    take.add_argument("--metadata", default="{}")
    take.add_argument("--batch", action="store_true")
    take.add_argument("--recursive", action="store_true")
    text = commands.add_parser("extract", help="write the text and metadata of a PDF file, or of a folder's")
    text.add_argument("input")
    text.add_argument("output")
    text.add_argument("--recursive", action="store_true")
    commands.add_parser("stats", help="count the storage")
    commands.add_parser("info", help="name and version")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level, format="%(asctime)s - %(name)s - %(levelname)s - %(message)s", handlers=[logging.StreamHandler(sys.stderr), logging.FileHandler("ingest.log", delay=True)])
    log = logging.getLogger("docloom")
    if args.command == "info":
        print(json.dumps(app_info()))
        return 0
    settings = Settings.from_env()
    if args.command == "ingest":
        try:
            json.loads(args.metadata or "{}")
        except ValueError:
            log.error("Invalid JSON metadata")
            return 1
    spark = settings.session()
    if args.command == "stats":
        try:
            store_of(spark, settings).bootstrap()
            print(service_stats(scan_storage(spark, settings.storage_dir), settings.max_file_size, settings.retry_attempts).toJSON().first())
        except OSError as e:
            log.error("%s", e)
            return 1
        return 0
    try:
        if args.command == "extract":
            return _extract(spark, args, settings, log)
        if args.file:
            files = scan_file(spark, args.file, args.type, args.metadata, args.batch, settings.max_file_size)
        else:
            files = scan_directory(spark, args.directory, args.type, args.recursive, args.metadata, settings.max_file_size)
    except SourceError as e:
        log.error("%s", e)
        return 1
    found = take_in(files, settings, batch=args.batch)
    for line in found.select(*RESPONSE.names).toJSON().toLocalIterator():
        print(line)
    print(batch_summary(found).toJSON().first())
    return 0


def _extract(spark: SparkSession, args: argparse.Namespace, settings: Settings, log: logging.Logger) -> int:
    """Print what was written, and the run's statistics; 1 if a file couldn't be read."""
    found, counts = extract(extract_inputs(spark, args.input, args.recursive), settings, work_dir(spark))
    unsaved = 0
    for row in write_extracts(found, args.output).toLocalIterator():
        if row.error is None:
            print(f"Saved: {row.storage_path}")
        else:
            unsaved += 1
            log.error("%s: %s", row.storage_path, row.error)
    for row in found.where("error IS NOT NULL").select("path", "error").toLocalIterator():
        log.error("%s: %s", row.path, row.error)
    print(json.dumps(counts))
    return 1 if unsaved or counts["failed"] else 0


if __name__ == "__main__":
    sys.exit(main())
