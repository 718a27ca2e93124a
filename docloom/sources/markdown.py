"""Paginated markdown: pages between ``{n}`` and 48 dashes, n from 0.

``read_pages`` reads files of any size as a data source: a file is cut into ranges of bytes, each a task. A range holds the
pages whose marks begin in it, so a task seeks its range's beginning, goes on to the first mark, and reads past
its range's end to where its last page ends. Marks can't overlap, so whatever the ranges are
the pages are those of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docloom.sources.systems import system_of

RULE = "-" * 48
DELIMITER = r"\{\d+\}-{48}"
MARK = re.compile(rb"\{(\d+)\}-{48}")
SOURCE, SPLIT_BYTES, READ_BYTES, BATCH_BYTES = "paginated_markdown", 64 << 20, 1 << 20, 16 << 20
PAGES = "path string, page_no int, text string, start long"


@dataclass
class Ranges(InputPartition):
    """What one task reads: (path, start, stop) of each range."""

    ranges: list[tuple[str, int, int]]


def pages_in(stream, start: int, stop: int) -> Iterator[tuple[int | None, bytes, int]]:
    """(number, text, place of the mark) of the pages whose marks begin from ``start`` to before ``stop``; ``stream`` is at ``start``."""
    held, at, seen = bytearray(), start, 0  # bytes from place ``at``, searched up to ``seen``
    number, mark, ended = None, None, False
    while True:
        more = stream.read(READ_BYTES)
        held += more
        while found := MARK.search(held, seen):
            if mark is not None:
                yield number, bytes(held[: found.start()]), mark
            mark = at + found.start()
            if mark >= stop:
                return
            number = int(found[1])
            at += found.end()
            del held[: found.end()]
            seen = 0
        if not more:
            if mark is not None:
                yield number, bytes(held), mark
            return
        opened = held.rfind(b"{")  # a mark may go on in what is read next
        seen = opened if opened >= 0 and re.fullmatch(rb"\{\d*(\}-{0,47})?", held[opened:]) else len(held)
        if mark is None:
            at += seen
            del held[:seen]
            seen = 0
            if at >= stop:
                return


class PageReader(DataSourceReader):
    def __init__(self, paths: list[str], size: int, together: int):
        self.paths, self.size, self.together = paths, size, together

    def partitions(self) -> list[Ranges]:
        """Ranges of the files named, and of the ``.md`` files in the folders named; small ones go together."""
        from pyarrow import fs

        out, own, full = [], [], 0
        for path in self.paths:
            system, inner, prefix = system_of(path)
            info = system.get_file_info(inner)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            files = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(inner)) if i.path.endswith(".md")]
            for f in sorted(files, key=lambda i: i.path):
                for at in range(0, f.size, self.size):
                    stop = min(at + self.size, f.size)
                    if own and full + stop - at > self.together:
                        out.append(Ranges(own))
                        own, full = [], 0
                    own.append((prefix + f.path, at, stop))
                    full += stop - at
        return [*out, Ranges(own)] if own else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, start, stop in partition.ranges:
            system, inner, _ = system_of(path)
            with system.open_input_file(inner) as stream:
                stream.seek(start)
                for number, text, mark in pages_in(stream, start, stop):
                    rows.append((path, number if number < 1 << 31 else None, text.decode("utf-8", "replace").strip("\n"), mark))
                    size += len(text)
                    if size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in PAGES.split(", ")])


class PaginatedMarkdown(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PageReader:
        size = int(self.options.get("splitBytes", SPLIT_BYTES))
        return PageReader([p for p in self.options["path"].split("\n") if p], size, max(size, int(self.options.get("taskBytes", size))))


def read_pages(spark: SparkSession, *paths: str, split_bytes: int = SPLIT_BYTES, task_bytes: int = 0) -> DataFrame:
    """(path, page_no, text, start) of the pages of markdown files, or of the ``.md`` files of folders; ``start`` is where a page's mark begins.

    Pages are as ``split_pages`` gives them; numbers that are no int are null. A range is of ``split_bytes``
    at most, and a task reads ranges of ``task_bytes`` together (one range at least).
    """
    spark.dataSource.register(PaginatedMarkdown)
    return spark.read.format(SOURCE).option("path", "\n".join(paths)).option("splitBytes", str(split_bytes)).option("taskBytes", str(task_bytes)).load()


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, markdown) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown"))


def split_pages(df: DataFrame, markdown: str = "markdown") -> DataFrame:
    """One row per page: the other columns, ``page_no`` as written, and ``text`` without the newlines about it.

    What stands before the first delimiter is dropped; a text without one has no pages.
    """
    kept = [c for c in df.columns if c not in (markdown, "page_no", "text")]
    numbers = F.regexp_extract_all(F.col(markdown), F.lit(r"\{(\d+)\}-{48}"), F.lit(1))
    texts = F.slice(F.split(markdown, DELIMITER), F.lit(2), F.size(numbers))
    pages = F.arrays_zip(numbers.alias("n"), texts.alias("t"))
    return df.withColumn("__page", F.explode(pages)).select(*kept, F.col("__page.n").cast("int").alias("page_no"), F.trim(F.col("__page.t"), F.lit("\n")).alias("text"))


def render_pages(pages: DataFrame, key: str) -> DataFrame:
    """(key, markdown) of (key, page_no, text), pages in order."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))
    texts = F.transform(ordered, lambda p: F.concat(F.lit("{"), p["page_no"].cast("string"), F.lit("}" + RULE + "\n\n"), p["text"], F.lit("\n\n")))
    return pages.groupBy(key).agg(F.array_join(texts, "").alias("markdown"))


def session_lines(pages: DataFrame) -> DataFrame:
    """An extension: abstract number, whether it is a trial in progress, session, and trial id of each page, where they are found."""
    line = F.regexp_extract("text", r"(?m)^#* *((?:TPS)?\d{3,6}) ([^\n]*(?:Session|Discussion)[^\n]*)$", 0)
    number = F.regexp_extract(line, r"((?:TPS)?\d{3,6}) ", 1)
    return pages.withColumns(
        {
            "abstract_no": F.regexp_replace(number, "^TPS", ""),
            "is_tps": number.startswith("TPS"),
            "session": F.regexp_extract(line, r"\d{3,6} (.*)$", 1),
            "trial_id": F.regexp_extract("text", r"NCT\d{8}", 0),
        }
    )
