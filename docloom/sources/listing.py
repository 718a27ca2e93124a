"""Distributed listings and contents: every file of a folder, also empty and hidden ones and such as can't be read.

Spark's source of whole files skips empty and hidden files. Here folders are rows:
each round deals the folders found so far to tasks, which list them (local ones as they are read, others with pyarrow's file systems),
and goes on with the folders in these, so a tree takes as many rounds as it is deep and
no listing meets in one place. File systems that pyarrow doesn't know are listed by Hadoop's on the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from stat import S_ISDIR, S_ISREG

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.work import stored, work_dir
from docloom.sources.systems import is_known, is_local, system_of

LISTED = "root string, folder string, path string, length long, is_folder boolean, error string"
NO_FILE = "this is no regular file"
#: The largest content of one row, rows and bytes of contents handed on at a time, and bytes read by one task.
MOST_READABLE, BATCH_ROWS, BATCH_BYTES, TASK_BYTES = (1 << 31) - 65_536, 1000, 32 << 20, 256 << 20


def _schema(spec: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in spec.split(", ")])


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _entries(folder: str) -> Iterator[tuple[str, int | None, bool | None, str | None]]:
    """(path, length, is_folder, error) of what is in a folder, handed on as it is read; ``is_folder`` is null for what is neither, as a pipe or a link that leads nowhere.

    Of local folders pyarrow would pass over what it can't look at, so they are read here.
    """
    from pyarrow import fs

    system, inner, prefix = system_of(folder)
    if not is_local(folder):
        for i in system.get_file_info(fs.FileSelector(inner, recursive=False)):
            if i.type == fs.FileType.Unknown:
                yield prefix + i.path, None, None, NO_FILE
            elif i.type != fs.FileType.NotFound:
                yield prefix + i.path, i.size, i.type == fs.FileType.Directory, None
        return
    with os.scandir(inner) as found:
        for e in found:
            try:
                own = e.stat()
            except FileNotFoundError as x:
                if e.is_symlink():  # others were removed meanwhile
                    yield prefix + e.path, None, None, _said(x)
            except OSError as x:
                yield prefix + e.path, None, not e.is_file(follow_symlinks=False), _said(x)
            else:
                if S_ISREG(own.st_mode):
                    yield prefix + e.path, own.st_size, False, None
                elif S_ISDIR(own.st_mode):
                    yield prefix + e.path, None, True, None
                else:
                    yield prefix + e.path, None, None, NO_FILE


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is in each folder (root, path); a folder that can't be listed, or not to its end, is a row with its error and itself as ``folder``, which ``list_folders`` sees."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for root, folder in zip(batch["root"].to_pylist(), batch["path"].to_pylist(), strict=True):
                try:
                    yield from ((root, path if is_folder and error else folder, path, length, is_folder, error) for path, length, is_folder, error in _entries(folder))
                except OSError as e:
                    yield root, folder, folder, None, True, _said(e)

    every = rows()
    while some := list(islice(every, BATCH_ROWS)):
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*some, strict=True), _schema(LISTED).types, strict=True)], schema=_schema(LISTED))


def _by_hadoop(spark: SparkSession, folders: list[str], recursive: bool) -> DataFrame:
    rows = []
    for folder in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, recursive)
        while found.hasNext():
            s = found.next()
            path = s.getPath().toString()
            rows.append((folder, path.rpartition("/")[0], path, s.getLen(), False, None))
    return spark.createDataFrame(rows, LISTED)


def list_folders(spark: SparkSession, folders: list[str], recursive: bool = False, failures: bool = False) -> DataFrame:
    """All files (root, folder, path, length, error) in some folders, and below them if ``recursive``; ``root`` is the folder as given.

    A folder that is to be listed and can't be, or a file that can't be looked at, is an ``OSError``: without it the listing would look whole. With ``failures``
    such are rows with their errors (a folder's ``path`` is its ``folder``), and so is what has a name and is no file.
    """
    if not all(map(is_known, folders)):
        return _by_hadoop(spark, folders, recursive).drop("is_folder")
    work, rounds = f"{work_dir(spark)}/listing", []
    frontier = spark.createDataFrame([(f, f) for f in folders], "root string, path string")
    failed = F.col("error").isNotNull()
    asked = ~F.col("is_folder") | F.lit(recursive) | (F.col("path") == F.col("root"))
    bad = F.when(failed & asked & F.col("is_folder").isNotNull(), F.concat_ws(": ", "path", "error"))
    while True:
        dealt = frontier.repartition(spark.sparkContext.defaultParallelism)
        rounds.append(stored(dealt.mapInArrow(_list, LISTED), f"{work}/{len(rounds)}"))
        deeper, n, first = rounds[-1].agg(F.count_if(F.col("is_folder") & ~failed), F.count(bad), F.min(bad)).first()
        if n and not failures:
            raise OSError(f"{n} folders or files can't be listed, the first is {first}")
        if not (recursive and deeper):
            break
        frontier = rounds[-1].where(F.col("is_folder") & ~failed).select("root", "path")
    every = reduce(DataFrame.unionByName, rounds)
    return every.where(~F.col("is_folder") | failed if failures else ~F.col("is_folder")).drop("is_folder")


def list_folder(spark: SparkSession, folder: str, recursive: bool = False, failures: bool = False) -> DataFrame:
    return list_folders(spark, [folder], recursive, failures)


def with_contents(files: DataFrame, most: int = MOST_READABLE) -> DataFrame:
    """``files`` (path, length, error and more) with ``content``.

    A file longer than ``most`` is never opened. One that can't be read
    has its ``error`` and no content; it never fails the job. Paths of file systems that only Spark
    reads get theirs by a join with Spark's source.
    """
    most = min(most, MOST_READABLE)
    files = files.withColumn("error", F.when(F.col("error").isNull() & (F.col("length") > MOST_READABLE), "a file of 2 GiB or more can't be read").otherwise(F.col("error")) if most == MOST_READABLE else F.col("error"))
    names = files.columns
    at, long, bad = names.index("path"), names.index("length"), names.index("error")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size, contents, errors = 0, 0, [], []

            def part(end: int, batch=batch) -> pa.RecordBatch:
                own = batch.slice(begin, end - begin)
                columns = [*own.columns, pa.array(contents, pa.binary())]
                columns[bad] = pa.array(errors, pa.string())
                return pa.record_batch(columns, [*names, "content"])

            for k, (path, length, error) in enumerate(zip(*(batch.column(i).to_pylist() for i in (at, long, bad)), strict=True)):
                content = None
                if error is None and length is not None and length <= most:
                    try:
                        system, inner, _ = system_of(path)
                        with system.open_input_stream(inner) as stream:
                            content = stream.read()
                        if len(content) > most:
                            content, error = None, "the file has grown while it was read"
                    except OSError as e:
                        error = _said(e)
                contents.append(content)
                errors.append(error)
                size += len(content or b"")
                if size >= BATCH_BYTES:
                    yield part(k + 1)
                    begin, size, contents, errors = k + 1, 0, [], []
            if begin < batch.num_rows:
                yield part(batch.num_rows)

    schema = files.select("*", F.lit(None).cast("binary").alias("content")).schema
    return files.mapInArrow(read, schema)


def dealt(files: DataFrame) -> DataFrame:
    """``files`` (stored; with ``length``) spread over tasks by their bytes."""
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES + 1))


def with_contents_of(spark: SparkSession, files: DataFrame, most: int) -> DataFrame:
    """``with_contents``, by Spark's own source where the first path's file system is one that pyarrow doesn't know; that one doesn't show hidden files, which are errors then."""
    first = files.select("path").first()
    if first is None or is_known(first[0]):
        return with_contents(dealt(files), most)
    folders = [r[0] for r in files.select("root").distinct().collect()]
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).where(F.col("length") <= min(most, MOST_READABLE)).select("path", "content")
    found = files.join(read, "path", "left").withColumn("content", F.when(F.col("length") == 0, F.lit(b"")).otherwise(F.col("content")))
    unread = F.col("error").isNull() & F.col("content").isNull() & (F.col("length") <= most)
    error = F.when(unread, "Spark's source doesn't show this file").otherwise(F.col("error"))
    return found.withColumn("error", error).select(*files.columns, "content")
