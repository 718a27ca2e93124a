"""Content sinks: plain files under content-addressed names, and packs of many contents with an index.

Both check each content against its hash as they write, show it only when it is whole, and
report what couldn't be written row by row instead of failing the job.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import storage_folder
from docloom.schemas import MOST_CHARACTERS
from docloom.sources.files import MOST_STORED, safe_name
from docloom.sources.listing import list_folder
from docloom.sources.systems import refuse_unshared, system_of
from docloom.work import stored, work_dir

FOLDERS = ("originals", "abstracts", "publications")
WRITTEN = "storage_path string, error string"
#: A pack is closed when it has so many bytes, and an index has this many first digits of hashes as partitions.
PACK_BYTES, DIGITS = 256 << 20, 2
INDEX = "hash string, pack string, start long, length long"
CHANGED = "the content changed while it was read"


def _put(path: str, content: bytes, base: str | None) -> None:
    """Write a file whole: under another name first, so that nobody ever sees a part of it."""
    system, inner, _ = system_of(path)
    if base is not None:
        within = system_of(base)[1].rstrip("/") + "/"
        if not inner.startswith(within) or ".." in inner[len(within) :].split("/"):
            raise OSError(f"{path} is outside the storage")
    folder, _, name = inner.rpartition("/")
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, inner)


def written(files: DataFrame, base: str | None = None) -> DataFrame:
    """Write each ``content`` to its ``storage_path``: (storage_path, error).

    Paths are URIs that pyarrow knows, or local. With ``base`` none may lead out of it. Where ``files`` has a
    ``hash``, the content has to have it. Store the result: each use writes anew (the same bytes to the same places).
    """
    checked = "hash" in files.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for k, path in enumerate(batch["storage_path"].to_pylist()):
                content, error = batch["content"][k].as_py(), None
                try:
                    if checked and (content is None or hashlib.sha256(content).hexdigest() != batch["hash"][k].as_py()):
                        raise OSError(CHANGED)
                    _put(path, content or b"", base)
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
                errors.append(error)
            yield pa.record_batch([batch["storage_path"], pa.array(errors, pa.string())], ["storage_path", "error"])

    return files.select("storage_path", "content", *(["hash"] if checked else [])).mapInArrow(write, WRITTEN)


@dataclass(frozen=True)
class FileStore:
    """One file a content, below a folder for its type."""

    spark: SparkSession
    base: str
    mounted: bool = False

    def bootstrap(self) -> None:
        """Make the storage folders; refuse a folder that executors don't share, and one whose paths would be too long for the catalog."""
        refuse_unshared(self.spark, self.base, self.mounted)
        if len(self.base) + len("/publications/") + 65 + MOST_STORED > MOST_CHARACTERS["storage_path"]:
            raise ValueError(f"the storage's path is too long: {self.base}")
        for name in FOLDERS:
            system, inner, _ = system_of(f"{self.base}/{name}")
            system.create_dir(inner, recursive=True)

    def path(self) -> Column:
        """Where the content of (type, hash, name) is kept: under its hash and name, so that a repeated write changes nothing."""
        return F.concat_ws("/", F.lit(self.base), storage_folder(F.col("type")), F.concat_ws("_", F.col("hash"), safe_name(F.col("name"))))

    def write(self, files: DataFrame, work: str) -> DataFrame:
        """(hash, error) of (hash, storage_path, content)."""
        done = stored(written(files, self.base), f"{work}/written")
        return done.select(F.regexp_extract("storage_path", r"/([0-9a-f]{64})_[^/]*$", 1).alias("hash"), "error")

    def remove(self, paths: DataFrame) -> None:
        """Remove files (storage_path) that nothing points to."""

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch["storage_path"].to_pylist():
                    try:
                        system, inner, _ = system_of(path)
                        system.delete_file(inner)
                    except OSError:
                        pass
                yield batch

        paths.select("storage_path").mapInArrow(drop, "storage_path string").count()


@dataclass(frozen=True)
class PackStore:
    """Many contents a file, with an index of where each begins.

    A task appends contents to a pack of its own and hands on their places only when the pack is
    closed; Spark then commits the index's rows of all tasks at once. What was
    written by a task that died, or before an index that never came, is in no index and so
    can't be read, and ``vacuum`` removes it.
    """

    spark: SparkSession
    base: str
    mounted: bool = False

    def bootstrap(self) -> None:
        refuse_unshared(self.spark, self.base, self.mounted)
        for name in ("packs", "index"):
            system, inner, _ = system_of(f"{self.base}/{name}")
            system.create_dir(inner, recursive=True)

    def path(self) -> Column:
        return F.concat(F.lit(f"{self.base}/packs#"), F.col("hash"))

    def index(self) -> DataFrame:
        """(hash, pack, start, length); a hash that two runs wrote has the place that comes first."""
        own = self.spark.read.schema(f"{INDEX}, shard string").parquet(f"{self.base}/index")
        return own.groupBy("shard", "hash").agg(F.min(F.struct("pack", "start", "length")).alias("at")).select("hash", "at.*", "shard")

    def write(self, files: DataFrame, work: str) -> DataFrame:
        """Pack what isn't there yet; (hash, error) of (hash, content), errors of those that couldn't be packed."""
        new = files.select("hash", "content").join(self.index().select("hash"), "hash", "left_anti")
        done = stored(new.mapInArrow(self._packed(PACK_BYTES), f"{INDEX}, error string"), f"{work}/packed")
        good = done.where("error IS NULL").withColumn("shard", F.substring("hash", 1, DIGITS))
        good.select("hash", "pack", "start", "length", "shard").repartition("shard").write.mode("append").partitionBy("shard").parquet(f"{self.base}/index")
        return done.select("hash", "error")

    def _packed(self, most: int):
        base = self.base
        schema = pa.schema([("hash", pa.string()), ("pack", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("error", pa.string())])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, folder, _ = system_of(f"{base}/packs")
            name, out, at, rows, bad = "", None, 0, [], []

            def closed() -> pa.RecordBatch:
                out.close()
                system.move(f"{folder}/.{name}.part", f"{folder}/{name}")
                return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

            for batch in batches:
                for k, hash_ in enumerate(batch["hash"].to_pylist()):
                    content = batch["content"][k].as_py()
                    if content is None or hashlib.sha256(content).hexdigest() != hash_:
                        bad.append((hash_, None, None, None, f"OSError: {CHANGED}"))
                        continue
                    if out is None:
                        name, at, rows = f"{uuid.uuid4().hex}.pack", 0, []
                        out = system.open_output_stream(f"{folder}/.{name}.part")
                    out.write(content)
                    rows.append((hash_, name, at, len(content), None))
                    at += len(content)
                    if at >= most:
                        yield closed()
                        out = None
            if out is not None:
                yield closed()
            if bad:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*bad, strict=True), schema.types, strict=True)], schema=schema)

        return pack

    def read(self, hashes: DataFrame) -> DataFrame:
        """(hash, content) of the hashes that are there, by ranged reads; a pack's reads go from its beginning to its end."""
        base = self.base

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, folder, _ = system_of(f"{base}/packs")
            name, source = None, None
            for batch in batches:
                out, keys, size = [], [], 0
                for hash_, pack, start, length in zip(*(batch[c].to_pylist() for c in ("hash", "pack", "start", "length")), strict=True):
                    if pack != name:
                        name, source = pack, system.open_input_file(f"{folder}/{pack}")
                    content = source.read_at(length, start)
                    if len(content) != length:
                        raise OSError(f"{pack} ends before {start + length}")
                    out.append(content)
                    keys.append(hash_)
                    size += length
                    if size >= 32 << 20:
                        yield pa.record_batch([pa.array(keys), pa.array(out, pa.binary())], ["hash", "content"])
                        out, keys, size = [], [], 0
                if out:
                    yield pa.record_batch([pa.array(keys), pa.array(out, pa.binary())], ["hash", "content"])

        wanted = hashes.select("hash").distinct().withColumn("shard", F.substring("hash", 1, DIGITS))
        places = self.index().join(wanted, ["shard", "hash"], "left_semi")
        spread = places.repartition("pack", F.floor(F.col("start") / (64 << 20))).sortWithinPartitions("pack", "start")
        return spread.select("hash", "pack", "start", "length").mapInArrow(fetch, "hash string, content binary")

    def sizes(self) -> DataFrame:
        """(path, length) of every content, from the index alone."""
        return self.index().select(F.concat(F.lit(f"{self.base}/packs#"), "hash").alias("path"), "length")

    def vacuum(self) -> int:
        """Remove packs that no index row names; there must be no writer. Returns how many."""
        packs = list_folder(self.spark, f"{self.base}/packs").select("path", F.element_at(F.split("path", "/"), -1).alias("pack"))
        named = self.spark.read.schema(f"{INDEX}, shard string").parquet(f"{self.base}/index").select("pack").distinct()
        lost = stored(packs.join(named, "pack", "left_anti").select(F.col("path").alias("storage_path")), f"{work_dir(self.spark)}/lost")
        FileStore(self.spark, self.base).remove(lost)
        return lost.count()

    def remove(self, paths: DataFrame) -> None:
        """Nothing: a content that another run packed too is kept once by the index."""
