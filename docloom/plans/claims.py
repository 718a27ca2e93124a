"""Claims: which writer was first with a version of a shard. Files that are created only where there is none.

On local and mounted folders a claim is a hard link, on others Hadoop's create without overwriting; both are atomic,
and so is the renaming of folders that commits rely on (as on HDFS; not on plain object stores).
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from docloom.sources.systems import is_local, system_of


class LocalFolder:
    """The few operations that commits need, on local paths."""

    def path(self, path: str) -> str:
        return system_of(path)[1]

    def names(self, path: str) -> list[str]:
        try:
            return sorted(os.listdir(self.path(path)))
        except FileNotFoundError:
            return []

    def make(self, path: str) -> None:
        os.makedirs(self.path(path), exist_ok=True)

    def move(self, source: str, target: str) -> bool:
        """Rename a folder; False if it isn't there any more."""
        self.make(target.rpartition("/")[0])
        try:
            os.rename(self.path(source), self.path(target))
        except FileNotFoundError:
            return False
        return True

    def delete(self, path: str) -> None:
        own = self.path(path)
        if os.path.isdir(own):
            shutil.rmtree(own, ignore_errors=True)
        else:
            try:
                os.remove(own)
            except FileNotFoundError:
                pass

    def put_if_absent(self, path: str, text: str) -> bool:
        own = self.path(path)
        part = f"{os.path.dirname(own)}/.{uuid.uuid4().hex}"
        with open(part, "w", encoding="utf-8") as file:
            file.write(text)
        try:
            os.link(part, own)
        except FileExistsError:
            return False
        finally:
            os.remove(part)
        return True

    def read(self, path: str) -> str:
        try:
            with open(self.path(path), encoding="utf-8") as file:
                return file.read()
        except FileNotFoundError:
            return ""


class HadoopFolder:
    """The same on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.fs = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, path: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(path))) if self.fs.exists(self.at(path)) else []

    def make(self, path: str) -> None:
        self.fs.mkdirs(self.at(path))

    def move(self, source: str, target: str) -> bool:
        self.make(target.rpartition("/")[0])
        return bool(self.fs.exists(self.at(source)) and self.fs.rename(self.at(source), self.at(target)))

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def put_if_absent(self, path: str, text: str) -> bool:
        try:
            out = self.fs.create(self.at(path), False)
        except Exception as e:  # noqa: BLE001  Py4J wraps what Java throws
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, path: str) -> str:
        if not self.fs.exists(self.at(path)):
            return ""
        source = self.fs.open(self.at(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()


def folder_of(spark: SparkSession, path: str) -> LocalFolder | HadoopFolder:
    return LocalFolder() if is_local(path) else HadoopFolder(spark, path)


@dataclass(frozen=True)
class Head:
    """A shard's last version, the generation it belongs to, and where its rows were staged."""

    version: int = 0
    generation: int = 0
    staged: str = ""
    kind: str = ""


class Claims:
    def __init__(self, spark: SparkSession, path: str):
        self.folder, self.path = folder_of(spark, path), path

    def shards(self) -> list[str]:
        return [n for n in self.folder.names(self.path) if not n.startswith(".")]

    def _versions(self, shard: str) -> list[int]:
        return [int(n) for n in self.folder.names(f"{self.path}/{shard}") if n.isdigit()]

    def head(self, shard: str) -> Head:
        while True:
            versions = self._versions(shard)
            if not versions:
                return Head()
            text = self.folder.read(f"{self.path}/{shard}/{max(versions):012d}")
            if text.endswith("}"):
                own = json.loads(text)
                return Head(max(versions), own["generation"], own["staged"], own["kind"])
            time.sleep(0.05)  # its writer hasn't finished it

    def take(self, shard: str, head: Head) -> bool:
        """Claim a version; False if another has claimed it or a later one."""
        self.folder.make(f"{self.path}/{shard}")
        at = f"{self.path}/{shard}/{head.version:012d}"
        if not self.folder.put_if_absent(at, json.dumps({"generation": head.generation, "staged": head.staged, "kind": head.kind})):
            return False
        if max(self._versions(shard)) > head.version:  # this version was over and its claim cleared away
            self.folder.delete(at)
            return False
        return True

    def clear(self, shard: str, below: int) -> None:
        """Remove claims that later ones have overtaken."""
        for version in self._versions(shard):
            if version < below:
                self.folder.delete(f"{self.path}/{shard}/{version:012d}")
