"""The few file operations a store needs, on any Hadoop file system, and atomic versions of one small JSON file."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._bytes = jvm.org.apache.commons.io.IOUtils
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def make(self, path: str) -> None:
        self.fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(path))] if self.exists(path) else []

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self._path(path)).getLength() if self.exists(path) else 0

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(self._bytes.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Writes a file that mustn't exist yet; False if another writer was first.

        The text goes to a name of its own first and is renamed, which fails where the target exists, so readers never see
        half a file.
        """
        if self.exists(path):
            return False
        part = f"{path}.{uuid.uuid4().hex}.part"
        out = self.fs.create(self._path(part), True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        if self.fs.rename(self._path(part), self._path(path)):
            return True
        self.delete(part)
        return False


    def is_dir(self, path: str) -> bool:
        return self.exists(path) and self.fs.getFileStatus(self._path(path)).isDirectory()

    def copy(self, source: str, target: str) -> int:
        """Copies a file's bytes to a new file, on this file system; how many they were."""
        read, write = self.fs.open(self._path(source)), self.fs.create(self._path(target), False)
        try:
            return self._bytes.copyLarge(read, write)
        finally:
            read.close()
            write.close()


class Conflict(RuntimeError):
    """Another writer committed first; read again and repeat."""


class Catalog:
    """Versions of the store's catalog; the highest is current, and a commit adds the next one or fails."""

    KEPT = 20

    def __init__(self, files: Files):
        self.files, self.dir = files, files.at("_catalog")

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.files.names(self.dir) if n.startswith("v") and n.endswith(".json"))

    def load(self) -> tuple[int, dict]:
        last = (self.versions() or [-1])[-1]
        if last < 0:
            return -1, {"tables": {}, "indexes": [], "loads": 0}
        return last, json.loads(self.files.read(self._name(last)))

    def commit(self, seen: int, state: dict) -> None:
        self.files.make(self.dir)
        if not self.files.write_new(self._name(seen + 1), json.dumps(state, sort_keys=True)):
            raise Conflict(f"version {seen + 1} of the catalog is there already")
        for old in self.versions()[: -self.KEPT]:
            self.files.delete(self._name(old))

    def _name(self, n: int) -> str:
        return f"{self.dir}/v{n:012d}.json"
