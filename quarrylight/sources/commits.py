"""A numbered log of JSON entries in a folder that driver and executors share.

An entry appears whole or not at all, and only one writer gets a number: it is written under a name of
its own and then renamed without overwriting (on a local disk: linked). This needs a file system whose
rename is atomic and refuses an existing target, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder = self._path(self.root)
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d{20}\.json", n))

    def latest(self) -> int:
        """Number of the newest entry, -1 if there is none."""
        return max(self.versions(), default=-1)

    def read(self, version: int) -> dict:
        stream = self._fs.open(self._entry(version))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8"))
        finally:
            stream.close()

    def append(self, version: int, entry: dict) -> bool:
        """Write entry ``version``; False, and nothing written, if another writer has that number."""
        target, own = self._entry(version), self._path(f"{self.root}/.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(own, False)
        try:
            stream.write(json.dumps(entry, sort_keys=True).encode("utf-8"))
        finally:
            stream.close()
        try:
            return self._claim(own, target)
        finally:
            self._fs.delete(own, False)

    def _claim(self, own, target) -> bool:  # noqa: ANN001
        from py4j.protocol import Py4JJavaError

        try:
            if self._fs.getUri().getScheme() == "file":
                files = self._jvm.java.nio.file.Files
                at = [self._jvm.java.io.File(self._fs.makeQualified(p).toUri().getPath()).toPath() for p in (target, own)]
                files.createLink(*at)
            else:
                never = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(own, target, never)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _entry(self, version: int):  # noqa: ANN202
        return self._path(f"{self.root}/{version:020d}.json")

    def delete(self, path: str) -> None:
        """Remove a file or folder that no entry names any more."""
        self._fs.delete(self._path(path), True)
