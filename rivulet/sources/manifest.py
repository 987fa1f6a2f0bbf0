"""Versioned manifests: one small JSON file per committed version, written once under a name of its own."""

from __future__ import annotations

import datetime as dt
import json
import re

from pyspark.sql import SparkSession

from rivulet.functions.schema import ConflictError


class ManifestDir:
    """Manifests in a folder of any file system that Spark reaches.

    A version is a file written under a temporary name and renamed without overwriting: a reader sees all of a
    commit or none, and of two writers of the same version one fails. That holds where the file system's rename is atomic
    and refuses an existing target, as HDFS and local folders do; object stores need a commit service in front.
    """

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self.folder = folder
        self.fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(folder))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.folder))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d{12})\.json", n)))

    def _file(self, version: int):
        return self._path(f"{self.folder}/v{version:012d}.json")

    def read(self, version: int | None = None) -> dict | None:
        """A version, by default the newest; None if there is none."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        stream = self.fs.open(self._file(version))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, body: dict, version: int) -> None:
        target = self._file(version)
        if self.fs.exists(target):
            raise ConflictError(f"version {version} exists")
        import uuid

        temporary = self._path(f"{self.folder}/.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(temporary, False)
        try:
            out.write(json.dumps(body | {"version": version}).encode())
        finally:
            out.close()
        if not self.fs.rename(temporary, target):
            self.fs.delete(temporary, False)
            raise ConflictError(f"version {version} exists")

    def remove(self, version: int) -> None:
        self.fs.delete(self._file(version), False)

    def folders(self, path: str) -> list[tuple[str, dt.datetime]]:
        """What lies in a folder, with the times of the last change (UTC)."""
        at = self._path(path)
        if not self.fs.exists(at):
            return []
        time = lambda ms: dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).replace(tzinfo=None)
        return [(str(s.getPath()), time(s.getModificationTime())) for s in self.fs.listStatus(at)]

    def delete_tree(self, path: str) -> None:
        self.fs.delete(self._path(path), True)
