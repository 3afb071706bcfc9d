"""Small files of a store, through Hadoop's file systems (any that Spark can write)."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Write a new file whole or not at all; False when the name is taken."""
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(temporary), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        done = not self.exists(path) and self._fs.rename(self._path(temporary), self._path(path))
        if not done:
            self.delete(temporary)
        return done

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
