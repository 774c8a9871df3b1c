"""Small files on whatever file system the store lives on, by Hadoop's file API."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer committed first."""


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._gateway = spark.sparkContext._gateway
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, rel: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}" if rel else self.root)

    def path(self, rel: str) -> str:
        return f"{self.root}/{rel}"

    def names(self, rel: str) -> list[str]:
        p = self._path(rel)
        if not self._fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p))

    def read(self, rel: str) -> str:
        stream = self._fs.open(self._path(rel))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, rel: str, text: str) -> None:
        """Write a file that must not exist yet: temporary name first, then a rename that
        refuses to replace."""
        temp = self._path(f"{rel}.{self._jvm.java.util.UUID.randomUUID().toString()}.tmp")
        out = self._fs.create(temp, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        option = self._jvm.org.apache.hadoop.fs.Options.Rename
        array = self._gateway.new_array(option, 1)
        array[0] = option.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self._conf)
        try:
            context.rename(temp, self._path(rel), array)
        except Exception as e:
            self._fs.delete(temp, False)
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                raise Conflict(f"{rel} was written by someone else") from e
            raise

    def delete(self, rel: str) -> None:
        self._fs.delete(self._path(rel), True)
