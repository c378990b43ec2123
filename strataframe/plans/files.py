"""A store's folder in any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession

from strataframe.model import Code, StoreError


class Files:
    """Small files by name under a root: written whole under a temporary name and renamed, the one commit step."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.path(f"{self.root}/{name}")

    def names(self, folder: str) -> dict[str, int]:
        """Sizes by name."""
        at = self.at(folder)
        return {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(at)} if self.fs.exists(at) else {}

    def ages(self, folder: str) -> dict[str, float]:
        """Seconds since the last change by name, by this machine's clock."""
        at, now = self.at(folder), self.jvm.java.lang.System.currentTimeMillis()
        return {s.getPath().getName(): (now - s.getModificationTime()) / 1000 for s in self.fs.listStatus(at)} if self.fs.exists(at) else {}

    def read(self, name: str) -> bytes:
        f = self.fs.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(f))
        finally:
            f.close()

    def write(self, name: str, data: bytes, new: bool = False) -> None:
        """new: an error where the name is taken, as another writer has then committed."""
        if new and self.fs.exists(self.at(name)):
            raise StoreError(Code.IO_ERROR, f"{name} is there already: another writer has committed")
        temporary = self.at(f"{name}.tmp")
        f = self.fs.create(temporary, True)
        f.write(bytearray(data))
        f.hsync() if hasattr(f, "hsync") else None
        f.close()
        if not self.fs.rename(temporary, self.at(name)):
            raise StoreError(Code.IO_ERROR, f"{name} can't be renamed into place")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)
