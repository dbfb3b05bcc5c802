"""Small files of an index, on any file system that Spark reads (local, HDFS, object stores)."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.conf)
        if fs.getUri().getScheme() == "file":
            fs = fs.getRawFileSystem()  # without files of checksums beside each
        return fs, p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make(self, folder: str) -> None:
        fs, p = self._at(folder)
        fs.mkdirs(p)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted, without hidden ones; an absent folder has none."""
        fs, p = self._at(folder)
        if not fs.exists(p):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n[0] not in "._")

    def is_folder(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Replaces the file in one step: whoever reads sees the old text or the new."""
        folder, _, name = path.rpartition("/")
        part = f"{folder}/.{name}-{uuid.uuid4().hex}"
        fs, p = self._at(part)
        out = fs.create(p, True)
        out.write(text.encode("utf-8"))
        out.hsync()
        out.close()
        self.rename(part, path)

    def rename(self, old: str, new: str) -> None:
        fs, a = self._at(old)
        _, b = self._at(new)
        if fs.getUri().getScheme() == "file":
            if not fs.rename(a, b):
                raise OSError(f"{old} can't be renamed to {new}")
            return
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), self.conf).rename(a, b, options)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
