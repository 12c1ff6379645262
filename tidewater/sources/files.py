"""Files: reading tables by format, and the small files of a database through Hadoop's file systems, so
that they work wherever Spark's readers do."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "csv", "json", "text")


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """A file or folder as a DataFrame; the format is that of the name unless given."""
    kind = kind or next((f for f in FORMATS if path.rstrip("/").endswith(f".{f}")), "parquet")
    if kind not in FORMATS:
        raise ValueError(f"format {kind} is not one of {', '.join(FORMATS)}")
    if kind == "csv":
        options = {"header": True} | options
    return spark.read.format(kind).options(**options).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, **options) -> None:
    out = df.write.format(kind).mode(mode).options(**options)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)


class Store:
    """A folder in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, content: str) -> bool:
        """Write a file unless there is one of that name: all of it appears at once, for one writer."""
        target = self._path(name)
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target):
            return False
        part = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(part, False)
        try:
            stream.write(bytearray(content, "utf-8"))
        finally:
            stream.close()
        # FileContext.rename fails where the target exists; on a local disk a hard link does
        if self._fs.getUri().getScheme() == "file":
            files, to_path = self._jvm.java.nio.file.Files, lambda p: self._jvm.java.nio.file.Paths.get(p.toUri())
            qualified = lambda p: self._fs.makeQualified(p)
            try:
                files.createLink(to_path(qualified(target)), to_path(qualified(part)))
                return True
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
            finally:
                self._fs.delete(part, False)
        try:
            none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = none
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf).rename(part, target, options)
            return True
        except Exception as e:
            self._fs.delete(part, False)
            if "AlreadyExists" in str(e):
                return False
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
