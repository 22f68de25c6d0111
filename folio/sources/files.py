"""Small files by way of Hadoop's file systems, so that any path Spark can read works."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import SparkSession


class Files:
    """Reads, writes and renames whole small files on the driver."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        """False only for what is not there; every other error is raised."""
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Writes beside the path and moves over it: a reader sees the old file or the new one.

        The move replaces the target in one step where the file system can
        (HDFS, local); on object stores it is as safe as their rename is.
        """
        fs, p = self._at(path)
        beside = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid4().hex}.new")
        stream = fs.create(beside, True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options
        overwrite = self._spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = options.Rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self._conf)
        context.rename(fs.makeQualified(beside), fs.makeQualified(p), overwrite)

    def copy(self, source: str, target: str) -> bool:
        """Copies a file unless the target is there; whether it did. Of two copies at once one wins."""
        (fs_a, a), (fs_b, b) = self._at(source), self._at(target)
        if fs_b.exists(b):
            return False
        fs_b.mkdirs(b.getParent())
        beside = self._jvm.org.apache.hadoop.fs.Path(b.getParent(), f".{b.getName()}.{uuid4().hex}.new")
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs_a, a, fs_b, beside, False, True, self._conf)
        if fs_b.exists(b) or not fs_b.rename(beside, b):
            fs_b.delete(beside, False)
            if not fs_b.exists(b):
                raise OSError(f"{target} could not be put in place")
            return False
        return True

    def list(self, path: str) -> list[str]:
        """What is in a folder, in order of name."""
        fs, p = self._at(path)
        return sorted(str(x.getPath().toString()) for x in fs.listStatus(p))

    def move(self, source: str, target: str) -> None:
        """Moves a file to where there is none, within a file system."""
        fs, p = self._at(target)
        fs.mkdirs(p.getParent())
        if not fs.rename(self._jvm.org.apache.hadoop.fs.Path(source), p):
            raise OSError(f"{source} could not be moved to {target}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
