"""Small files on whatever file system a path names, by Hadoop's client on the driver."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def entries(self, path: str) -> list[tuple[str, int]]:
        """Names and bytes."""
        fs, p = self._at(path)
        return sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def is_file(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isFile()

    def age(self, path: str) -> float | None:
        """Seconds since it was last changed; None if there is none."""
        fs, p = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000 if fs.exists(p) else None

    def touch(self, path: str) -> None:
        """Changed now, without being written."""
        fs, p = self._at(path)
        fs.setTimes(p, int(time.time() * 1000), -1)

    def move(self, path: str, to: str) -> bool:
        """Under a new name, at once or not at all; False if it has gone."""
        fs, p = self._at(path)
        try:
            return fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(to))
        except Exception:
            if fs.exists(p):
                raise
            return False

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def make_folder(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def create(self, path: str, text: str) -> bool:
        """Writes a new file; False if it exists already."""
        fs, p = self._at(path)
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def publish(self, path: str, text: str) -> None:
        """The file appears whole or not at all."""
        fs, p = self._at(path)
        tmp = self.jvm.org.apache.hadoop.fs.Path(path + ".tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(p) or not fs.rename(tmp, p):
            raise OSError(f"{path} exists")

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, parts: Iterable[str]) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            for part in parts:
                out.write(bytearray(part.encode()))
        finally:
            out.close()
