"""Files in any store that Spark knows (local, HDFS, object stores), by Hadoop's file system interface."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


class Store:
    """Small jobs of the driver on files; tables go through Spark's readers and writers."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def make_folder(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def rename(self, path: str, target: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(self._at(target)[1].getParent())
        if not fs.rename(p, self._at(target)[1]):
            raise OSError(f"{path} could not be renamed to {target}")

    def copy(self, path: str, target: str) -> None:
        fs, p = self._at(path)
        to, t = self._at(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, t, False, True, self.conf)

    def files(self, path: str) -> list[str]:
        """All files below a folder by their paths relative to it, sorted."""
        fs, p = self._at(path)
        top, out = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/", []
        each = fs.listFiles(p, True)
        while each.hasNext():
            out.append(each.next().getPath().toUri().getPath().removeprefix(top))
        return sorted(out)

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def join(self, head: bytes, parts: Iterable[str], target: str) -> None:
        """One file of head and then all parts, streamed."""
        fs, p = self._at(target)
        out = fs.create(p, True)
        try:
            out.write(bytearray(head))
            for part in parts:
                source, at = self._at(part)
                stream = source.open(at)
                try:
                    self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 65536, False)
                finally:
                    stream.close()
        finally:
            out.close()

    def zip(self, folder: str, names: Iterable[str], target: str) -> None:
        """These files of a folder as one ZIP archive, streamed."""
        fs, p = self._at(target)
        made = self.jvm.java.util.zip.ZipOutputStream(fs.create(p, True))
        try:
            for name in names:
                source, at = self._at(f"{folder}/{name}")
                made.putNextEntry(self.jvm.java.util.zip.ZipEntry(name))
                stream = source.open(at)
                try:
                    self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, made, 65536, False)
                finally:
                    stream.close()
                made.closeEntry()
        finally:
            made.close()
