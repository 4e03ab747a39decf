"""Small files and folders through Hadoop's file systems, so a table may lie wherever Spark reads."""

from __future__ import annotations

import struct
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from tidemark.errors import Permanent


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file; False when it is there already. The file system's create-if-absent decides between writers."""
        fs, p = self._at(path)
        try:
            stream = fs.create(p, False)
        except Exception as e:  # py4j wraps the file system's exception
            if fs.exists(p):
                return False
            raise e
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def replace(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def footer(self, path: str, guess: int = 1 << 16) -> bytes:
        """A Parquet file's footer, as its Thrift bytes."""
        fs, p = self._at(path)
        size = fs.getFileStatus(p).getLen()

        def last(n: int) -> bytes:
            stream = fs.open(p)
            try:
                stream.seek(max(0, size - n))
                return bytes(stream.readAllBytes())
            finally:
                stream.close()

        end = last(guess)
        if size < 12 or end[-4:] != b"PAR1":
            raise Permanent(f"not a Parquet file: {path}")
        (length,) = struct.unpack("<I", end[-8:-4])
        if length + 8 > len(end):
            end = last(length + 8)
        return end[-8 - length : -8]

    def footers(self, paths: list[str], threads: int = 16) -> list[bytes]:
        """Each file's footer, read side by side, in the order of the paths."""
        with ThreadPoolExecutor(threads) as pool:
            return list(pool.map(self.footer, paths))

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def list(self, path: str) -> list[tuple[str, int]]:
        """(path, size) of the files directly in a folder; empty when it isn't there."""
        fs, p = self._at(path)
        return [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def folders(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen()

    def parquet(self, path: str) -> list[tuple[str, int]]:
        """Data files of a folder written by Spark, or the file itself."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        if fs.getFileStatus(p).isFile():
            return [(path, self.size(path))]
        return [(f, n) for f, n in self.list(path) if not f.rsplit("/", 1)[-1].startswith(("_", "."))]
