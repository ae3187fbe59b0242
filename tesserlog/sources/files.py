"""Files on any file system that Spark reads, through its own file-system layer."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


class Files:
    """Small files and folders: settings, models, watermarks, uploads. Tables go through Spark's readers and writers."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def uri(self, path: str) -> str:
        """The path with its file system."""
        fs, p = self._at(path)
        return fs.makeQualified(p).toString()

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make_folder(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none where there is no folder."""
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        """Bytes of a file, or of all files below a folder; 0 where there is none."""
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def rename(self, path: str, to: str) -> bool:
        fs, p = self._at(path)
        return fs.rename(p, self._jvm.org.apache.hadoop.fs.Path(to))

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Write a file whole: to a hidden one, which then takes the place of the old in one rename that overwrites."""
        fs, p = self._at(path)
        hidden = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{os.urandom(6).hex()}")
        stream = fs.create(hidden, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(kinds, 1)
        options[0] = kinds.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), self._conf).rename(fs.makeQualified(hidden), fs.makeQualified(p), options)

    def upload(self, local: str, path: str, force: bool = False) -> str:
        """Copy a local file; says what was done: uploaded, present (and left alone) or missing."""
        if not os.path.exists(local):
            return "missing"
        fs, p = self._at(path)
        if fs.exists(p) and not force:
            return "present"
        part = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.part")
        fs.copyFromLocalFile(False, True, self._jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(local)}"), part)
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(part, p)  # a copy that broke off is never taken for the file
        return "uploaded"

    def download(self, path: str, local: str) -> None:
        fs, p = self._at(path)
        fs.copyToLocalFile(False, p, self._jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(local)}"), True)

    def upload_all(self, folder: str, into: str, names: tuple[str, ...], force: bool = False) -> dict[str, str]:
        return {n: self.upload(os.path.join(folder, n), f"{into}/{n}", force) for n in names}

    def lay_out(self, base: str, folders: tuple[str, ...]) -> None:
        for f in folders:
            self.make_folder(f"{base}/{f}")
