"""Small files in a shared folder of any file system that Spark reaches, created whole and never twice."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new folder in the one named in spark.checkpoint.dir; a local one only where all of Spark is on this machine."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Folder:
    def __init__(self, spark: SparkSession, uri: str):
        self.uri = uri.rstrip("/")
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.uri).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._new(self.uri))
        self._read = spark._jvm.org.apache.commons.io.IOUtils

    def path(self, name: str):
        return self._new(f"{self.uri}/{name}")

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder below, ascending; nothing where there is none."""
        place = self.path(name) if name else self._new(self.uri)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return bytes(self._read.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Creates a file with its text at once; False, and nothing is changed, where there is one of its name."""
        own = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}"
        out = self._fs.create(self.path(own), False)
        out.write(bytearray(text.encode()))
        out.close()
        place = self._fs.resolvePath(self.path(own)).toUri()
        try:
            if (place.getScheme() or "file") == "file":  # a rename would replace the file; a link doesn't
                here = unquote(urlparse(place.toString()).path)
                try:
                    os.link(here, f"{os.path.dirname(here)}/{os.path.basename(name)}")
                except FileExistsError:
                    return False
                return True
            return bool(self._fs.rename(self.path(own), self.path(name)))
        finally:
            self._fs.delete(self.path(own), False)
