"""Folders on any file system that Spark reads: pointers that switch atomically, listing, deletion.

A table's versions are folders that Spark's own committer wrote; a pointer, a small JSON file, names the live ones. It is
written beside its place and renamed over it, so a reader sees the state before or after. What a switch
makes stale is deleted by the next one: readers of the state before keep their files meanwhile.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(self.at(name))

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> dict:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, state: dict) -> None:
        part = f"{name}.{uuid.uuid4().hex}.part"
        stream = self.fs.create(self._path(part), True)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
            stream.hsync()
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = SparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        context.rename(self.fs.makeQualified(self._path(part)), self.fs.makeQualified(self._path(name)), options)

    def folders(self, name: str) -> list[str]:
        """Names of the folders within a folder, sorted."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name)) if s.isDirectory())

    def files(self, name: str) -> list[tuple[str, int]]:
        """Names and bytes of the files within a folder, sorted."""
        return sorted((s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self._path(name)) if s.isFile())

    def open(self, name: str):  # noqa: ANN201
        """A stream of the JVM."""
        return self.fs.open(self._path(name))

    def stats(self, name: str = "") -> dict[str, int]:
        """files, dirs below, bytes, and allocated bytes: blocks of a local disk, or bytes with all replicas."""
        if not self.exists(name):
            return {"files": 0, "dirs": 0, "bytes": 0, "allocated_bytes": 0}
        s = self.fs.getContentSummary(self._path(name))
        allocated = s.getSpaceConsumed()
        if self.fs.getScheme() == "file":
            top = self._path(name).toUri().getPath()
            allocated = sum(os.stat(p).st_blocks * 512 for d, _, files in os.walk(top) for p in [d, *[os.path.join(d, f) for f in files]])
        return {"files": s.getFileCount(), "dirs": s.getDirectoryCount() - 1, "bytes": s.getLength(), "allocated_bytes": allocated}

    def drop(self, *names: str) -> None:
        for name in names:
            self.fs.delete(self._path(name), True)



def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; a temporary one in a local session that names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillspark-core-")
    return f"{named}/quill-core-{uuid.uuid4().hex}"
