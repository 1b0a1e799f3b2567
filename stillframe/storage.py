"""Small files and folders through Hadoop's file systems.

The log needs a store where a file appears whole and only if it is absent: local files (by hard link) and file systems
whose rename is atomic and never replaces a file. Others, object stores with plain puts among them, are refused.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession

from .errors import CommitConflict, StorageError

#: Schemes of file systems with an atomic rename that fails where the target exists.
RENAMING = ("hdfs", "viewfs", "webhdfs", "swebhdfs", "ofs", "abfs", "abfss")


class Store:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm = spark._jvm

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self, p: str):
        return self._path(p).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, p: str) -> bool:
        return self._fs(p).exists(self._path(p))

    def listing(self, p: str) -> list[tuple[str, bool, int]]:
        """(name, is a folder, size) of what is in a folder; nothing if it is missing."""
        if not self.exists(p):
            return []
        return sorted((s.getPath().getName(), s.isDirectory(), s.getLen()) for s in self._fs(p).listStatus(self._path(p)))

    def size(self, p: str) -> int:
        return self._fs(p).getContentSummary(self._path(p)).getLength() if self.exists(p) else 0

    def newest(self, p: str) -> int:
        """The latest modification time under a folder, in epoch milliseconds."""
        out, files = self._fs(p).getFileStatus(self._path(p)).getModificationTime(), self._fs(p).listFiles(self._path(p), True)
        while files.hasNext():
            out = max(out, files.next().getModificationTime())
        return out

    def delete(self, p: str) -> None:
        self._fs(p).delete(self._path(p), True)

    def move(self, a: str, b: str) -> None:
        self._fs(b).mkdirs(self._path(b).getParent())
        self._fs(a).rename(self._path(a), self._path(b))

    def read_json(self, p: str) -> dict:
        stream = self._fs(p).open(self._path(p))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put_json(self, p: str, value: dict) -> None:
        """Create the file whole, or raise CommitConflict if it is there already."""
        text = json.dumps(value, separators=(",", ":"))
        uri = self._path(p).toUri()
        if self._fs(p).getScheme() == "file":  # a hard link appears at once and never replaces a file
            path = uri.getPath()
            os.makedirs(os.path.dirname(path), exist_ok=True)
            temp = f"{path}.{uuid.uuid4().hex}.tmp"
            with open(temp, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(temp, path)
            except FileExistsError:
                raise CommitConflict(p) from None
            finally:
                os.unlink(temp)
            return
        if (scheme := self._fs(p).getScheme()) not in RENAMING:
            raise StorageError(f"{scheme}: has no atomic create that this log could use")
        temp = f"{p}.{uuid.uuid4().hex}.tmp"
        stream = self._fs(p).create(self._path(temp), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            done = not self.exists(p) and self._fs(p).rename(self._path(temp), self._path(p))
        except Exception:
            done = False
        if not done:
            self.delete(temp)
            if self.exists(p):
                raise CommitConflict(p)
            raise StorageError(f"cannot create {p}")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; a local one only where that is unset and executors share the machine."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "stillframe-scratch")
    path = f"{root.rstrip('/')}/tables/{spark.sparkContext.applicationId}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path
