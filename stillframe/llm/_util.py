"""Shared helpers: shipping the package to executors, scratch tables, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that workers import it wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="stillframe-"), f"{top.name}_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(Path(top.name) / p.relative_to(top)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of this session where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = os.path.join(tempfile.gettempdir(), "stillframe-scratch")
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Written tables under spark.checkpoint.dir that cut lineage; the folder goes when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/stillframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        self._fs(self.root).deleteOnExit(self._path(self.root))
        self.n = 0

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self, p: str):
        return self._path(p).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def new_path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{label}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        """Write df and read it back: its lineage ends here, and a lost executor costs nothing already written."""
        path = self.new_path(label)
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        for f in {os.path.dirname(p) for p in df.inputFiles()}:
            if f.startswith(("file:", "hdfs:", "/")) and "/stillframe/" in f:
                self._fs(f).delete(self._path(f), True)

    def clear(self) -> None:
        self._fs(self.root).delete(self._path(self.root), True)


_OWNER: list = [None, None]  # of this worker's caches: an operator's name, and what frees them


def claim(name: str, release: Callable[[], object]) -> None:
    """Called by an operator at the start of a task: caches that another operator left in this worker process, from an
    earlier stage, are freed, and memory that is free by now goes back to the system."""
    if _OWNER[0] not in (None, name):
        _OWNER[1]()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)
    _OWNER[:] = [name, release]


def bound_batches(spark: SparkSession, max_bytes: int = 4 << 20) -> None:
    """From now on the session sends Python workers Arrow batches of about max_bytes (one row at least), where it has
    Spark's own default. An executor holds each batch outside its heap and the worker again, so long texts weigh twice."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, f"{max_bytes}b")


def kept_names(keep: tuple[str, ...], outputs: tuple[str, ...]) -> list[str]:
    """Names under which kept columns appear in a result: their own, with `_in` appended while an output has it."""
    taken, names = {x.lower() for x in outputs} | {"__text"}, []
    for c in keep:
        name = c
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        names.append(name)
    return names


def kept(df: DataFrame, keep: tuple[str, ...], outputs: tuple[str, ...]) -> tuple[list[Column], list[str], str]:
    """The kept columns under those names, the names, and their DDL (with a closing comma)."""
    names = kept_names(keep, outputs)
    ddl = "".join(f"`{n}` {df.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))
    return [F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)], names, ddl


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod, F.lit(0)).cast("int")


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The column's UTF-8 bytes; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about max_bytes of the named text column at most (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(name))
        size = col.nbytes
        step = max(1, int(batch.num_rows * max_bytes / max(size, 1)))
        if step >= batch.num_rows:
            yield batch
            continue
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)
