"""The facade: an Engine owns a folder of tables; a Table answers queries and takes imports."""

from __future__ import annotations

import functools
import logging
import os
import threading
import time
from collections.abc import Iterator, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import __version__, plans
from .errors import CommitConflict, IngestRejected, InvalidArgument, NotFound, StorageError
from .functions import key_of
from .manifest import Manifest, Snapshot, State
from .operators import ingest as ing
from .operators import mutate
from .schema import TYPES, Column, TableSchema, check_name
from .sources import csv, frame, rows
from .storage import Store

log = logging.getLogger("stillframe")
_MOST = (1 << 63) - 1
#: Of a snapshot read in order.
ROWS_PER_PARTITION = 500_000


def _catalog(version: int) -> str:
    return "_catalog.json" if version == 1 else f"_catalog-{version:06d}.json"


def timed(f):
    """Log and count calls that take longer than the engine's slow_ms; for methods that run their jobs themselves."""

    @functools.wraps(f)
    def call(self, *args, **kwargs):
        began = time.time()
        try:
            return f(self, *args, **kwargs)
        finally:
            if (ms := (time.time() - began) * 1000) > self.engine.slow_ms:
                self.engine.slow_calls += 1
                log.warning("slow: %s of %s took %.0f ms", f.__name__, self.name, ms)

    return call


class Table:
    def __init__(self, engine: Engine, name: str, schema: TableSchema):
        self.engine, self.name, self.schema = engine, name, schema
        self.spark, self.store, self.zone = engine.spark, engine.store, engine.zone
        self.root = f"{engine.root}/{name}"
        self.manifest = Manifest(self.store, self.root)
        self.lock = engine.lock_of(name)

    def shard_of(self, ts: int) -> str:
        """The segment of a time: the local day, hour, or Monday of the week."""
        clock = self.spark._jvm.java.time
        at = clock.Instant.ofEpochMilli(ts).atZone(clock.ZoneId.of(self.zone))
        day = at.toLocalDate()
        if self.schema.shard == "WEEK":
            return day.minusDays(day.getDayOfWeek().getValue() - 1).toString()
        return day.toString() if self.schema.shard == "DAY" else f"{day.toString()}T{at.getHour():02d}"

    # reading

    def _struct(self, packed: bool) -> T.StructType:
        ts, places = [T.StructField("ts", T.LongType())], [T.StructField(n, T.StringType()) for n in ("day", "c")]
        fields = [T.StructField("point_id", T.LongType()), T.StructField("_place", T.LongType())]
        fields += [T.StructField(c.name, TYPES[c.type], c.nullable) for c in self.schema.columns]
        return T.StructType(ts + fields + places if packed else fields + [places[0], *ts, places[1]])

    def read(self, snaps: list[Snapshot], start: int | None = None, end: int | None = None) -> DataFrame:
        """T over snapshots: ts, day, point_id, _key, the columns, and _place (0, 1, ... in point order)."""
        loose = [s.path for s in snaps if not s.path.startswith(mutate.PACKED)]
        packed = {s.path: s.ts for s in snaps if s.path.startswith(mutate.PACKED)}
        parts = []
        for paths, base in ((loose, "data"), (sorted(packed), "packed")):
            if paths:
                reader = self.spark.read.schema(self._struct(base == "packed")).option("basePath", f"{self.root}/{base}")
                try:
                    parts.append(reader.parquet(*[f"{self.root}/{p}" for p in paths]))
                except AnalysisException as e:
                    raise StorageError(f"files of {self.name} are missing: {e}") from e
        if packed and start is not None:
            parts[-1] = parts[-1].where(F.col("ts") >= start)
        if packed and end is not None:
            parts[-1] = parts[-1].where(F.col("ts") <= end)
        cols = ["ts", "day", "point_id", key_of(self.schema.pk.name).alias("_key"), *[f"`{n}`" for n in self.schema.names], "_place"]
        if not parts:
            return self.spark.createDataFrame([], self._struct(False)).select(*cols)
        parts = [p.select(*cols) for p in parts]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _picked(self, state: State, start: int | None, end: int | None, point_id: int | None = None) -> list[Snapshot]:
        return sorted((s for s in state.snapshots.values() if (start is None or s.ts >= start) and (end is None or s.ts <= end) and (point_id is None or s.min_id <= point_id <= s.max_id)), key=lambda s: s.ts)

    def frame(self, start: int | None = None, end: int | None = None, point_id: int | None = None) -> DataFrame:
        """T over the committed snapshots with start <= ts <= end, pruned by the log before Spark lists a folder; with a
        point id, by the snapshots' id windows too, and then by the files' statistics."""
        t = self.read(self._picked(self.manifest.load(), start, end, point_id), start, end)
        return t if point_id is None else t.where(F.col("point_id") == point_id)

    def full_snapshot(self, ts: int) -> DataFrame:
        """All rows at exactly ts, in point order. Stored places are dense, so partitions are named by them and sorted
        each: a total order without the sampling pass of a range sort, and without a shuffle where one partition holds all."""
        s = self.manifest.load().snapshots.get(ts)
        if s is None:
            return self.read([])
        t, parts = self.read([s], ts, ts), -(-s.rows // ROWS_PER_PARTITION)
        t = t.coalesce(1) if parts == 1 else t.repartitionById(parts, F.floor(F.col("_place") / ROWS_PER_PARTITION).cast("int"))
        return t.sortWithinPartitions("_place")

    def page(self, ts: int, offset: int = 0, limit: int = 100) -> DataFrame:
        """Rows [max(0, offset), offset + limit) of a snapshot by their stored place: any page reads only its own rows."""
        first = min(max(0, offset), _MOST)
        here = (F.col("_place") >= first) & (F.col("_place") < min(first + max(0, limit), _MOST))
        return self.frame(ts, ts).where(here).orderBy("_place")

    @timed
    def snapshot(self, ts: int, offset: int = 0, limit: int = 100) -> dict:
        """One page: columns (key first), rows, total rows, and the offset and number of rows returned."""
        s, names = self.manifest.load().snapshots.get(ts), self.schema.names
        if s is None or limit <= 0:
            return {"pk": names[0], "columns": names, "rows": [], "timestamp": ts, "total_rows": 0, "offset": 0, "limit": 0}
        got = self.page(ts, offset, limit).select(*[f"`{n}`" for n in names]).collect()
        return {"pk": names[0], "columns": names, "rows": [tuple(r) for r in got], "timestamp": ts, "total_rows": s.rows, "offset": max(0, offset), "limit": len(got)}

    def stream_snapshot(self, ts: int) -> Iterator[tuple]:
        """A whole snapshot's rows one by one, a partition at a time on the driver."""
        for r in self.full_snapshot(ts).select(*[f"`{n}`" for n in self.schema.names]).toLocalIterator():
            yield tuple(r)

    @timed
    def snapshot_frame(self, ts: int) -> bytes:
        """A whole snapshot as one columnar wire frame."""
        return frame.write_frame(self.full_snapshot(ts), self.schema)

    def point_id(self, key, state: State | None = None) -> int | None:
        """The key's number in the dictionary, by a pushed-down look-up; None for a key never seen."""
        text, kind = str(key), self.schema.pk.type
        want = F.lit(text)
        if kind in ("INT", "LONG"):
            if not text.removeprefix("-").isdecimal() or not -_MOST <= int(text) <= _MOST:
                return None
            want = F.lit(int(text)).cast("long")
        elif kind == "DOUBLE" and not isinstance(key, str):
            want = F.lit(float(key)).cast("string")
        got = ing.read_points(self, state or self.manifest.load()).where(F.col("_key") == want).select("point_id").first()
        return got["point_id"] if got is not None else None

    def series(self, key, start: int = 0, end: int = _MOST, limit: int = 1000) -> DataFrame:
        """The key's first `limit` rows with start <= ts <= end, ascending."""
        found = self.point_id(key) if limit > 0 else None
        if found is None:
            return self.read([])
        return self.frame(start, end, found).orderBy("ts").limit(plans._count(limit))

    @timed
    def series_response(self, key, start: int = 0, end: int = _MOST, limit: int = 1000) -> dict:
        """A series as columns (key first), rows, and the rows' timestamps beside them."""
        names = self.schema.names
        got = self.series(key, start, end, limit).select("ts", *[f"`{n}`" for n in names]).collect()
        return {"pk": names[0], "columns": names, "rows": [tuple(r)[1:] for r in got], "timestamps": [r["ts"] for r in got]}

    def point_row(self, key, ts: int) -> DataFrame:
        """The key's row at exactly ts, if any."""
        return self.series(key, ts, ts, 1)

    @timed
    def point_at(self, key, ts: int) -> tuple | None:
        """The key's value columns at exactly ts."""
        got = self.point_row(key, ts).select(*[f"`{n}`" for n in self.schema.names[1:]], F.lit(1)).first()
        return tuple(got)[:-1] if got is not None else None

    def as_of(self, key, ts: int) -> DataFrame:
        """The key's latest row at or before ts: snapshots are asked from the latest back, in blocks of growing size."""
        state = self.manifest.load()
        found = self.point_id(key, state)
        snaps = self._picked(state, None, ts, found)[::-1] if found is not None else []
        at, size = 0, 1
        while at < len(snaps):
            some = snaps[at : at + size]
            got = self.read(some, some[-1].ts, some[0].ts).where(F.col("point_id") == found).orderBy(F.desc("ts")).limit(1)
            if at + size >= len(snaps) or not got.isEmpty():
                return got
            at, size = at + size, size * 16
        return self.read([])

    def latest(self, ts: int) -> DataFrame:
        """The whole snapshot at the last committed time at or before ts, found in the log."""
        times = [t for t in self.manifest.load().snapshots if t <= ts]
        return self.full_snapshot(max(times)) if times else self.read([])

    def as_of_all(self, ts: int) -> DataFrame:
        """Each key's latest row at or before ts."""
        return plans.as_of_all(self.frame(None, ts), ts)

    def diff(self, old: int, new: int) -> DataFrame:
        return plans.diff(self.frame(old, old), self.frame(new, new), self.schema.names[1:] or self.schema.names)

    def aggregate(self, ts: int, column: str) -> DataFrame:
        return plans.aggregate(self.frame(ts, ts), column)

    def export(self, ts: int, path: str, kind: str = "parquet") -> None:
        """Write a snapshot's columns as CSV or Parquet."""
        if kind not in ("csv", "parquet"):
            raise InvalidArgument(f"cannot export {kind!r}")
        out = self.full_snapshot(ts).select(*[f"`{n}`" for n in self.schema.names]).write
        (out.option("header", True).option("escape", '"') if kind == "csv" else out).format(kind).save(path)

    # the log

    def snapshots(self) -> list[int]:
        return sorted(self.manifest.load().snapshots)

    def segments(self) -> list[dict]:
        return [
            {"day": d, "path": f"data/day={d}", "snapshots": len(s), "rows": sum(x.rows for x in s), "min_id": min(x.min_id for x in s), "max_id": max(x.max_id for x in s), "start_time": s[0].ts, "end_time": s[-1].ts, "bytes": sum(x.bytes for x in s)}
            for d, s in sorted(self.manifest.load().days().items())
        ]

    def segments_with(self, key) -> list[dict]:
        """Segments whose id window holds the key's point."""
        found = self.point_id(key)
        return [s for s in self.segments() if found is not None and s["min_id"] <= found <= s["max_id"]]

    def segment_snapshots(self, day: str) -> list[tuple[int, int]]:
        day = str(day).removeprefix("data/").removeprefix("day=")
        found = self.manifest.load().days().get(day)
        if found is None:
            raise NotFound(f"no segment {day}")
        return [(s.ts, s.rows) for s in found]

    def stats(self) -> dict:
        state, segments = self.manifest.load(), self.segments()
        return {"points": state.max_point, "segments": len(segments), "snapshots": len(state.snapshots), "rows": sum(s["rows"] for s in segments), "bytes": sum(s["bytes"] for s in segments)}

    def info(self) -> dict:
        return {"name": self.name, "schema": self.schema.to_json(), "retention_days": self.schema.retention_days, "level": self.schema.level, **self.stats()}

    # changing

    @timed
    def ingest(self, df: DataFrame, ts: int | None = None) -> ing.IngestResult:
        """Import one snapshot; without a time, at now, resolved once."""
        return self.ingest_batch([(int(time.time() * 1000) if ts is None else ts, df)])[0]

    @timed
    def ingest_batch(self, frames: list[tuple[int, DataFrame]]) -> list[ing.IngestResult]:
        """Import snapshots at strictly increasing times in one commit."""
        times = ing.check_times(ts for ts, _ in frames)
        return ing.ingest(self, ing.union_of([df for _, df in frames], self.schema), times)

    @timed
    def ingest_timed(self, df: DataFrame, time_column: str = "ts") -> list[ing.IngestResult]:
        """Import all snapshots of one frame whose rows carry their time in a column, in one commit."""
        self.schema.check_frame(df.drop(time_column))
        return ing.ingest(self, ing.with_snapshot(df, F.col(f"`{time_column}`").cast("long"), self.schema, time_column), None)

    def ingest_columns(self, columns, ts: int | None = None) -> ing.IngestResult:
        """Import column buffers by name."""
        return self.ingest(rows.from_columns(self.spark, self.schema, columns), ts)

    def ingest_rows(self, data: list, ts: int | None = None) -> ing.IngestResult:
        return self.ingest(rows.from_rows(self.spark, self.schema, data), ts)

    def ingest_csv(self, path: str, ts: int | None = None) -> ing.IngestResult:
        return self.ingest(csv.read_csv(self.spark, self.schema, path), ts)

    def ingest_csvs(self, paths: list[str], times: list[int]) -> list[ing.IngestResult]:
        if len(paths) != len(times):
            raise InvalidArgument(f"{len(paths)} files and {len(times)} times")
        return self.ingest_batch([(ts, csv.read_csv(self.spark, self.schema, p)) for p, ts in zip(paths, times, strict=True)])

    def ingest_frame(self, data: bytes, ts: int | None = None) -> ing.IngestResult:
        return self.ingest(frame.read_frame(self.spark, self.schema, data), ts)

    def delete_snapshot(self, ts: int, confirm: bool = False) -> None:
        mutate.delete_snapshot(self, ts, confirm)

    def delete_segment(self, day: str, confirm: bool = False) -> int:
        return mutate.delete_segment(self, day, confirm)

    def clean_retention(self, now: int | None = None) -> int:
        return mutate.clean_retention(self, now)

    def compact(self, day: str | None = None) -> int:
        return mutate.compact(self, day)

    def repair(self, grace_ms: int = 3_600_000) -> dict[str, int]:
        return mutate.repair(self, grace_ms)

    def add_column(self, column: Column) -> None:
        """A new nullable column behind the others, as the next registered schema version; stored rows have null in it."""
        schema = self.schema.plus(column)
        try:
            self.store.put_json(f"{self.root}/{_catalog(schema.version)}", schema.to_json())
        except CommitConflict:
            raise InvalidArgument(f"{self.name} has a schema version {schema.version} already; open it again") from None
        self.schema = schema


class Engine:
    """Tables under a root folder, with one zone for day boundaries."""

    def __init__(self, spark: SparkSession, root: str, zone: str = "UTC", level: int = 3, slow_ms: int = 500):
        self.spark, self.root, self.zone, self.level, self.slow_ms = spark, root.rstrip("/"), zone, level, slow_ms
        self.slow_calls = 0
        self.store = Store(spark)
        self.began = time.time()
        self._locks: dict[str, threading.RLock] = {}
        self._guard = threading.Lock()
        spark.sql(f"SELECT from_utc_timestamp(timestamp '2000-01-01', '{zone.replace(chr(39), '')}')").collect()  # an unknown zone fails here

    @staticmethod
    def from_env(spark: SparkSession, env: Mapping[str, str] = os.environ) -> Engine:
        """Configured by STILLFRAME_ROOT, STILLFRAME_ZONE, STILLFRAME_LEVEL and STILLFRAME_SLOW_MS."""
        try:
            return Engine(spark, env["STILLFRAME_ROOT"], env.get("STILLFRAME_ZONE", "UTC"), int(env.get("STILLFRAME_LEVEL", 3)), int(env.get("STILLFRAME_SLOW_MS", 500)))
        except (KeyError, ValueError) as e:
            raise InvalidArgument(f"environment: {e}") from e

    def lock_of(self, name: str) -> threading.RLock:
        with self._guard:
            return self._locks.setdefault(name, threading.RLock())

    def create_table(self, name: str, columns: list[Column], pk: str, retention_days: int = 1825, level: int | None = None, shard: str = "DAY") -> Table:
        check_name(name)
        schema = TableSchema.create(columns, pk, retention_days, self.level if level is None else level, shard)
        try:
            self.store.put_json(f"{self.root}/{name}/_catalog.json", schema.to_json())
        except CommitConflict:
            raise InvalidArgument(f"table {name} exists") from None
        return Table(self, name, schema)

    def table(self, name: str) -> Table:
        check_name(name)
        if not self.store.exists(f"{self.root}/{name}/_catalog.json"):
            raise NotFound(f"no table {name}")
        found = sorted(n for n, folder, _ in self.store.listing(f"{self.root}/{name}") if not folder and n.startswith("_catalog") and n.endswith(".json"))
        versions = sorted((TableSchema.from_json(self.store.read_json(f"{self.root}/{name}/{n}")) for n in found), key=lambda v: v.version)
        for old, new in zip(versions, versions[1:], strict=False):
            new.check_follows(old)
        return Table(self, name, versions[-1])

    def tables(self) -> list[str]:
        return sorted(n for n, folder, _ in self.store.listing(self.root) if folder and self.store.exists(f"{self.root}/{n}/_catalog.json"))

    def drop_table(self, name: str, confirm: bool = False) -> None:
        if not confirm:
            raise InvalidArgument("dropping needs confirm=True")
        table = self.table(name)
        with table.lock:
            self.store.delete(f"{table.root}/_catalog.json")
            self.store.delete(table.root)

    def clean_all(self, now: int | None = None) -> dict[str, int | str]:
        """Retention over all tables; one that fails does not stop the others."""
        out: dict[str, int | str] = {}
        for name in self.tables():
            try:
                out[name] = self.table(name).clean_retention(now)
            except Exception as e:
                out[name] = f"failed: {e}"
        return out

    def health(self) -> dict:
        probe = f"{self.root}/_probe-{time.time_ns()}.json"
        try:
            self.store.put_json(probe, {})
            self.store.delete(probe)
            writable = True
        except Exception:
            writable = False
        return {"status": "UP" if writable else "DOWN", "version": __version__, "tables": len(self.tables()), "writable": writable, "uptime_s": int(time.time() - self.began)}

    def metrics(self) -> str:
        """Rows, segments, snapshots, points and bytes of each table, and slow calls, as Prometheus text."""
        lines = [f"stillframe_slow_calls {self.slow_calls}"]
        for name in self.tables():
            lines += [f'stillframe_{k}{{table="{name}"}} {v}' for k, v in self.table(name).stats().items()]
        return "\n".join([*lines, ""])


__all__ = ["Column", "Engine", "IngestRejected", "Table"]
