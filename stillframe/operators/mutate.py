"""Deletions, retention, compaction, repair: a commit first, then the files."""

from __future__ import annotations

import time
import uuid
from itertools import accumulate

from pyspark.sql import functions as F

from ..errors import InvalidArgument, NotFound
from ..manifest import Snapshot, State
from .ingest import ROWS_PER_FILE, lookup, read_points, writer

DAY_MS = 86_400_000
PACKED = "packed/"
KEYS_PER_FILE = 5_000_000


def _pack(table, snaps: list[Snapshot]) -> list[Snapshot]:
    """Write one segment's snapshots into one folder, rows by time and point; each file has its share of the rows."""
    snaps = sorted(snaps, key=lambda s: s.ts)
    path = f"{PACKED}day={snaps[0].day}/c={uuid.uuid4().hex}"
    rows = sum(s.rows for s in snaps)
    begin = dict(zip((s.ts for s in snaps), accumulate([0, *(s.rows for s in snaps)]), strict=False))
    part = F.floor((lookup(begin, "ts") + F.col("_place")) / ROWS_PER_FILE).cast("int")
    kept = table.read(snaps).where(F.col("ts").isin([*begin]))  # a folder may hold snapshots that go
    out = kept.repartitionById(-(-rows // ROWS_PER_FILE), part).sortWithinPartitions("ts", "point_id")
    writer(table, out.select("ts", "point_id", "_place", *[f"`{n}`" for n in table.schema.names])).parquet(f"{table.root}/{path}")
    size = table.store.size(f"{table.root}/{path}")
    return [Snapshot(s.ts, s.day, path, s.rows, s.min_id, s.max_id, size * s.rows // rows, s.new_points, s.hash, s.order) for s in snaps]


def _commit(table, state: State, old: set[str], new: list[Snapshot], **actions) -> None:
    """Commit, then delete the folders that no snapshot names any more; a lost commit takes back what was written."""
    try:
        table.manifest.commit(state, add=new, **actions)
    except Exception:
        for p in {s.path for s in new}:
            table.store.delete(f"{table.root}/{p}")
        raise
    for p in old:
        table.store.delete(f"{table.root}/{p}")


def _drop(table, state: State, times: list[int]) -> None:
    """Forget snapshots; what shares a folder with them is written anew without them."""
    gone = set(times)
    paths = {state.snapshots[ts].path for ts in times}
    days: dict[str, list[Snapshot]] = {}
    for s in state.snapshots.values():
        if s.path in paths and s.ts not in gone:
            days.setdefault(s.path, []).append(s)
    kept = [s for rest in days.values() for s in _pack(table, rest)]
    _commit(table, state, paths, kept, remove=times)


def delete_snapshot(table, ts: int, confirm: bool = False) -> None:
    """Forget one snapshot; its content can be imported again, and points keep their ids."""
    if not confirm:
        raise InvalidArgument("deleting needs confirm=True")

    def attempt(state: State) -> None:
        if ts not in state.snapshots:
            raise NotFound(f"no snapshot at {ts}")
        _drop(table, state, [ts])

    with table.lock:
        table.manifest.retry(attempt)


def delete_segment(table, day: str, confirm: bool = False) -> int:
    """Forget a segment (YYYY-MM-DD, or its path `data/day=...`); returns its number of snapshots."""
    if not confirm:
        raise InvalidArgument("deleting needs confirm=True")
    day = str(day).removeprefix("data/").removeprefix("day=")

    def attempt(state: State) -> int:
        times = [s.ts for s in state.snapshots.values() if s.day == day]
        if not times:
            raise NotFound(f"no segment {day}")
        _drop(table, state, times)
        return len(times)

    with table.lock:
        return table.manifest.retry(attempt)


def clean_retention(table, now: int | None = None) -> int:
    """Delete whole segments whose last snapshot is before now - retention; one across the line stays whole."""
    now = int(time.time() * 1000) if now is None else now

    def attempt(state: State) -> int:
        old = [d for d in state.days().values() if d[-1].ts < now - table.schema.retention_days * DAY_MS]
        if old:
            _drop(table, state, [s.ts for d in old for s in d])
        return len(old)

    with table.lock:
        return table.manifest.retry(attempt)


def compact(table, day: str | None = None) -> int:
    """One folder for each segment that has several (or for the named one), and one for the key dictionary.

    Returns the number of segments rewritten. A reader that planned on the old folders has to plan again.
    """

    def attempt(state: State) -> int:
        todo = {d: s for d, s in state.days().items() if len({x.path for x in s}) > 1 and day in (None, d)}
        made, old = [], {s.path for d in todo.values() for s in d}
        for snaps in todo.values():
            made += _pack(table, snaps)
        only = None
        if len(state.points) > 1:
            only = [f"points/c={uuid.uuid4().hex}"]
            files = -(-state.max_point // KEYS_PER_FILE)
            keys = read_points(table, state)
            keys = keys.coalesce(1) if files <= 1 else keys.repartitionByRange(files, "_key")
            keys.sortWithinPartitions("_key").write.parquet(f"{table.root}/{only[0]}")
            old |= set(state.points)
        if made or only:
            _commit(table, state, old, made, only_points=only)
        return len(todo)

    with table.lock:
        return table.manifest.retry(attempt)


def _strays(table, state: State) -> list[str]:
    """Folders that no committed snapshot or dictionary names."""
    live = {s.path for s in state.snapshots.values()} | set(state.points)
    found = [f"points/{f}" for f, _, _ in table.store.listing(f"{table.root}/points")]
    for top, depth in (("data", 3), ("packed", 2)):
        level = [top]
        for _ in range(depth):
            level = [f"{p}/{n}" for p in level for n, is_dir, _ in table.store.listing(f"{table.root}/{p}") if is_dir and "=" in n]
        found += level
    return [p for p in found if p not in live]


def _unreadable(table, state: State) -> list[Snapshot]:
    """Snapshots whose files are gone or do not hold their rows: one job over all, one each only if that fails."""
    there = {p: table.store.exists(f"{table.root}/{p}") for p in {s.path for s in state.snapshots.values()}}
    snaps = [s for s in state.snapshots.values() if there[s.path]]

    def counts(some: list[Snapshot]) -> dict[int, int]:
        try:
            # every page is read, not the files' row counts alone
            return {r["ts"]: r["n"] for r in table.read(some).groupBy("ts").agg(F.count("*").alias("n"), F.max(F.xxhash64(*[f"`{n}`" for n in table.schema.names]))).collect()}  # a row per snapshot
        except Exception:
            if len({s.path for s in some}) == 1:
                return {}
            return {k: v for p in {s.path for s in some} for k, v in counts([s for s in some if s.path == p]).items()}

    found = counts(snaps) if snaps else {}
    return [s for s in state.snapshots.values() if found.get(s.ts) != s.rows]


def repair(table, grace_ms: int = 3_600_000) -> dict[str, int]:
    """Reconcile log and files: uncommitted folders go once nothing in them is younger than grace_ms (before that
    another writer may be about to commit them); snapshots whose files are missing or unreadable are taken out, what is
    left of them moves to `_quarantine`."""
    counts = {"removed": 0, "quarantined": 0, "waiting": 0}

    def attempt(state: State) -> dict[str, int]:
        for p in _strays(table, state):
            if grace_ms and table.store.newest(f"{table.root}/{p}") > time.time() * 1000 - grace_ms:
                counts["waiting"] += 1
                continue
            table.store.delete(f"{table.root}/{p}")
            counts["removed"] += 1
        if bad := _unreadable(table, state):
            table.manifest.commit(state, remove=[s.ts for s in bad])
            live = {s.path for s in state.snapshots.values() if s not in bad}
            for p in {s.path for s in bad} - live:
                if table.store.exists(f"{table.root}/{p}"):
                    table.store.move(f"{table.root}/{p}", f"{table.root}/_quarantine/{p}")
            counts["quarantined"] += len(bad)
        return counts

    with table.lock:
        return table.manifest.retry(attempt)
