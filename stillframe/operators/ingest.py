"""The import pipeline: one pass that checks, hashes and looks up ids, ids for new keys, one write, one commit."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IngestRejected, InvalidArgument
from ..functions import is_blank, join_key, place_digest, row_digest
from ..manifest import Snapshot, State
from ..schema import TableSchema
from .numbering import numbered, place_in_partition

ROWS_PER_FILE = 2_000_000


def points_schema(schema: TableSchema) -> T.StructType:
    """The dictionary's rows; keys are whole numbers where the table's are."""
    key = T.LongType() if schema.pk.type in ("INT", "LONG") else T.StringType()
    return T.StructType([T.StructField("_key", key), T.StructField("point_id", T.LongType())])


@dataclass(frozen=True)
class IngestResult:
    ts: int
    rows: int
    new_points: int
    replayed: bool = False


@dataclass(frozen=True)
class Survey:
    """What one pass finds out about a snapshot: size, content, and the ids of its known keys."""

    number: int  # its _s
    rows: int
    hash: str
    order: str
    fresh: int
    lo: int | None
    hi: int | None


def union_of(frames: list[DataFrame], schema: TableSchema) -> DataFrame:
    """The batch as one frame with _s, _key and _row_no (null where a frame has no order; its order is then its keys').

    _s is the snapshot's number in the batch, not its time: plans of later imports are then the same code, compiled once."""
    out = None
    for k, df in enumerate(frames):
        schema.check_frame(df)
        df = with_snapshot(df, F.lit(k).cast("long"), schema)
        out = df if out is None else out.unionByName(df)
    return out


def with_snapshot(df: DataFrame, number: Column, schema: TableSchema, skip: str | None = None) -> DataFrame:
    """The schema's columns (by position, without skip), _s, _key and _row_no."""
    own = [c for c in df.columns if c not in ("_row_no", skip)]
    row_no = F.col("_row_no").cast("long") if "_row_no" in df.columns else F.lit(None).cast("long")
    df = df.select(number.alias("_s"), row_no.alias("_row_no"), *[F.col(f"`{c}`").alias(s.name) for c, s in zip(own, schema.columns, strict=True)])
    return df.withColumn("_key", join_key(schema.pk.name, schema.pk.type))


def read_points(table, state: State) -> DataFrame:
    """The dictionary (_key, point_id) of a state."""
    if not state.points:
        return table.spark.createDataFrame([], points_schema(table.schema))
    return table.spark.read.schema(points_schema(table.schema)).parquet(*[f"{table.root}/{p}" for p in state.points])


def _digests(schema: TableSchema) -> list[Column]:
    return [row_digest([(c.name, c.type) for c in schema.columns], k).alias(f"_h{k}") for k in (1, 2)]


def _sums(name: str) -> list[Column]:
    """The exact sum of 64-bit hashes by three plain sums of bits that no number of rows overflows."""
    h, low = F.col(name), F.lit((1 << 22) - 1).cast("long")
    return [F.sum(h.bitwiseAND(low)).alias(f"{name}0"), F.sum(F.shiftright(h, 22).bitwiseAND(low)).alias(f"{name}1"), F.sum(F.shiftright(h, 44)).alias(f"{name}2")]


def _sum_of(row, name: str) -> int:
    return int(row[f"{name}0"]) + (int(row[f"{name}1"]) << 22) + (int(row[f"{name}2"]) << 44)


def survey(batch: DataFrame, schema: TableSchema) -> dict[int | None, Survey]:
    """Check all snapshots of a batch (with point_id, null for new keys) in one pass, or reject it; by _s.

    Rows are folded by (_s, key) first, narrow and map-side combined, which also finds repeated keys; then by _s.
    """
    must = [c.name for c in schema.columns if not c.nullable]
    bad = F.coalesce(*[F.when(F.col(f"`{n}`").isNull(), k) for k, n in enumerate(must)])
    flat = batch.select("_s", "_key", "_row_no", "point_id", bad.alias("_bad"), *_digests(schema))
    per_key = flat.groupBy("_s", "_key").agg(F.count("*").alias("_n"), F.min("_row_no").alias("_row_no"), F.max("point_id").alias("point_id"), F.min("_bad").alias("_bad"), F.max("_h1").alias("_h1"), F.max("_h2").alias("_h2"))
    place = place_digest("_key")
    found = per_key.groupBy("_s").agg(
        F.sum("_n").alias("rows"), F.count("*").alias("keys"), F.count_if(is_blank(F.col("_key"), schema.pk.type)).alias("blank"), F.min("_bad").alias("bad"),
        *_sums("_h1"), *_sums("_h2"),
        F.min("_row_no").alias("first"), F.sum(place).alias("places"), F.sum((place.cast("decimal(10,0)") * F.col("_row_no").cast("decimal(19,0)")).cast("decimal(38,0)")).alias("moment"),
        F.count_if(F.col("point_id").isNull()).alias("fresh"), F.min("point_id").alias("lo"), F.max("point_id").alias("hi"),
    ).collect()  # fmt: skip  # a row per snapshot of the batch
    out = {}
    for r in found:
        if r["bad"] is not None:
            raise IngestRejected(f"column {must[r['bad']]} has nulls in snapshot {r['_s']}")
        if r["blank"]:
            raise IngestRejected(f"{r['blank']} blank keys in snapshot {r['_s']}")
        if r["keys"] != r["rows"]:
            raise IngestRejected(f"duplicate keys in snapshot {r['_s']}")
        order = "" if r["first"] is None else str(int(r["moment"]) - r["first"] * int(r["places"]))
        out[r["_s"]] = Survey(r["_s"], r["rows"], f"{r['rows']}:{_sum_of(r, '_h1')}:{_sum_of(r, '_h2')}", order, r["fresh"], r["lo"], r["hi"])
    return out


def same_content(a: Snapshot, b: Survey) -> bool:
    """Equal rows; in equal order too where both came with one."""
    return a.hash == b.hash and (not a.order or not b.order or a.order == b.order)


def add_points(table, state: State, batch: DataFrame, most: int, commit: str) -> tuple[DataFrame, str, int]:
    """Number the keys not seen before, by first appearance in the batch (snapshot, row, key); never reused.

    Returns them as stored, their folder, and the largest id."""
    pk = f"`{table.schema.pk.name}`"
    first = batch.where("point_id is null").groupBy("_key").agg(F.min(F.struct("_s", F.coalesce("_row_no", F.lit(-1)).alias("n"), F.col(pk).alias("k"))).alias("f"))
    new = first.select("_key", "f._s", "f.n", "f.k")
    stage, folder = f"{table.root}/points/stage={commit}", f"points/c={commit}"
    numbered(new, ["_s", "n", "k"], state.max_point, most, "point_id", stage).select("_key", "point_id").sortWithinPartitions("_key").write.parquet(f"{table.root}/{folder}")
    table.store.delete(stage)
    fresh = table.spark.read.schema(points_schema(table.schema)).parquet(f"{table.root}/{folder}")
    top = fresh.agg(F.max("point_id")).first()[0]
    return fresh, folder, top


def ingest(table, batch: DataFrame, times: list[int] | None) -> list[IngestResult]:
    """Import the snapshots of a batch; all become visible in one commit, or none.

    A snapshot whose time and content are committed already is answered from the log; other content at a committed
    time is rejected, however often it is tried. Results follow times (the batch's own, ascending, where None).
    """

    def attempt(state: State) -> list[IngestResult]:
        known = read_points(table, state).select("_key", "point_id") if state.points else None
        joined = batch.join(known, "_key", "left") if known is not None else batch.withColumn("point_id", F.lit(None).cast("long"))
        found = survey(joined, table.schema)
        if times is None and (None in found or any(ts < 0 for ts in found)):
            raise InvalidArgument("times are epoch milliseconds")
        asked = sorted(found) if times is None else times
        if not asked or times is not None and len(found) < len(times):
            raise IngestRejected("a snapshot of the batch has no rows")
        info = {ts: found[ts if times is None else k] for k, ts in enumerate(asked)}
        old = {ts: state.snapshots[ts] for ts in asked if ts in state.snapshots}
        for ts, s in old.items():
            if not same_content(s, info[ts]):
                raise IngestRejected(f"another snapshot is stored at {ts}")
        todo = {ts: info[ts] for ts in asked if ts not in old}
        made = _write(table, state, joined.where(F.col("_s").isin([s.number for s in todo.values()])) if old else joined, todo) if todo else {}
        return [IngestResult(ts, old[ts].rows, old[ts].new_points, True) if ts in old else IngestResult(ts, made[ts].rows, made[ts].new_points) for ts in asked]

    with table.lock:
        return table.manifest.retry(attempt)


def check_times(times: Iterable[int]) -> list[int]:
    times = list(times)
    if not times:
        raise InvalidArgument("an import has a snapshot at least")
    if any(not isinstance(ts, int) or isinstance(ts, bool) or ts < 0 for ts in times):
        raise InvalidArgument("times are epoch milliseconds")
    if any(a >= b for a, b in zip(times, times[1:], strict=False)):
        raise InvalidArgument("times have to increase strictly")
    return times


def writer(table, df: DataFrame):
    """Files of a snapshot: zstd, and page encodings of format version 2, whose deltas suit sorted ids and row numbers."""
    out = df.write.mode("append").option("compression", "zstd").option("parquet.compression.codec.zstd.level", table.schema.level).option("parquet.writer.version", "v2")
    return out.option("parquet.enable.dictionary#point_id", "false").option("parquet.enable.dictionary#_place", "false")


def lookup(values: dict[int, object], key: str) -> Column:
    """values[key] for a few values known on the driver."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k).cast("long"), F.lit(v))])[F.col(key).cast("long")]


def _write(table, state: State, batch: DataFrame, todo: dict[int, Survey]) -> dict[int, Snapshot]:
    commit = uuid.uuid4().hex
    schema: TableSchema = table.schema
    folders, top, new_points, window = [], state.max_point, dict.fromkeys(todo, 0), {ts: (s.lo, s.hi) for ts, s in todo.items()}
    if most := sum(s.fresh for s in todo.values()):
        by_number = {s.number: ts for ts, s in todo.items()}
        fresh, folder, top = add_points(table, state, batch, most, commit)
        folders = [folder]
        unseen = batch.where("point_id is null").groupBy("_key").agg(F.min("_s").alias("_s"))
        batch = batch.join(fresh.withColumnRenamed("point_id", "_new"), "_key", "left").withColumn("point_id", F.coalesce("point_id", "_new")).drop("_new")
        if len(todo) == 1:
            (ts, s), first = *todo.items(), state.max_point + 1
            new_points[ts], window[ts] = top - state.max_point, (min(first, s.lo or first), top)
        else:  # a row per snapshot of the batch, twice
            new_points |= {by_number[r["_s"]]: r["n"] for r in unseen.groupBy("_s").agg(F.count("*").alias("n")).collect()}
            window = {by_number[r["_s"]]: (r["lo"], r["hi"]) for r in batch.groupBy("_s").agg(F.min("point_id").alias("lo"), F.max("point_id").alias("hi")).collect()}
    # each file holds a range of one snapshot's ids: partitions are named, not sampled or hashed
    files = {ts: -(-s.rows // ROWS_PER_FILE) for ts, s in todo.items()}
    first, at = {}, 0
    for ts, s in todo.items():
        first[s.number], at = at, at + files[ts]
    part = lookup(first, "_s") if len(todo) > 1 else F.lit(0)
    before = F.lit(0)
    if at > len(todo):
        low = lookup({s.number: window[ts][0] for ts, s in todo.items()}, "_s")
        width = lookup({s.number: -(-(window[ts][1] - window[ts][0] + 1) // files[ts]) for ts, s in todo.items()}, "_s")
        part = part + F.floor((F.col("point_id") - low) / width)
    batch = batch.withColumn("_part", part.cast("int"))
    if at > len(todo):  # rows in a snapshot's earlier files
        counts = {r["_part"]: r["n"] for r in batch.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row per file
        before = lookup({first[s.number] + k: sum(counts.get(first[s.number] + j, 0) for j in range(k)) for ts, s in todo.items() for k in range(files[ts])}, "_part")
    days = {ts: table.shard_of(ts) for ts in todo}
    cols = ["point_id", (before + place_in_partition()).cast("long").alias("_place"), *[f"`{n}`" for n in schema.names]]
    batch = batch.repartitionById(at, F.col("_part"))
    if len(todo) == 1:
        out = batch.sortWithinPartitions("point_id").select(*cols)
    else:
        day, ts = (lookup({s.number: v for (t, s), v in zip(todo.items(), vs, strict=True)}, "_s") for vs in (days.values(), todo))
        out = batch.withColumns({"day": day, "ts": ts.cast("long"), "c": F.lit(commit)}).sortWithinPartitions("day", "ts", "c", "point_id").select("day", "ts", "c", *cols)
    seen = Observation()
    out = out.withColumns({"_h1": _digests(schema)[0]}).observe(seen, F.count("*").alias("rows"), *_sums("_h1")).drop("_h1")
    made = {
        ts: Snapshot(ts, days[ts], f"data/day={days[ts]}/ts={ts}/c={commit}", s.rows, window[ts][0], window[ts][1], 0, new_points[ts], s.hash, s.order)
        for ts, s in todo.items()
    }
    try:
        if len(todo) == 1:
            writer(table, out).parquet(f"{table.root}/{next(iter(made.values())).path}")
        else:
            writer(table, out).partitionBy("day", "ts", "c").parquet(f"{table.root}/data")
        wanted = [sum(int(s.hash.split(":")[k]) for s in todo.values()) for k in (0, 1)]
        if [seen.get["rows"], _sum_of(seen.get, "_h1")] != wanted:  # checked and written in two passes over the source
            raise IngestRejected("the frame gave other rows when it was read again")
        made = {ts: s.sized(table.store.size(f"{table.root}/{s.path}")) for ts, s in made.items()}
        table.manifest.commit(state, add=list(made.values()), points=folders, max_point=top)
    except Exception:
        for s in made.values():  # invisible in any case; this only frees the space
            table.store.delete(f"{table.root}/{s.path}")
        for f in folders:
            table.store.delete(f"{table.root}/{f}")
        raise
    return made
