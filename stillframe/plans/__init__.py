"""Snapshot query algebra: pure functions of a frame T(ts, day, point_id, _key, columns...).

T comes from stored snapshots or from any table with a time and a key (`view_table`); every function returns a lazy
plan, so partition pruning, pushdown and top-k are the optimizer's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidArgument

#: Up to this place a page is taken as the first rows of all.
TOP_ROWS = 10_000
#: A block of a deeper page: this many low bits of the point id.
BLOCK_BITS = 16


def view_table(df: DataFrame, ts: Column, key: str, zone: str = "UTC") -> DataFrame:
    """Any frame as T; point ids by first appearance in time, ties by key. One group-by and a join on the key; the
    keys are counted here, and very many are numbered by a range sort."""
    from ..functions import local_day
    from ..operators.numbering import numbered
    from ..storage import scratch_root

    rows = df.withColumn("ts", ts.cast("long")).withColumn("_key", F.col(key).cast("string"))
    first = rows.groupBy("_key", F.col(key).alias("_k")).agg(F.min("ts").alias("_f"))
    ids = numbered(first, ["_f", "_k"], 0, first.count(), "point_id", f"{scratch_root(df.sparkSession)}/keys-{uuid.uuid4().hex}").select("_key", "point_id")
    return rows.join(ids, "_key").withColumn("day", local_day(F.col("ts"), zone))


def _count(n: int) -> int:
    """A row count as Spark takes it: no less than 0, no more than an int."""
    return max(0, min(n, (1 << 31) - 1))


def value_columns(t: DataFrame) -> list[str]:
    return [c for c in t.columns if c not in ("ts", "day", "point_id", "_key", "c", "_place")]


def full_snapshot(t: DataFrame, ts: int) -> DataFrame:
    """All rows at exactly ts, in point order; nothing if there is no such snapshot."""
    return t.where(F.col("ts") == ts).orderBy("point_id")


def snapshot_page(t: DataFrame, ts: int, offset: int, limit: int) -> DataFrame:
    """Rows [max(0, offset), offset + limit) of the snapshot; limit <= 0 gives none.

    Pages that end by TOP_ROWS are a top-k, whose tasks reserve room for two rows of every place up to the page's end.
    For others the rows are counted by block of point ids first: the counts give each block's first place, and only
    rows of the page's blocks are sorted, a block to a task. So t is evaluated twice, and no task grows with the offset.
    """
    start, end = max(0, offset), max(0, offset) + max(0, limit)
    rows = t.where(F.col("ts") == ts)
    if end <= TOP_ROWS:
        return rows.orderBy("point_id").offset(start).limit(end - start)
    start, end = (F.lit(min(n, (1 << 63) - 1)).cast("long") for n in (start, end))
    rows = rows.withColumn("_block", F.shiftright("point_id", BLOCK_BITS))
    upto = F.sum("_n").over(Window.orderBy("_block"))
    blocks = rows.groupBy("_block").agg(F.count("*").alias("_n")).select("_block", (upto - F.col("_n")).alias("_from"), upto.alias("_to"))
    blocks = F.broadcast(blocks.where((F.col("_from") < end) & (F.col("_to") > start)).select("_block", "_from"))
    at = F.col("_from") + F.row_number().over(Window.partitionBy("_block").orderBy("point_id")) - 1
    placed = rows.join(blocks, "_block").withColumn("_at", at)
    return placed.where((F.col("_at") >= start) & (F.col("_at") < end)).drop("_block", "_from", "_at").orderBy("point_id")


def _same_key(t: DataFrame, key) -> Column:
    """The key test, on the key's text; typed keys give a typed test that is pushed to the files as well."""
    return F.col("_key") == (key if isinstance(key, str) else F.lit(key).cast("string"))


def point_series(t: DataFrame, key, start: int, end: int, limit: int) -> DataFrame:
    """The first `limit` rows of a key with start <= ts <= end, ascending."""
    return t.where(_same_key(t, key) & F.col("ts").between(start, end)).orderBy("ts").limit(_count(limit))


def point_at(t: DataFrame, key, ts: int) -> DataFrame:
    """The key's row at exactly ts, if any."""
    return t.where((F.col("ts") == ts) & _same_key(t, key))


def as_of_point(t: DataFrame, key, ts: int) -> DataFrame:
    """The key's latest row at or before ts, however many came before."""
    return t.where((F.col("ts") <= ts) & _same_key(t, key)).orderBy(F.desc("ts")).limit(1)


def as_of_all(t: DataFrame, ts: int) -> DataFrame:
    """Each key's latest row at or before ts: a pre-aggregated maximum, no per-key sort."""
    cols = [c for c in t.columns if c != "_key"]
    last = t.where(F.col("ts") <= ts).groupBy("_key").agg(F.max_by(F.struct(*cols), "ts").alias("r"))
    return last.select("_key", "r.*")


def latest_snapshot(t: DataFrame, ts: int) -> DataFrame:
    """The whole snapshot at the last time at or before ts (for views; stored tables ask the manifest)."""
    last = t.where(F.col("ts") <= ts).agg(F.max("ts").alias("__last"))
    return t.join(F.broadcast(last), F.col("ts") == F.col("__last")).drop("__last").orderBy("point_id")


def list_snapshots(t: DataFrame) -> DataFrame:
    return t.select("ts").distinct()


def segments(t: DataFrame) -> DataFrame:
    """Per day: snapshots, rows, smallest and largest point id, last time."""
    return t.groupBy("day").agg(F.count_distinct("ts").alias("snapshots"), F.count("*").alias("rows"), F.min("point_id").alias("min_id"), F.max("point_id").alias("max_id"), F.max("ts").alias("end_time"))


def table_stats(t: DataFrame) -> DataFrame:
    return t.agg(F.count_distinct("_key").alias("points"), F.count_distinct("day").alias("segments"), F.count_distinct("ts").alias("snapshots"), F.count("*").alias("rows"))


def new_points(t: DataFrame) -> DataFrame:
    """How many points appeared first at each time."""
    return t.groupBy("_key").agg(F.min("ts").alias("ts")).groupBy("ts").agg(F.count("*").alias("new_points"))


def segments_with(t: DataFrame, point_id: int) -> DataFrame:
    """Segments whose id window holds a point."""
    return segments(t).where((F.col("min_id") <= point_id) & (F.col("max_id") >= point_id))


def retained(t: DataFrame, now: int, days: int) -> DataFrame:
    """Segments that retention keeps: their last time is not before now - days."""
    return segments(t).where(F.col("end_time") >= now - days * 86_400_000)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def diff(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """_key and change of two snapshots: added, removed or changed (null changes included)."""
    a = old.select("_key", F.struct(*columns).alias("a"), F.lit(True).alias("in_a"))
    b = new.select("_key", F.struct(*columns).alias("b"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "_key", "full_outer").select("_key", change.alias("change")).where("change is not null")


def aggregate(t: DataFrame, column: str) -> DataFrame:
    """count, min, max, sum and avg of a column; nulls are skipped."""
    if column not in t.columns:
        raise InvalidArgument(f"no column {column!r}")
    c = F.col(f"`{column}`")
    return t.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("sum"), F.avg(c).alias("avg"))
