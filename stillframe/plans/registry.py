"""Named queries over the driver tables, and the same in DuckDB SQL.

The fixture `snap` is the daily (or hourly) last state of every user in `events`; `orders` by day and `lineitem` serve
too. Every query reads its whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import plans
from ..engine import Engine, Table
from ..errors import IngestRejected
from ..functions import day_start, local_day
from ..schema import Column
from ..sources import frame
from ..storage import scratch_root

T0 = 1704844800000  # 2024-01-10 UTC
DAY = 86_400_000
KEY = "7"
ORDERS_DAY = 852854400000  # 1997-01-10 UTC
COLS = ["last_type", "last_value", "busy_max", "n"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day_ms(ts: SparkColumn) -> SparkColumn:
    """Midnight of a zoneless time in epoch milliseconds, independent of the session's zone."""
    return F.unix_date(ts.cast("date")).cast("long") * DAY


def _hour_ms(ts: SparkColumn) -> SparkColumn:
    return _day_ms(ts) + F.hour(ts) * 3_600_000


def states(spark: SparkSession, sf_dir: str, ts: Callable[[SparkColumn], SparkColumn] = _day_ms) -> DataFrame:
    """Per period and user: last type and value, the maximum of busy periods, the number of events."""
    e = _read(spark, sf_dir, "events").withColumn("_t", ts(F.col("ts")))
    return e.groupBy(F.col("_t").alias("ts"), "user_id").agg(
        F.max_by("event_type", "event_id").alias("last_type"),
        F.max_by("value", "event_id").alias("last_value"),
        F.when(F.count("*") >= 3, F.max("value")).alias("busy_max"),
        F.count("*").alias("n"),
    )


def snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.view_table(states(spark, sf_dir), F.col("ts"), "user_id")


def _out(t: DataFrame, *more: str) -> DataFrame:
    return t.select("ts", "user_id", "point_id", *COLS, *more)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").withColumn("ts", _day_ms(F.col("o_orderdate")))
    return plans.view_table(o, F.col("ts"), "o_orderkey")


def retention_now(spark: SparkSession, sf_dir: str) -> int:
    return 1706659200000 + DAY  # 2024-02-01


def day_shard_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per calendar day of Asia/Shanghai, and that day's start."""
    e = _read(spark, sf_dir, "events")
    ms = _day_ms(F.col("ts")) + F.hour("ts") * 3_600_000 + F.minute("ts") * 60_000 + F.second("ts") * 1000
    zone = "Asia/Shanghai"
    return e.select(ms.alias("ms")).groupBy(local_day(F.col("ms"), zone).cast("string").alias("day")).agg(F.count("*").alias("events"), F.min(day_start(F.col("ms"), zone)).alias("start_ms"))


SNAP_COLUMNS = [Column("user_id", "LONG"), Column("last_type", "STRING", True), Column("last_value", "DOUBLE", True), Column("busy_max", "DOUBLE", True), Column("n", "LONG")]
NAMES = [c.name for c in SNAP_COLUMNS]


def _stored(spark: SparkSession, name: str, columns: list[Column] = SNAP_COLUMNS, pk: str = "user_id", **options) -> Table:
    """A new table in the shared scratch folder, gone with the application."""
    return Engine(spark, f"{scratch_root(spark)}/{uuid.uuid4().hex[:8]}").create_table(name, columns, pk, **options)


def _content(t: DataFrame, *more: str) -> DataFrame:
    return t.select(*more, *NAMES)


_KEPT: dict[tuple[str, str], Table] = {}


def days(spark: SparkSession, sf_dir: str) -> Table:
    """All daily snapshots as one stored table, imported in one commit; made once per application and folder, and only
    read by the queries that share it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        table = _stored(spark, "days")
        table.ingest_timed(_content(states(spark, sf_dir), "ts"))
        _KEPT[key] = table
    return _KEPT[key]


def stored_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three daily snapshots imported in one commit, with the middle one backfilled, read back whole."""
    found = states(spark, sf_dir).persist()
    table = _stored(spark, "snap")
    table.ingest_batch([(T0 + k * DAY, _content(found.where(F.col("ts") == T0 + k * DAY))) for k in (0, 2)])
    table.ingest(_content(found.where(F.col("ts") == T0 + DAY)), T0 + DAY)
    found.unpersist()
    return table.frame().select("ts", *NAMES)


def stored_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot written as CSV, imported from it, read back."""
    day = _content(states(spark, sf_dir).where(F.col("ts") == T0))
    table = _stored(spark, "csv")
    path = f"{table.root}/input.csv"
    day.coalesce(1).write.option("header", True).option("escape", '"').csv(path)  # one file: its line order is the import's
    name = next(n for n, _, _ in table.store.listing(path) if n.endswith(".csv"))
    table.ingest_csv(f"{path}/{name}", T0)
    return table.full_snapshot(T0).select(*NAMES)


def stored_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot through the columnar wire frame: imported, out as a frame, imported again."""
    a = _stored(spark, "frame")
    a.ingest_frame(frame.write_frame(_content(states(spark, sf_dir).where(F.col("ts") == T0)).orderBy("user_id"), a.schema), T0)
    a.ingest_frame(a.snapshot_frame(T0), T0 + DAY)
    return a.full_snapshot(T0 + DAY).select(*NAMES)


def stored_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot next to an uncommitted folder, which repair removes."""
    table = _stored(spark, "repair")
    table.ingest(_content(states(spark, sf_dir).where(F.col("ts") == T0)), T0)
    stray = f"{table.root}/data/day=2024-01-10/ts={T0}/c=stray"
    table.full_snapshot(T0).write.parquet(stray)
    table.repair(grace_ms=0)
    return table.full_snapshot(T0).select(*NAMES)


def stored_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All daily snapshots imported twice, the second time dealt over other partitions, then one that differs: whether
    each is answered from the log, and that the other content is rejected."""
    found = _content(states(spark, sf_dir), "ts").persist()
    table = _stored(spark, "replay")
    table.ingest_timed(found)
    again = table.ingest_timed(found.repartition(3, "n"))
    try:
        table.ingest(_content(found.where(F.col("ts") == T0)).withColumn("n", F.col("n") + 1), T0)
        rejected = False
    except IngestRejected:
        rejected = True
    found.unpersist()
    return spark.createDataFrame([(r.ts, r.rows, r.replayed, rejected) for r in again], "ts long, rows long, replayed boolean, other_rejected boolean")


def backfill_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The odd days imported first, the even ones backfilled between them, the segments compacted, read back whole."""
    found = _content(states(spark, sf_dir), "ts").persist()
    table = _stored(spark, "backfill")
    odd = F.col("ts") / DAY % 2 == 1
    table.ingest_timed(found.where(odd))
    table.ingest_timed(found.where(~odd))
    table.compact()
    found.unpersist()
    return _out(table.frame())


def delete_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All daily snapshots without the deleted one: the remaining times and rows, counted in the files."""
    table = _stored(spark, "deleted")
    table.ingest_timed(_content(states(spark, sf_dir), "ts"))
    table.delete_snapshot(T0, confirm=True)
    return table.frame().groupBy("ts").agg(F.count("*").alias("rows"))


def retention_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments that retention of nine days leaves."""
    table = _stored(spark, "kept", retention_days=9)
    table.ingest_timed(_content(states(spark, sf_dir), "ts"))
    table.clean_retention(retention_now(spark, sf_dir))
    return spark.createDataFrame([(s["day"], s["rows"], s["end_time"]) for s in table.segments()], "day string, rows long, end_time long")


def stored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log knows of each segment."""
    found = [(s["day"], s["snapshots"], s["rows"], s["min_id"], s["max_id"], s["end_time"]) for s in days(spark, sf_dir).segments()]
    return spark.createDataFrame(found, "day string, snapshots long, rows long, min_id long, max_id long, end_time long")


def segment_window_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose id window holds the point of a key, by dictionary and log alone."""
    return spark.createDataFrame([(s["day"], s["rows"]) for s in days(spark, sf_dir).segments_with(KEY)], "day string, rows long")


def stored_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = days(spark, sf_dir).stats()
    return spark.createDataFrame([tuple(s[k] for k in ("points", "segments", "snapshots", "rows"))], "points long, segments long, snapshots long, rows long")


def stored_new_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New points of each snapshot, from the log."""
    found = days(spark, sf_dir).manifest.load().snapshots.values()
    return spark.createDataFrame([(s.ts, s.new_points) for s in found if s.new_points], "ts long, new_points long")


def stored_point_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = days(spark, sf_dir).point_at(KEY, T0)
    return spark.createDataFrame([values] if values else [], "last_type string, last_value double, busy_max double, n long")


def stored_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column added to a stored table: rows of before have null in it."""
    table = _stored(spark, "wider")
    found = states(spark, sf_dir).where(F.col("ts") == T0)
    table.ingest(_content(found), T0)
    table.add_column(Column("twice", "LONG", True))
    table.ingest(_content(found).withColumn("twice", F.col("n") * 2), T0 + DAY)
    return table.frame().select("ts", *NAMES, "twice")


def stored_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day's hourly snapshots in segments of an hour, as the log lists them."""
    table = _stored(spark, "hours", shard="HOUR")
    hours = states(spark, sf_dir, _hour_ms).where(F.col("ts").between(T0, T0 + DAY - 1))
    table.ingest_timed(_content(hours, "ts"))
    return spark.createDataFrame([(s["day"], s["rows"]) for s in table.segments()], "day string, rows long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "full_snapshot": lambda s, d: _out(plans.full_snapshot(snap(s, d), T0)),
    "snapshot_page": lambda s, d: _out(plans.snapshot_page(snap(s, d), T0, 10, 20)),
    "snapshot_missing_ts": lambda s, d: _out(plans.full_snapshot(snap(s, d), T0 + 100_000)),
    "snapshot_page_past_end": lambda s, d: _out(plans.snapshot_page(snap(s, d), T0, 1_000_000_000, 20)),
    "point_series": lambda s, d: _out(plans.point_series(snap(s, d), KEY, T0 - 9 * DAY, T0 + 9 * DAY, 10)),
    "point_series_unknown_key": lambda s, d: _out(plans.point_series(snap(s, d), "nobody", 0, T0, 10)),
    "point_at": lambda s, d: _out(plans.point_at(snap(s, d), KEY, T0)),
    "as_of_point": lambda s, d: _out(plans.as_of_point(snap(s, d), KEY, T0 + DAY // 2)),
    "as_of_all": lambda s, d: _out(plans.as_of_all(snap(s, d), T0)),
    "latest_snapshot": lambda s, d: _out(plans.latest_snapshot(snap(s, d), T0 + 5000)),
    "list_snapshots": lambda s, d: plans.list_snapshots(states(s, d)),
    "segment_info": lambda s, d: plans.segments(snap(s, d)).withColumn("day", F.col("day").cast("string")).withColumn("min_id", F.col("min_id").cast("long")).withColumn("max_id", F.col("max_id").cast("long")),
    "table_stats": lambda s, d: plans.table_stats(snap(s, d)),
    "new_points_per_snapshot": lambda s, d: plans.new_points(snap(s, d)),
    "segment_window_prune": segment_window_prune,
    "retention_survivors": retention_survivors,
    "delete_snapshot": delete_snapshot,
    "backfill_merge": backfill_merge,
    "duplicate_keys": lambda s, d: plans.duplicate_keys(_read(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "null_counts": lambda s, d: plans.null_counts(states(s, d), COLS),
    "snapshot_diff": lambda s, d: plans.diff(snap(s, d).where(F.col("ts") == T0), snap(s, d).where(F.col("ts") == T0 + DAY), COLS),
    "snapshot_aggregate": lambda s, d: plans.aggregate(snap(s, d).where(F.col("ts") == T0), "busy_max").withColumn("sum", F.round("sum", 4)).withColumn("avg", F.round("avg", 4)),
    "orders_snapshot": lambda s, d: plans.full_snapshot(orders(s, d), ORDERS_DAY).select("ts", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"),
    "day_shard_zone": day_shard_zone,
    "hourly_series": lambda s, d: _out(plans.point_series(plans.view_table(states(s, d, _hour_ms), F.col("ts"), "user_id"), KEY, T0, T0 + DAY, 100)),
    "stored_batch": stored_batch,
    "stored_csv": stored_csv,
    "stored_frame": stored_frame,
    "stored_repair": stored_repair,
    "stored_replay": stored_replay,
    "stored_full": lambda s, d: _out(days(s, d).full_snapshot(T0)),
    "stored_page": lambda s, d: _out(days(s, d).page(T0, 10, 20)),
    "stored_page_past_end": lambda s, d: _out(days(s, d).page(T0, 1_000_000_000, 20)),
    "stored_missing_ts": lambda s, d: _out(days(s, d).full_snapshot(T0 + 100_000)),
    "stored_series": lambda s, d: _out(days(s, d).series(KEY, T0 - 9 * DAY, T0 + 9 * DAY, 10)),
    "stored_series_unknown_key": lambda s, d: _out(days(s, d).series("nobody")),
    "stored_point_at": stored_point_at,
    "stored_as_of": lambda s, d: _out(days(s, d).as_of(KEY, T0 + DAY // 2)),
    "stored_as_of_all": lambda s, d: _out(days(s, d).as_of_all(T0)),
    "stored_latest": lambda s, d: _out(days(s, d).latest(T0 + 5000)),
    "stored_list": lambda s, d: s.createDataFrame([(t,) for t in days(s, d).snapshots()], "ts long"),
    "stored_segments": stored_segments,
    "stored_stats": stored_stats,
    "stored_new_points": stored_new_points,
    "stored_diff": lambda s, d: days(s, d).diff(T0, T0 + DAY),
    "stored_aggregate": lambda s, d: days(s, d).aggregate(T0, "busy_max").withColumn("sum", F.round("sum", 4)).withColumn("avg", F.round("avg", 4)),
    "stored_columns": stored_columns,
    "stored_hours": stored_hours,
}


def _snap_sql(unit: str = "day") -> str:
    return f"""
WITH s AS (SELECT epoch_ms(date_trunc('{unit}', ts)) AS ts, user_id, arg_max(event_type, event_id) AS last_type, arg_max(value, event_id) AS last_value,
             CASE WHEN count(*) >= 3 THEN max(value) END AS busy_max, count(*) AS n FROM events GROUP BY 1, 2),
ids AS (SELECT user_id, row_number() OVER (ORDER BY f, user_id) AS point_id FROM (SELECT user_id, min(ts) AS f FROM s GROUP BY user_id)),
t AS (SELECT s.*, point_id, CAST(CAST(make_timestamp(s.ts * 1000) AS DATE) AS VARCHAR) AS day FROM s JOIN ids USING (user_id)),
seg AS (SELECT day, count(DISTINCT ts) AS snapshots, count(*) AS rows, min(point_id) AS min_id, max(point_id) AS max_id, max(ts) AS end_time FROM t GROUP BY day)
"""


_ALL = "ts, user_id, point_id, last_type, last_value, busy_max, n"
_DAY_OF_ROWS = f"SELECT user_id, last_type, last_value, busy_max, n FROM t WHERE ts = {T0}"

ORACLE_SQL: dict[str, str] = {
    k: _snap_sql() + v
    for k, v in {
        "full_snapshot": f"SELECT {_ALL} FROM t WHERE ts = {T0}",
        "snapshot_page": f"SELECT {_ALL} FROM t WHERE ts = {T0} ORDER BY point_id LIMIT 20 OFFSET 10",
        "snapshot_missing_ts": f"SELECT {_ALL} FROM t WHERE ts = {T0 + 100_000}",
        "snapshot_page_past_end": f"SELECT {_ALL} FROM t WHERE ts = {T0} ORDER BY point_id LIMIT 20 OFFSET 1000000000",
        "point_series": f"SELECT {_ALL} FROM t WHERE user_id = {KEY} AND ts BETWEEN {T0 - 9 * DAY} AND {T0 + 9 * DAY} ORDER BY ts LIMIT 10",
        "point_series_unknown_key": f"SELECT {_ALL} FROM t WHERE CAST(user_id AS VARCHAR) = 'nobody' AND ts <= {T0}",
        "point_at": f"SELECT {_ALL} FROM t WHERE user_id = {KEY} AND ts = {T0}",
        "as_of_point": f"SELECT {_ALL} FROM t WHERE user_id = {KEY} AND ts <= {T0 + DAY // 2} ORDER BY ts DESC LIMIT 1",
        "as_of_all": f"SELECT {_ALL} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM t WHERE ts <= {T0}) WHERE k = 1",
        "latest_snapshot": f"SELECT {_ALL} FROM t WHERE ts = (SELECT max(ts) FROM t WHERE ts <= {T0 + 5000})",
        "list_snapshots": "SELECT DISTINCT ts FROM t",
        "segment_info": "SELECT * FROM seg",
        "table_stats": "SELECT count(DISTINCT user_id) AS points, count(DISTINCT day) AS segments, count(DISTINCT ts) AS snapshots, count(*) AS rows FROM t",
        "new_points_per_snapshot": "SELECT ts, count(*) AS new_points FROM (SELECT user_id, min(ts) AS ts FROM t GROUP BY user_id) GROUP BY ts",
        "segment_window_prune": f"SELECT day, rows FROM seg, ids WHERE user_id = {KEY} AND min_id <= point_id AND max_id >= point_id",
        "retention_survivors": f"SELECT day, rows, end_time FROM seg WHERE end_time >= {1706659200000 + DAY - 9 * DAY}",
        "delete_snapshot": f"SELECT ts, count(*) AS rows FROM t WHERE ts <> {T0} GROUP BY ts",
        "backfill_merge": f"""SELECT ts, user_id, row_number, last_type, last_value, busy_max, n FROM t JOIN (
    SELECT user_id, row_number() OVER (ORDER BY late, f, user_id) AS row_number FROM (
      SELECT user_id, late, min(ts) AS f FROM (SELECT user_id, ts, ts // {DAY} % 2 = 0 AS late, min(ts // {DAY} % 2 = 0) OVER (PARTITION BY user_id) AS first FROM s) WHERE late = first GROUP BY ALL)) USING (user_id)""".replace("row_number, last", "row_number AS point_id, last"),
        "null_counts": "SELECT CAST(count(*) FILTER (last_type IS NULL) AS BIGINT) AS last_type_nulls, count(*) FILTER (last_value IS NULL) AS last_value_nulls, count(*) FILTER (busy_max IS NULL) AS busy_max_nulls, count(*) FILTER (n IS NULL) AS n_nulls FROM t",
        "snapshot_diff": f"""SELECT CAST(coalesce(a.user_id, b.user_id) AS VARCHAR) AS _key, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM (SELECT * FROM t WHERE ts = {T0}) a FULL JOIN (SELECT * FROM t WHERE ts = {T0 + DAY}) b ON a.user_id = b.user_id
  WHERE a.user_id IS NULL OR b.user_id IS NULL OR a.last_type IS DISTINCT FROM b.last_type OR a.last_value IS DISTINCT FROM b.last_value OR a.busy_max IS DISTINCT FROM b.busy_max OR a.n IS DISTINCT FROM b.n""",
        "snapshot_aggregate": f"SELECT count(busy_max) AS n, min(busy_max) AS min, max(busy_max) AS max, round(sum(busy_max), 4) AS sum, round(avg(busy_max), 4) AS avg FROM t WHERE ts = {T0}",
        "stored_batch": f"SELECT ts, user_id, last_type, last_value, busy_max, n FROM t WHERE ts BETWEEN {T0} AND {T0 + 2 * DAY}",
        "stored_csv": _DAY_OF_ROWS,
        "stored_frame": _DAY_OF_ROWS,
        "stored_repair": _DAY_OF_ROWS,
        "stored_replay": "SELECT ts, count(*) AS rows, true AS replayed, true AS other_rejected FROM t GROUP BY ts",
        "stored_point_at": f"SELECT last_type, last_value, busy_max, n FROM t WHERE user_id = {KEY} AND ts = {T0}",
        "stored_columns": f"SELECT {T0} AS ts, user_id, last_type, last_value, busy_max, n, CAST(NULL AS BIGINT) AS twice FROM t WHERE ts = {T0} UNION ALL SELECT {T0 + DAY}, user_id, last_type, last_value, busy_max, n, n * 2 FROM t WHERE ts = {T0}",
    }.items()
} | {
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "orders_snapshot": f"SELECT epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS ts, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1997-01-10'",
    "day_shard_zone": "SELECT CAST(CAST(ts + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS events, epoch_ms(CAST(CAST(ts + INTERVAL 8 HOUR AS DATE) AS TIMESTAMP) - INTERVAL 8 HOUR) AS start_ms FROM events GROUP BY ALL",
    "hourly_series": _snap_sql("hour") + f"SELECT {_ALL} FROM t WHERE user_id = {KEY} AND ts BETWEEN {T0} AND {T0 + DAY} ORDER BY ts LIMIT 100",
}

ORACLE_SQL["stored_hours"] = _snap_sql("hour") + f"SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H') AS day, count(*) AS rows FROM t WHERE ts BETWEEN {T0} AND {T0 + DAY - 1} GROUP BY ALL"
#: Stored tables answer as the query algebra does on a view.
for _stored_name, _name in {
    "stored_full": "full_snapshot", "stored_page": "snapshot_page", "stored_page_past_end": "snapshot_page_past_end", "stored_missing_ts": "snapshot_missing_ts", "stored_series": "point_series",
    "stored_series_unknown_key": "point_series_unknown_key", "stored_as_of": "as_of_point", "stored_as_of_all": "as_of_all", "stored_latest": "latest_snapshot", "stored_list": "list_snapshots",
    "stored_segments": "segment_info", "stored_stats": "table_stats", "stored_new_points": "new_points_per_snapshot", "stored_diff": "snapshot_diff", "stored_aggregate": "snapshot_aggregate",
}.items():
    ORACLE_SQL[_stored_name] = ORACLE_SQL[_name]
