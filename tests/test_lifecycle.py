"""Replay at size, compaction, paging, pruning, schema versions, shards, repair, streams that hold bad files, configuration."""

import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stillframe import __version__, errors
from stillframe.engine import Column, Engine
from stillframe.operators import ingest as ing
from stillframe.operators import mutate, numbering
from stillframe.plans import view_table
from stillframe.sources.csv import read_csv
from stillframe.storage import Store

T0, DAY = 1767225600000, 86_400_000
F2 = [Column("id", "INT"), Column("v", "DOUBLE", True)]


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


@pytest.fixture
def table(engine):
    return engine.create_table("t", F2, "id")


def many(spark, n):
    return spark.range(n).select(F.col("id").cast("int").alias("id"), (F.col("id") * 0.5).alias("v"))


def plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_replay_of_200_000_unordered_rows(spark, engine, table):
    df = many(spark, 200_000)
    assert table.ingest(df, T0).new_points == 200_000
    for again in (df, df.repartition(13, "v"), df.repartition(3).sortWithinPartitions(F.desc("id"))):
        assert table.ingest(again, T0).replayed
    reopened = Engine(spark, engine.root).table("t")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert reopened.ingest(df, T0).replayed
        got = reopened.ingest_batch([(T0, df), (T0 + 5, df)])
        assert [(r.replayed, r.new_points) for r in got] == [(True, 200_000), (False, 0)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for other in (df.where("id <> 77777"), df.withColumn("v", F.when(F.col("id") != 77777, F.col("v"))), df.withColumn("v", F.when(F.col("id") == 0, -0.0).otherwise(F.col("v")))):
        with pytest.raises(errors.IngestRejected):
            table.ingest(other, T0)
    assert table.snapshots() == [T0, T0 + 5] and [r["point_id"] for r in table.page(T0, 99_999, 2).collect()] == [100_000, 100_001]


def test_content_with_and_without_an_order(spark, table):
    data = [(3, 1.0), (1, None), (2, 2.0)]
    table.ingest_rows(data, T0)
    assert table.ingest(spark.createDataFrame(data[::-1], "id int, v double"), T0).replayed  # says nothing of its order
    assert table.ingest(spark.createDataFrame([(*r, k + 40) for k, r in enumerate(data)], "id int, v double, _row_no long"), T0).replayed
    with pytest.raises(errors.IngestRejected):
        table.ingest_rows(data[::-1], T0)
    with pytest.raises(errors.IngestRejected):
        table.ingest_rows([(3, 1.0), (1, 2.0), (2, None)], T0)


def test_frames_that_change_between_passes_are_rejected(spark, table):
    drifting = spark.range(50).select(F.col("id").cast("int").alias("id"), F.expr("java_method('java.lang.System', 'nanoTime')").cast("double").alias("v"))
    with pytest.raises(errors.IngestRejected):
        table.ingest(drifting, T0)
    assert table.snapshots() == [] and table.ingest(many(spark, 3), T0).rows == 3


def test_csv_lines_are_numbered_alike_however_the_file_is_split(spark, engine, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id,v\n" + "".join(f"{k},{k}.5\n" for k in range(30_000, 0, -1)))
    schema = engine.create_table("c", F2, "id").schema
    found = []
    for size in ("134217728b", "40000b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found.append([(r["id"], r["_row_no"]) for r in read_csv(spark, schema, str(p)).collect()])
    t = engine.table("c")
    t.ingest_csv(str(p), T0)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert t.ingest_csv(str(p), T0).replayed
    assert sorted(found[0]) == sorted(found[1]) == sorted((30_000 - k, k) for k in range(30_000))
    assert [r[0] for r in t.snapshot(T0, 0, 3)["rows"]] == [30_000, 29_999, 29_998]


def test_snapshots_of_several_files_keep_dense_places(spark, table, monkeypatch):
    monkeypatch.setattr(ing, "ROWS_PER_FILE", 40)
    monkeypatch.setattr(mutate, "ROWS_PER_FILE", 40)
    monkeypatch.setattr(numbering, "ONE_TASK", 10)
    table.ingest_batch([(T0, many(spark, 100)), (T0 + 5, many(spark, 150).where("id % 2 = 1"))])
    for _ in range(2):
        for ts, ids in ((T0, range(100)), (T0 + 5, range(1, 150, 2))):
            got = table.frame(ts, ts).orderBy("_place").collect()
            assert [(r["_place"], r["id"]) for r in got] == list(enumerate(ids))
            assert [r["id"] for r in table.full_snapshot(ts).collect()] == [*ids]
            assert [r[0] for r in table.snapshot(ts, 38, 5)["rows"]] == [*ids][38:43]
        assert len(table.frame(T0, T0).inputFiles()) >= 3
        table.compact()
    assert table.stats() == {"points": 125, "segments": 1, "snapshots": 2, "rows": 175, "bytes": table.stats()["bytes"]}


def test_compaction_backfill_and_deletion_in_compacted_segments(spark, table):
    for k in (0, 2):
        table.ingest_rows([(1, float(k)), (2 + k, None)], T0 + k)
    table.ingest_rows([(9, 1.0)], T0 + DAY)
    assert table.compact() == 1 and table.compact() == 0
    assert len({s.path for s in table.manifest.load().snapshots.values()}) == 2
    table.ingest_rows([(1, 1.0)], T0 + 1)  # backfill beside the compacted ones
    read = lambda: {ts: [tuple(r)[2:5] for r in table.full_snapshot(ts).collect()] for ts in table.snapshots()}
    before = read()
    assert before[T0 + 1] == [(1, "1", 1)] and before[T0 + 2] == [(1, "1", 1), (3, "4", 4)]
    assert [r["v"] for r in table.series(1).collect()] == [0.0, 1.0, 2.0]
    assert table.compact("2026-01-01") == 1 and read() == before
    assert [r["v"] for r in table.series(1, T0 + 1, T0 + 1).collect()] == [1.0] and table.as_of(1, T0 + 1).first()["v"] == 1.0
    table.delete_snapshot(T0 + 1, confirm=True)
    assert read() == {k: v for k, v in before.items() if k != T0 + 1}
    assert not table.ingest_rows([(1, 1.0)], T0 + 1).replayed and table.ingest_rows([(1, 0.0), (2, None)], T0).replayed
    assert table.repair(grace_ms=0) == {"removed": 0, "quarantined": 0, "waiting": 0}
    assert len(table.manifest.load().points) == 1  # one dictionary folder; ids as before
    table.delete_segment("2026-01-01", confirm=True)
    assert table.snapshots() == [T0 + DAY] and [n for n, _, _ in table.store.listing(f"{table.root}/packed/day=2026-01-01")] == []


def test_history_is_pruned_by_id_windows_and_statistics(spark, table):
    table.ingest(many(spark, 50), T0)
    table.ingest_rows([(900, 1.0)], T0 + 1)
    table.ingest(many(spark, 3), T0 + 2)
    got = table.series(900)
    assert len(got.inputFiles()) == 1 and got.count() == 1  # the other snapshots' windows hold no such id
    plan = plan_of(table.series(2))
    assert "EqualTo(point_id,3)" in plan and "Exchange hashpartitioning" not in plan
    assert table.frame(T0, T0 + 2, 3).count() == 2 and [s["day"] for s in table.segments_with(900)] == ["2026-01-01"]
    plan = plan_of(table.page(T0, 30, 5))
    assert "GreaterThanOrEqual(_place,30)" in plan and "LessThan(_place,35)" in plan
    assert "Exchange" not in plan_of(table.full_snapshot(T0))
    response = table.series_response(2)
    assert response == {"pk": "id", "columns": ["id", "v"], "rows": [(2, 1.0), (2, 1.0)], "timestamps": [T0, T0 + 2]}
    assert table.as_of(40, T0 + 2).first()["ts"] == T0 and table.as_of(900, T0).count() == 0


def test_files_use_deltas(spark, table):
    table.ingest(many(spark, 20_000), T0)
    path = table.frame().inputFiles()[0].removeprefix("file://")
    meta = pa.parquet.read_metadata(path) if hasattr(pa, "parquet") else __import__("pyarrow.parquet").parquet.read_metadata(path)
    columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["point_id"].encodings and columns["point_id"].total_compressed_size < 2000 and columns["_place"].total_compressed_size < 2000


def test_schema_versions(spark, engine, table):
    table.ingest_rows([(1, 1.0)], T0)
    other = engine.table("t")
    table.add_column(Column("w", "STRING", True))
    with pytest.raises(errors.InvalidArgument):
        other.add_column(Column("x", "INT", True))
    with pytest.raises(errors.InvalidArgument):
        table.add_column(Column("x", "INT"))
    table = engine.table("t")
    table.ingest_rows([(1, 2.0, "a")], T0 + 1)
    assert [(r["v"], r["w"]) for r in table.series(1).collect()] == [(1.0, None), (2.0, "a")] and table.info()["schema"]["version"] == 2
    table.compact()
    assert [(r["v"], r["w"]) for r in table.series(1).collect()] == [(1.0, None), (2.0, "a")]
    path = f"{engine.root}/t/_catalog-000002.json"
    d = json.load(open(path))
    d["columns"][1][1] = "LONG"
    os.remove(path)
    table.store.put_json(path, d)
    with pytest.raises(errors.StorageError):
        engine.table("t")


@pytest.mark.parametrize("shard, want", [("HOUR", ["2026-01-01T00", "2026-01-01T05", "2026-01-04T23"]), ("DAY", ["2026-01-01", "2026-01-04"]), ("WEEK", ["2025-12-29"])])
def test_shards(engine, shard, want):
    t = engine.create_table("s", F2, "id", shard=shard, retention_days=1)
    for ts in (T0, T0 + 5 * 3_600_000, T0 + 4 * DAY - 1):
        t.ingest_rows([(1, 1.0)], ts)
    assert [s["day"] for s in t.segments()] == want and t.series(1).count() == 3
    assert t.clean_retention(T0 + 4 * DAY) == len(want) - 1
    with pytest.raises(errors.InvalidArgument):
        engine.create_table("x", F2, "id", shard="YEAR")


def test_column_buffers(spark, table):
    table.ingest_columns({"id": np.array([2, 1], np.int32), "v": [None, 0.5]}, T0)
    assert table.snapshot(T0)["rows"] == [(2, None), (1, 0.5)]
    for bad in ({"id": [1]}, {"v": [1.0], "id": [1]}, {"id": [1, 2], "v": [1.0]}, {"id": [1 << 40], "v": [1.0]}, {"id": ["x"], "v": [1.0]}, {"id": [], "v": []}):
        with pytest.raises(errors.IngestRejected):
            table.ingest_columns(bad, T0 + 1)


def test_a_writer_that_dies_leaves_nothing_visible(spark, engine, table, monkeypatch):
    table.ingest_rows([(1, 1.0)], T0)
    monkeypatch.setattr(type(table.manifest), "commit", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))  # dies before its commit
    with pytest.raises(KeyboardInterrupt):
        table.ingest_rows([(1, 1.0), (5, 2.0)], T0 + 1)
    monkeypatch.undo()
    again = Engine(spark, engine.root).table("t")
    assert again.snapshots() == [T0] and again.stats()["points"] == 1 and again.frame().count() == 1
    assert again.repair()["waiting"] == 2 and again.repair(grace_ms=0)["removed"] == 2
    assert again.ingest_rows([(5, 2.0)], T0 + 1).new_points == 1


def test_unreadable_files_are_quarantined(spark, table):
    for k in range(3):
        table.ingest_rows([(1, 1.0), (2, 2.0)], T0 + k)
    path = table.frame(T0 + 1, T0 + 1).inputFiles()[0].removeprefix("file://")
    size = os.path.getsize(path)
    with open(path, "r+b") as f:
        f.truncate(size // 2)
    for crc in (f for f in os.listdir(os.path.dirname(path)) if f.endswith(".crc")):
        os.remove(os.path.join(os.path.dirname(path), crc))
    assert table.repair()["quarantined"] == 1 and table.snapshots() == [T0, T0 + 2] and table.frame().count() == 4
    assert not table.ingest_rows([(1, 1.0), (2, 2.0)], T0 + 1).replayed
    table.store.delete(f"{table.root}/{table.manifest.load().snapshots[T0].path}")
    with pytest.raises(errors.StorageError):
        table.frame().count()


def test_streams_survive_bad_files(spark, table, tmp_path):
    from stillframe.streaming import watch_csv

    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in {f"a-{T0}.csv": "1,1.0\n", f"b-{T0}.csv": "2,1.0\n", f"c-{T0 + 1}.csv": "x,1.0\n", "no time.csv": "1,1.0\n", f"d-{T0 + 2}.csv": "id,v\n3,\n", "99999999999999999999.csv": "1,1.0\n"}.items():
        (folder / name).write_text(text)
    watch_csv(table, str(folder), str(tmp_path / "cp")).awaitTermination()
    assert table.snapshots() == [T0, T0 + 2] and table.snapshot(T0)["rows"] == [(1, 1.0)]
    (report,) = [n for n, _, _ in table.store.listing(f"{table.root}/_rejected")]
    assert sorted(os.path.basename(p) for p in table.store.read_json(f"{table.root}/_rejected/{report}")) == sorted(["99999999999999999999.csv", f"b-{T0}.csv", f"c-{T0 + 1}.csv", "no time.csv"])
    watch_csv(table, str(folder), str(tmp_path / "other")).awaitTermination()  # a lost checkpoint: all again, nothing twice
    assert table.snapshots() == [T0, T0 + 2] and table.frame().count() == 2


def test_configuration_health_metrics_and_codes(spark, tmp_path):
    e = Engine.from_env(spark, {"STILLFRAME_ROOT": str(tmp_path / "env"), "STILLFRAME_ZONE": "Asia/Shanghai", "STILLFRAME_LEVEL": "9", "STILLFRAME_SLOW_MS": "0"})
    t = e.create_table("t", F2, "id")
    t.ingest_rows([(1, 1.0)], T0)
    assert (e.zone, t.schema.level, e.health()["version"]) == ("Asia/Shanghai", 9, __version__) and e.slow_calls >= 1
    assert 'stillframe_rows{table="t"} 1' in e.metrics() and f"stillframe_slow_calls {e.slow_calls}" in e.metrics()
    for env in ({}, {"STILLFRAME_ROOT": "x", "STILLFRAME_LEVEL": "high"}):
        with pytest.raises(errors.InvalidArgument):
            Engine.from_env(spark, env)
    codes = {c.__name__: c.code for c in (errors.InvalidArgument, errors.IngestRejected, errors.UnparseableBody, errors.NotFound, errors.StorageError, errors.CommitConflict)}
    assert codes == {"InvalidArgument": "INVALID_ARGUMENT", "IngestRejected": "INGEST_REJECTED", "UnparseableBody": "UNPARSEABLE_BODY", "NotFound": "NOT_FOUND", "StorageError": "STORAGE_ERROR", "CommitConflict": "STORAGE_ERROR"}
    assert issubclass(errors.UnparseableBody, errors.IngestRejected)


def test_stores_without_an_atomic_create_are_refused(spark):
    store = Store(spark)
    store._fs = lambda p: type("Fs", (), {"getScheme": lambda self: "s3a"})()
    with pytest.raises(errors.StorageError):
        store.put_json("s3a://bucket/x.json", {})


def test_views_number_many_keys_in_parts(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") % 700).alias("k"), (F.col("id") * 7 % 31).alias("t"))
    want = {r["k"]: r["point_id"] for r in view_table(df, F.col("t"), "k").select("k", "point_id").distinct().collect()}
    monkeypatch.setattr(numbering, "ONE_TASK", 10)
    got = {r["k"]: r["point_id"] for r in view_table(df, F.col("t"), "k").select("k", "point_id").distinct().collect()}
    assert got == want and sorted(want.values()) == [*range(1, 701)]
