"""Stored tables: imports, validation, replay, backfill, reads, deletion, retention, repair, formats."""

import itertools
import math
from concurrent.futures import ThreadPoolExecutor

import pytest

from stillframe.engine import Engine
from stillframe.errors import CommitConflict, IngestRejected, InvalidArgument, NotFound, StillframeError, UnparseableBody
from stillframe.manifest import Manifest
from stillframe.schema import Column
from stillframe.sources import frame
from stillframe.tasks import Imports

T0, DAY = 1767225600000, 86_400_000
F2 = [Column("id", "INT"), Column("v", "DOUBLE", True)]
NUMBERS = itertools.count()


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / f"db{next(NUMBERS)}"), zone="UTC")


@pytest.fixture
def table(engine):
    return engine.create_table("t", F2, "id")


def rows(n, base=0.0):
    return [(k, base + k) for k in range(1, n + 1)]


def test_exact_match_and_paging(table):
    table.ingest_rows(rows(5), T0)
    table.ingest_rows(rows(1), T0 + 300000)
    assert table.snapshot(T0 + 100000)["total_rows"] == 0
    assert table.snapshot(T0)["total_rows"] == 5
    assert table.snapshot(T0 + 300000)["total_rows"] == 1
    page = lambda o, n: [r[0] for r in table.snapshot(T0, o, n)["rows"]]
    assert page(5, 10) == [] and page(0, 2) == [1, 2] and page(2, 3) == [3, 4, 5] and page(1, 3) == [2, 3, 4] and page(-3, 2) == [1, 2]
    past = table.snapshot(T0, 5, 10)
    assert (past["total_rows"], past["limit"]) == (5, 0)
    assert table.snapshot(T0, 0, 0)["total_rows"] == 0
    assert table.snapshot(T0, 2, 1 << 62)["limit"] == 3


def test_series_over_days_and_missing_points(table):
    for d in range(4):
        table.ingest_batch([(T0 + d * DAY + s * 600000, table.spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, v double")) for s in range(2)])
    got = [r["ts"] for r in table.series(1).collect()]
    assert got == sorted(T0 + d * DAY + s * 600000 for d in range(4) for s in range(2))
    assert len(table.segments()) == 4
    assert table.series(1, limit=3).count() == 3 and table.series(1, limit=0).count() == 0
    assert table.series(1, T0 + DAY, T0 + 2 * DAY).count() == 3
    assert table.series(99999).count() == 0 and table.series("x").count() == 0
    table.ingest_rows([(1, 0.0)], T0 + 9 * DAY)
    assert table.series(2).count() == 8
    assert table.point_at(1, T0) == (1.0,) and table.point_at(1, T0 + 1) is None
    assert table.as_of(2, T0 + 9 * DAY).first()["ts"] == T0 + 3 * DAY + 600000
    assert table.as_of(2, T0 - 1).count() == 0
    assert table.latest(T0 + DAY + 1).count() == 2 and table.latest(T0 - 1).count() == 0


def test_point_ids_follow_imports_and_are_never_reused(table):
    table.ingest_rows([(5, 1.0), (3, 1.0)], T0)
    table.ingest_rows([(9, 1.0), (3, 1.0), (1, 1.0)], T0 - 1000)  # an older time, imported later
    assert [r[0] for r in table.snapshot(T0)["rows"]] == [5, 3]
    assert [r[0] for r in table.snapshot(T0 - 1000)["rows"]] == [3, 9, 1]
    table.delete_snapshot(T0, confirm=True)
    table.ingest_rows([(7, 1.0), (5, 1.0)], T0 + 5)
    assert [(r["_key"], r["point_id"]) for r in table.full_snapshot(T0 + 5).collect()] == [("5", 1), ("7", 5)]
    assert table.stats()["points"] == 5


@pytest.mark.parametrize("data", [[], [(1,)], [(1, "x")], [(None, 1.0)], [(1, 1.0), (1, 2.0)], [(1 << 40, 1.0)], [(True, 1.0)]])
def test_rejected_rows(table, data):
    with pytest.raises(IngestRejected):
        table.ingest_rows(data, T0)
    assert table.snapshots() == []


def test_rejections_of_text_keys_nulls_and_types(engine):
    t = engine.create_table("s", [Column("k", "STRING"), Column("v", "DOUBLE")], "k")
    for data in ([("", 1.0)], [("   ", 1.0)], [("a", None)]):
        with pytest.raises(IngestRejected):
            t.ingest_rows(data, T0)
    with pytest.raises(IngestRejected):
        t.ingest(t.spark.createDataFrame([("a", 1)], "k string, v int"), T0)
    t.ingest_rows([('q"x', 1.0), ("n\nl", 2.0), ("t\tb", 3.0)], T0)
    assert t.point_at("n\nl", T0) == (2.0,)


@pytest.mark.parametrize(
    "columns, pk, more",
    [([], "id", {}), (F2, "x", {}), (F2, "v", {}), ([Column("id", "INT", True)], "id", {}), ([Column("id", "INT"), Column("id", "INT")], "id", {}), (F2, "id", {"level": 23}), (F2, "id", {"retention_days": 0}), ([Column("id", "FLOAT")], "id", {}), ([Column("ts", "INT")], "ts", {})],
)
def test_bad_tables(engine, columns, pk, more):
    with pytest.raises(InvalidArgument):
        engine.create_table("x", columns, pk, **more)
    assert engine.tables() == []


@pytest.mark.parametrize("name", ["", "..", ".", "a/b", "a\\b", "a'b", "a b", "x" * 129])
def test_bad_names(engine, name):
    with pytest.raises(InvalidArgument):
        engine.create_table(name, F2, "id")


def test_catalog(engine):
    engine.create_table("b", F2, "id")
    engine.create_table("表-1", F2, "id")
    with pytest.raises(InvalidArgument):
        engine.create_table("b", F2, "id")
    assert engine.tables() == ["b", "表-1"]
    with pytest.raises(InvalidArgument):
        engine.drop_table("b")
    engine.drop_table("b", confirm=True)
    assert engine.tables() == ["表-1"] and engine.health()["status"] == "UP"
    with pytest.raises(NotFound):
        engine.table("b")


def test_replay_rejection_and_hash(table):
    a = table.ingest_rows(rows(3), T0)
    assert table.ingest_rows(rows(3), T0).replayed and a.new_points == 3
    for _ in range(2):  # a rejected import stays rejected, and the stored one can still be replayed
        with pytest.raises(IngestRejected):
            table.ingest_rows(rows(3, 1.0), T0)
    assert table.ingest_rows(rows(3), T0).replayed
    with pytest.raises(IngestRejected):
        table.ingest_rows(rows(3)[::-1], T0)  # row order is content
    assert table.snapshots() == [T0]


def test_mixed_batch_order_and_atomicity(table):
    frame_ = lambda n: table.spark.createDataFrame([(k, float(k), k) for k in range(1, n + 1)], "id int, v double, _row_no long")
    table.ingest_rows(rows(2), T0)
    got = table.ingest_batch([(T0, frame_(2)), (T0 + 5, frame_(3))])
    assert [(r.ts, r.rows, r.replayed) for r in got] == [(T0, 2, True), (T0 + 5, 3, False)]
    for times in ((T0 + 9, T0 + 8), (T0 + 9, T0 + 9)):
        with pytest.raises(InvalidArgument):
            table.ingest_batch([(t, frame_(2)) for t in times])
    bad = table.spark.createDataFrame([(1, 1.0), (1, 1.0)], "id int, v double")
    with pytest.raises(IngestRejected):
        table.ingest_batch([(T0 + 20, frame_(2)), (T0 + 30, bad)])
    assert table.snapshots() == [T0, T0 + 5]
    table.ingest_batch([(T0 + 1, frame_(2)), (T0 + 3, frame_(2))])
    assert table.snapshots() == [T0, T0 + 1, T0 + 3, T0 + 5]


def test_delete_and_import_again(table):
    for k in (2, 3, 4):
        table.ingest_rows(rows(k), T0 + k)
    with pytest.raises(InvalidArgument):
        table.delete_snapshot(T0 + 3)
    table.delete_snapshot(T0 + 3, confirm=True)
    assert (table.segments()[0]["rows"], table.segments()[0]["end_time"]) == (6, T0 + 4)
    table.delete_snapshot(T0 + 4, confirm=True)
    assert table.segments()[0]["end_time"] == T0 + 2
    with pytest.raises(NotFound):
        table.delete_snapshot(T0 + 4, confirm=True)
    assert not table.ingest_rows(rows(3), T0 + 3).replayed
    assert table.segment_snapshots("2026-01-01") == [(T0 + 2, 2), (T0 + 3, 3)]
    assert table.delete_segment("data/day=2026-01-01", confirm=True) == 2
    assert table.segments() == [] and table.snapshots() == []
    with pytest.raises(NotFound):
        table.delete_segment("2026-01-01", confirm=True)


def test_retention_keeps_straddling_days(engine):
    t = engine.create_table("r", F2, "id", retention_days=2)
    now = T0 + 10 * DAY
    for ts in (now, now - DAY, now - 2 * DAY - 1000):
        t.ingest_rows(rows(1), ts)
    t.ingest_rows(rows(1), now - 3 * DAY)
    assert t.clean_retention(now) == 1 and len(t.snapshots()) == 2
    assert engine.clean_all(now) == {"r": 0}


def test_zone_days(spark, tmp_path):
    t = Engine(spark, str(tmp_path / "z"), zone="Asia/Shanghai").create_table("t", F2, "id")
    t.ingest_rows(rows(1), 1786811400000)
    assert [s["day"] for s in t.segments()] == ["2026-08-16"]
    with pytest.raises(Exception):
        Engine(spark, str(tmp_path / "y"), zone="Not/AZone")


def test_nulls_doubles_and_reopening(spark, engine):
    t = engine.create_table("n", [Column("id", "LONG"), Column("v", "DOUBLE", True), Column("s", "STRING", True)], "id", level=7)
    values = [100.0, 100.00001, 0.3, 0.1 + 0.2, -0.0, math.inf, math.nan, None, 1e308]
    t.ingest_rows([(k, v, None if k % 2 else "") for k, v in enumerate(values)], T0)
    again = Engine(spark, engine.root).table("n")
    got = [r[1] for r in again.snapshot(T0, 0, 100)["rows"]]
    assert [repr(x) for x in got] == [repr(x) for x in values]
    assert again.ingest_rows([(1, None, None)], T0 + 1).rows == 1 and again.schema.level == 7
    assert list(again.stream_snapshot(T0))[1][2] is None and list(again.stream_snapshot(T0))[2][2] == ""


def test_double_keys_keep_signed_zero(engine):
    t = engine.create_table("d", [Column("k", "DOUBLE"), Column("v", "INT")], "k")
    t.ingest_rows([(-0.0, 1), (0.0, 2), (1e7, 3)], T0)
    assert t.point_at(-0.0, T0) == (1,) and t.point_at(0.0, T0) == (2,) and t.point_at("1.0E7", T0) == (3,)


def test_diff_aggregate_export(table, tmp_path):
    table.ingest_rows([(1, 1.0), (2, None), (3, 3.0)], T0)
    table.ingest_rows([(2, 2.0), (3, 3.0), (4, 4.0)], T0 + 1)
    assert {(r["_key"], r["change"]) for r in table.diff(T0, T0 + 1).collect()} == {("1", "removed"), ("2", "changed"), ("4", "added")}
    a = table.aggregate(T0, "v").first()
    assert (a["n"], a["min"], a["max"], a["sum"], a["avg"]) == (2, 1.0, 3.0, 4.0, 2.0)
    for kind in ("csv", "parquet"):
        table.export(T0, str(tmp_path / kind), kind)
        assert table.spark.read.format(kind).option("header", True).load(str(tmp_path / kind)).count() == 3
    with pytest.raises(InvalidArgument):
        table.export(T0, "x", "xml")


def test_uncommitted_files_are_invisible_and_repaired(table):
    table.ingest_rows(rows(3), T0)
    table.full_snapshot(T0).write.parquet(f"{table.root}/data/day=2026-01-01/ts={T0}/c=dead")
    assert table.full_snapshot(T0).count() == 3
    assert table.repair() == {"removed": 0, "quarantined": 0, "waiting": 1}  # it may be another writer's
    assert table.repair(grace_ms=0) == {"removed": 1, "quarantined": 0, "waiting": 0}
    path = table.manifest.load().snapshots[T0].path
    table.ingest_rows(rows(2), T0 + 1)
    table.store.delete(f"{table.root}/{path}")
    assert table.repair()["quarantined"] == 1 and table.snapshots() == [T0 + 1]


def test_commit_conflict_and_concurrent_writers(table):
    m = Manifest(table.store, table.root)
    state = m.load()
    m.commit(state)
    with pytest.raises(CommitConflict):
        m.commit(state)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: table.ingest_rows(rows(k + 1), T0 + k), range(4)))
    assert table.snapshots() == [T0 + k for k in range(4)] and table.stats()["points"] == 4


def test_manifest_checkpoints(table):
    m = Manifest(table.store, table.root)
    for _ in range(53):
        m.commit(m.load())
    assert any(n.startswith("c") for n, _, _ in table.store.listing(m.root)) and m.load().version == 53


CSV = [Column("id", "INT"), Column("v", "STRING", True), Column("x", "DOUBLE", True)]


def csv_table(engine, tmp_path, text, columns=CSV):
    p = tmp_path / f"f{next(NUMBERS)}.csv"
    p.write_bytes(text.encode())
    t = engine.create_table(f"c{next(NUMBERS)}", columns, columns[0].name)
    t.ingest_csv(str(p), T0)
    return t.snapshot(T0, 0, 100)["rows"]


@pytest.mark.parametrize(
    "text, want",
    [
        ('id,v,x\n2,"a,b",1.5\n 1 ,"q""z""",\n', [(2, "a,b", 1.5), (1, 'q"z"', None)]),
        ("1, a ,1e3\r\n2,,NaN\r\n\n", [(1, " a ", 1000.0), (2, None, "nan")]),
        ('3,"",-0.0', [(3, None, -0.0)]),
    ],
)
def test_csv(engine, tmp_path, text, want):
    got = csv_table(engine, tmp_path, text)
    assert [(a, b, "nan" if c is not None and math.isnan(c) else c) for a, b, c in got] == want


@pytest.mark.parametrize("text", ["", "id,v,x\n", "1,a\n", "1,a,2,3\n", "x,a,1\n", '1,"a,1\n', '1,"a\nb",1\n', "1,a,1\n\n2,b,1\n", "1,a,1d\n".replace("1d", "zz"), ",a,1\n", "1,a,inf\n", "id,v,x\nid,v,x\n"])
def test_csv_rejections(engine, tmp_path, text):
    with pytest.raises(StillframeError):
        csv_table(engine, tmp_path, text)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 63, 64, 65, 1000])
@pytest.mark.parametrize("share", [0, 0.3, 0.7, 1])
def test_frame_round_trip(n, share):
    import random

    r = random.Random(n)
    cols = [Column("k", "INT"), Column("a", "INT", True), Column("b", "LONG", True), Column("c", "DOUBLE", True), Column("d", "STRING", True)]
    some = lambda v: None if r.random() < share else v
    data = [(k, some(-(1 << 31)), some((1 << 63) - 1), some(1.7976931348623157e308), some('"\n,é' * (k % 3))) for k in range(n)]
    block = frame.dump(cols, data)
    assert frame.load(block) == (cols, data)
    for cut in (3, 7, len(block) - 1):
        with pytest.raises(UnparseableBody):
            frame.load(block[:cut])
    with pytest.raises(UnparseableBody):
        frame.load(block + b"x")


def test_frame_import(table):
    table.ingest_frame(frame.dump(F2, [(1, None), (2, 2.5)]), T0)
    assert frame.load(table.snapshot_frame(T0))[1] == [(1, None), (2, 2.5)]
    with pytest.raises(IngestRejected):
        table.ingest_frame(frame.dump([Column("id", "LONG"), F2[1]], [(1, None)]), T0 + 1)


def test_async_imports(table):
    tasks = Imports(2)
    good = tasks.submit(lambda: table.ingest_rows(rows(2), T0).rows)
    bad = tasks.submit(lambda: table.ingest_rows([], T0))
    tasks.close()
    assert tasks.status(good)["result"] == 2 and tasks.status(bad)["status"] == "FAILED"
    with pytest.raises(NotFound):
        tasks.status("import-99")


def test_streamed_files(table, tmp_path):
    from stillframe.streaming import watch_csv

    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"s-{T0 + k}.csv").write_text("id,v\n1,1.5\n2,\n")
    watch_csv(table, str(folder), str(tmp_path / "cp")).awaitTermination()
    (folder / f"s-{T0 - 5}.csv").write_text("1,2.5\n")
    watch_csv(table, str(folder), str(tmp_path / "cp")).awaitTermination()
    assert table.snapshots() == [T0 - 5, T0, T0 + 1]


def test_snapshot_plan_prunes(table):
    table.ingest_rows(rows(3), T0)
    table.ingest_rows(rows(3), T0 + DAY)
    plan = table.series(1, T0, T0)._jdf.queryExecution().explainString(table.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(point_id,1)" in plan and len(table.frame(T0, T0).inputFiles()) == 1
