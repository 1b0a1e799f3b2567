"""Every registered query of the engine against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from stillframe import plans
from stillframe.plans import registry

DIR = os.environ.get("STILLFRAME_TEST_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return [columns[k] for k in order], sorted(repr(tuple(clean(r[k]) for k in order)) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    cur = con.execute(registry.ORACLE_SQL[name])
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and e.entry(spark).schema is not None
    assert set(e.oracle_sql()) <= set(e.queries())


def test_pages_anywhere(spark, tmp_path):
    """A page far down or past the end reserves no room for the rows before it."""
    ids = spark.range(200_000).select((F.col("id") * 7 % 200_000 + 1).alias("point_id"))
    t = ids.select("point_id", F.lit(5).cast("long").alias("ts")).where("point_id % 3 = 0").unionByName(ids.select("point_id", F.lit(6).cast("long").alias("ts")))
    t.repartition(5).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))  # Spark knows no row count that would let it drop the offset
    want = list(range(3, 200_001, 3))
    assert "TakeOrdered" not in plans.snapshot_page(t, 5, 1_000_000_000, 20)._jdf.queryExecution().executedPlan().toString()
    for offset, limit in [(-7, 12), (9_990, 10), (9_990, 11), (21_840, 10), (66_650, 1 << 62), (1_000_000_000, 20), (1 << 70, 20), (30_000, -1), (-1, 1_000_000_000)]:
        got = plans.snapshot_page(t, 5, offset, limit)
        start = max(0, offset)
        assert got.columns == t.columns and [r["point_id"] for r in got.collect()] == want[start : start + max(0, limit)], (offset, limit)
    assert plans.snapshot_page(t, 7, 1_000_000_000, 20).collect() == []
