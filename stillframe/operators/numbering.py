"""Dense numbers in an order, without one task that sees all rows of a large frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Up to this many rows one task sorts and numbers them.
ONE_TASK = 1_000_000


def numbered(df: DataFrame, order: list[str], base: int, rows: int, name: str, stage: str) -> DataFrame:
    """df with column name: base + 1, base + 2, ... by order. Beyond ONE_TASK rows they are range-sorted and written
    once to the folder stage; a row's number is its partition's offset plus its place in it."""
    if rows <= ONE_TASK:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) + F.lit(base).cast("long"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.withColumn("_p", F.spark_partition_id()).withColumn("_i", place_in_partition()).write.parquet(stage)
    staged = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_p", T.IntegerType()), T.StructField("_i", T.LongType())])).parquet(stage)
    offsets, at = [], base
    for r in staged.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():  # a row per partition
        offsets.append((r["_p"], at))
        at += r["n"]
    by_part = df.sparkSession.createDataFrame(offsets, "_p int, _base long")
    return staged.join(F.broadcast(by_part), "_p").withColumn(name, F.col("_base") + F.col("_i") + 1).drop("_p", "_i", "_base")


def place_in_partition() -> Column:
    """0, 1, 2, ... within each partition."""
    return F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
