"""Strict CSV: UTF-8, commas, doubled quotes; an optional header that equals the schema's names is skipped once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IngestRejected
from ..functions import typed
from ..schema import TableSchema

_NONE = "\u0000none\u0000"  # no cell is read as null by its text


def read_csv(spark: SparkSession, schema: TableSchema, path: str) -> DataFrame:
    """One file's typed rows with _row_no in line order; the whole import is rejected if any line is malformed.

    Lines are numbered 0, 1, 2, ... through the counts of the file's splits, so the numbers are the same however the
    file is split, and no task sees more than its split.
    """
    count = len(schema.columns)
    lines = spark.read.text(path).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    empty = F.col("value") == ""
    found = lines.groupBy("_p").agg(F.count("*").alias("n"), F.count_if(quotes % 2 == 1).alias("open"), F.max(F.when(~empty, F.col("_i"))).alias("last"), F.min(F.when(empty, F.col("_i"))).alias("blank")).orderBy("_p").collect()  # a row per split
    if any(r["open"] for r in found):
        raise IngestRejected("a quoted cell is not closed on its line")
    if all(r["last"] is None for r in found):
        raise IngestRejected("no rows")
    starts, at, last, blank = [], 0, 0, None
    for r in found:
        starts.append((r["_p"], at))
        last = at + r["last"] if r["last"] is not None else last
        blank = at + r["blank"] if blank is None and r["blank"] is not None else blank
        at += r["n"]
    if blank is not None and count > 1 and blank < last:
        raise IngestRejected("an empty line")
    by_split = spark.createDataFrame(starts, "_p int, _start long")  # a row per split
    lines = lines.join(F.broadcast(by_split), "_p").select("value", (F.col("_start") + F.col("_i")).alias("_row_no")).where(F.col("_row_no") <= last)
    names = [f"c{k}" for k in range(count + 1)]  # one more shows lines that are too long
    raw = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {"escape": '"', "quote": '"', "nullValue": _NONE, "emptyValue": "", "mode": "PERMISSIVE"}
    cells = lines.select("_row_no", F.from_csv(F.regexp_replace("value", "\r", ""), raw.simpleString()[7:-1].replace(":", " "), options).alias("r"), "value").select("_row_no", "value", "r.*")
    commas = F.length("bare") - F.length(F.replace(F.col("bare"), F.lit(","), F.lit("")))
    cells = cells.withColumn("bare", F.regexp_replace("value", '"[^"]*"', "")).withColumn("cells", commas + 1)
    head = cells.orderBy("_row_no").limit(1).first()
    if head is not None and [head[n] for n in names[:count]] == schema.names and head["cells"] == count:
        cells = cells.where(F.col("_row_no") > head["_row_no"]).withColumn("_row_no", F.col("_row_no") - (head["_row_no"] + 1))
    out = [F.col("_row_no")]
    bad = F.col("cells") != count
    for c, n in zip(schema.columns, names, strict=False):
        cell = F.coalesce(F.col(n), F.lit(""))
        value = F.when(cell == "", None if c.nullable else F.lit("") if c.type == "STRING" else None).otherwise(cell) if c.type == "STRING" else cell
        if c.type == "STRING":
            out.append(value.cast("string").alias(c.name))
        else:
            out.append(typed(cell, c.type).alias(c.name))
            blank = F.trim(cell) == ""
            bad = bad | (typed(cell, c.type).isNull() & (~blank | F.lit(not c.nullable)))
    first_bad = cells.where(bad).orderBy("_row_no").limit(1).first()
    if first_bad is not None:
        raise IngestRejected(f"cannot read line {first_bad['value']!r}")
    return cells.select(*out).select(*[F.col(f"`{n}`") for n in schema.names], "_row_no")
