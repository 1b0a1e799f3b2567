"""Rows and column buffers in memory as snapshot content."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import IngestRejected
from ..schema import ARROW, TYPES, TableSchema

_PYTHON = {"INT": int, "LONG": int, "DOUBLE": float, "STRING": str}
_RANGE = {"INT": 1 << 31, "LONG": 1 << 63}


def from_rows(spark: SparkSession, schema: TableSchema, rows: Sequence[Sequence]) -> DataFrame:
    """Python rows in list order. Empty lists, ragged rows and values of another type are rejected."""
    if not rows:
        raise IngestRejected("a snapshot has a row at least")
    for n, row in enumerate(rows):
        if len(row) != len(schema.columns):
            raise IngestRejected(f"row {n} has {len(row)} values instead of {len(schema.columns)}")
        for c, v in zip(schema.columns, row, strict=True):
            if v is not None and (isinstance(v, bool) or not isinstance(v, _PYTHON[c.type])):
                raise IngestRejected(f"row {n}, column {c.name}: {type(v).__name__} is not {c.type}")
            if v is not None and c.type in _RANGE and not -_RANGE[c.type] <= v < _RANGE[c.type]:
                raise IngestRejected(f"row {n}, column {c.name}: out of range")
    struct = T.StructType([T.StructField(c.name, TYPES[c.type], True) for c in schema.columns] + [T.StructField("_row_no", T.LongType())])
    return spark.createDataFrame([(*row, n) for n, row in enumerate(rows)], struct)


def from_arrow(spark: SparkSession, schema: TableSchema, table: pa.Table) -> DataFrame:
    """An Arrow table, columns by position, rows in its order; no Python objects are made."""
    if table.num_columns != len(schema.columns):
        raise IngestRejected(f"{table.num_columns} columns instead of {len(schema.columns)}")
    if not table.num_rows:
        raise IngestRejected("a snapshot has a row at least")
    for c, t in zip(schema.columns, table.schema.types, strict=True):
        if t != ARROW[c.type]:
            raise IngestRejected(f"column {c.name} is {c.type}, not {t}")
    numbers = pa.array(np.arange(table.num_rows))
    return spark.createDataFrame(pa.table([*table.columns, numbers], names=[*schema.names, "_row_no"]))


def from_columns(spark: SparkSession, schema: TableSchema, columns: Mapping[str, Sequence]) -> DataFrame:
    """Column buffers by name (lists, numpy or Arrow arrays; None is null), all of one length."""
    if list(columns) != schema.names:
        raise IngestRejected(f"columns {list(columns)} instead of {schema.names}")
    if len({len(v) for v in columns.values()}) > 1:
        raise IngestRejected("columns differ in length")
    try:
        arrays = [pa.array(columns[c.name], ARROW[c.type], from_pandas=False) for c in schema.columns]
    except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError) as e:
        raise IngestRejected(f"a column's values are not of its type: {e}") from e
    return from_arrow(spark, schema, pa.table(arrays, names=schema.names))
