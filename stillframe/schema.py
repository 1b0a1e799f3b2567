"""Table schemas: flat, typed, primary key first; nullability is part of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .errors import IngestRejected, InvalidArgument, StorageError

TYPES = {"INT": T.IntegerType(), "LONG": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType()}
ARROW = {"INT": pa.int32(), "LONG": pa.int64(), "DOUBLE": pa.float64(), "STRING": pa.string()}
#: What one segment holds.
SHARDS = ("HOUR", "DAY", "WEEK")
_NAME = re.compile(r"[\w-]{1,128}")
#: Columns the engine adds to a table's rows.
RESERVED = ("ts", "day", "c", "point_id", "_key", "_row_no", "_place", "_part", "_new", "_s", "_h1", "_h2")


def check_name(name: str) -> None:
    """Letters, digits, _ and - only, so that a name is always one plain folder."""
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise InvalidArgument(f"bad name {name!r}")


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = False


@dataclass(frozen=True)
class TableSchema:
    columns: tuple[Column, ...]
    retention_days: int = 1825
    level: int = 3
    version: int = field(default=1)
    shard: str = "DAY"

    @staticmethod
    def create(columns: list[Column], pk: str, retention_days: int = 1825, level: int = 3, shard: str = "DAY") -> TableSchema:
        """Check everything before anything is written."""
        if not columns:
            raise InvalidArgument("a table needs a column")
        names = [c.name for c in columns]
        if len({n.lower() for n in names}) < len(names):
            raise InvalidArgument("duplicate column names")
        for c in columns:
            if not c.name or c.name.lower() in RESERVED:
                raise InvalidArgument(f"column name {c.name!r} is empty or reserved")
            if c.type not in TYPES:
                raise InvalidArgument(f"unknown type {c.type!r}")
        if pk not in names:
            raise InvalidArgument(f"no column {pk!r}")
        if names[0] != pk:
            raise InvalidArgument("the primary key is the first column")
        if columns[0].nullable:
            raise InvalidArgument("the primary key is not nullable")
        if not isinstance(retention_days, int) or retention_days < 1:
            raise InvalidArgument("retention is one day or more")
        if not 1 <= level <= 22:
            raise InvalidArgument("the compression level is 1 to 22")
        if shard not in SHARDS:
            raise InvalidArgument(f"a segment is one of {SHARDS}")
        return TableSchema(tuple(columns), retention_days, level, 1, shard)

    def plus(self, column: Column) -> TableSchema:
        """The next version, with one more column behind the others; stored snapshots have nulls in it."""
        if not column.nullable:
            raise InvalidArgument("an added column is nullable")
        more = TableSchema.create([*self.columns, column], self.pk.name, self.retention_days, self.level, self.shard)
        return TableSchema(more.columns, self.retention_days, self.level, self.version + 1, self.shard)

    def check_follows(self, old: TableSchema) -> None:
        """A registered version keeps all columns of the one before, in order, and adds nullable ones only."""
        kept = self.columns[: len(old.columns)] == old.columns and all(c.nullable for c in self.columns[len(old.columns) :])
        if not kept or self.version != old.version + 1:
            raise StorageError(f"schema version {self.version} does not follow version {old.version}")

    @property
    def pk(self) -> Column:
        return self.columns[0]

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def check_frame(self, df: DataFrame) -> None:
        """Column count, then exact types in order; nothing is widened."""
        got = [f for f in df.schema.fields if f.name != "_row_no"]
        if len(got) != len(self.columns):
            raise IngestRejected(f"{len(got)} columns instead of {len(self.columns)}")
        for c, f in zip(self.columns, got, strict=True):
            if f.dataType != TYPES[c.type]:
                raise IngestRejected(f"column {c.name} is {c.type}, not {f.dataType.simpleString()}")

    def to_json(self) -> dict:
        return {"version": self.version, "retention_days": self.retention_days, "level": self.level, "shard": self.shard, "columns": [[c.name, c.type, c.nullable] for c in self.columns]}

    @staticmethod
    def from_json(d: dict) -> TableSchema:
        return TableSchema(tuple(Column(*c) for c in d["columns"]), d["retention_days"], d["level"], d["version"], d.get("shard", "DAY"))
