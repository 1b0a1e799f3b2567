"""The columnar wire frame: one self-describing block of columns, little-endian. Built and read column by column on
Arrow buffers; the block is one value, so it is as large as one process may hold, but no row becomes a Python object."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..errors import IngestRejected, UnparseableBody
from ..schema import ARROW, Column, TableSchema
from .rows import from_arrow

# Fixed values of the format: mark, version, type numbers, bounds.
MARK = b"ASDB"
VERSION = 1
TYPE_NUMBERS = {"INT": 1, "LONG": 2, "DOUBLE": 3, "STRING": 4}
MAX_COLUMNS = 1024
MAX_TEXT = 64 << 20

_TYPE_NAMES = {v: k for k, v in TYPE_NUMBERS.items()}
_FIXED = {"INT": "<i4", "LONG": "<i8", "DOUBLE": "<f8"}


def _varint(n: int) -> bytes:
    groups = [n >> s & 0x7F for s in range(0, max(1, n.bit_length()), 7)]
    return bytes(g | 0x80 for g in groups[:-1]) + bytes(groups[-1:])


def _text_block(texts: pa.Array) -> bytes:
    """All texts, each behind its length: heads and contents are scattered into one buffer."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    heads = 1 + sum((sizes >= 1 << (7 * k)).astype(np.int64) for k in range(1, 5))
    begin = np.cumsum(heads + sizes) - heads - sizes
    out = np.empty(int((heads + sizes).sum()), np.uint8)
    for k in range(int(heads.max(initial=0))):
        some = heads > k
        out[begin[some] + k] = (sizes[some] >> (7 * k) & 0x7F) | np.where(heads[some] > k + 1, 0x80, 0)
    _, where, content = texts.buffers()
    if content is None:
        return out.tobytes()
    where = np.frombuffer(where, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(content, np.uint8)[where[0] : where[-1]]
    out[np.repeat(begin + heads - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(raw))] = raw
    return out.tobytes()


def encode(columns: list[Column], table: pa.Table) -> bytes:
    """A table as a frame; nullable columns carry a bitmap of their nulls and only the other rows' values."""
    out = [MARK, struct.pack("<BBH", VERSION, 0, len(columns))]
    for c in columns:
        name = c.name.encode()
        out += [_varint(len(name)), name, bytes([TYPE_NUMBERS[c.type], c.nullable])]
    out.append(_varint(table.num_rows))
    for c, cells in zip(columns, table.columns, strict=True):
        if c.nullable:
            out.append(np.packbits(cells.is_null().to_numpy(zero_copy_only=False), bitorder="little").tobytes())
            cells = cells.drop_null()
        elif cells.null_count:
            raise IngestRejected(f"column {c.name} has nulls")
        if c.type == "STRING":
            out += [_text_block(chunk) for chunk in cells.cast(pa.string()).chunks if len(chunk)]
        else:
            out.append(cells.to_numpy().astype(_FIXED[c.type], copy=False).tobytes())
    return b"".join(out)


def dump(columns: list[Column], rows: list[tuple]) -> bytes:
    """Rows as a frame."""
    return encode(columns, pa.table([pa.array([r[k] for r in rows], ARROW[c.type]) for k, c in enumerate(columns)], names=[str(k) for k in range(len(columns))]))


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise UnparseableBody("the frame ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7
            if shift > 63:
                raise UnparseableBody("a number is too long")

    def skip_text(self) -> tuple[int, int]:
        """Where the next text lies; the cursor goes behind it."""
        n = self.varint()
        if n > MAX_TEXT:
            raise UnparseableBody("a text is too long")
        self.take(n)
        return self.at - n, n

    def texts(self, count: int) -> pa.Array:
        if count > len(self.data) - self.at:
            raise UnparseableBody("the frame ends early")
        where = np.array([self.skip_text() for _ in range(count)], np.int64).reshape(count, 2)
        ends = np.concatenate(([0], np.cumsum(where[:, 1])))
        content = np.frombuffer(self.data, np.uint8)[np.repeat(where[:, 0] - ends[:-1], where[:, 1]) + np.arange(ends[-1])]
        found = pa.LargeStringArray.from_buffers(count, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(content))
        try:
            found.validate(full=True)
        except pa.ArrowInvalid as e:
            raise UnparseableBody("a text is not UTF-8") from e
        return found.cast(pa.string())

    def text(self) -> str:
        return self.texts(1)[0].as_py()


def decode(data: bytes) -> tuple[list[Column], pa.Table]:
    """The columns and cells of a frame; anything malformed is rejected."""
    c = _Cursor(data)
    if c.take(4) != MARK:
        raise UnparseableBody("not a frame")
    version, _, count = struct.unpack("<BBH", c.take(4))
    if version != VERSION:
        raise UnparseableBody(f"frame version {version}")
    if not 1 <= count <= MAX_COLUMNS:
        raise UnparseableBody(f"{count} columns")
    columns = []
    for _ in range(count):
        name, kind, nullable = c.text(), *c.take(2)
        if kind not in _TYPE_NAMES:
            raise UnparseableBody(f"type number {kind}")
        columns.append(Column(name, _TYPE_NAMES[kind], nullable == 1))
    n = c.varint()
    if n >= 1 << 31:
        raise UnparseableBody(f"{n} rows")
    cells = []
    for col in columns:
        null = np.unpackbits(np.frombuffer(c.take(-(-n // 8)), np.uint8), bitorder="little")[:n].astype(bool) if col.nullable else np.zeros(0, bool)
        some = n - int(null.sum())
        found = c.texts(some) if col.type == "STRING" else pa.array(np.frombuffer(c.take(some * np.dtype(_FIXED[col.type]).itemsize), _FIXED[col.type]))
        if null.any():
            place = np.cumsum(~null) - 1
            found = found.take(pa.array(place, pa.int64(), mask=null))
        cells.append(found)
    if c.at != len(data):
        raise UnparseableBody("bytes after the frame")
    return columns, pa.table(cells, names=[str(k) for k in range(count)])


def load(data: bytes) -> tuple[list[Column], list[tuple]]:
    """The columns and rows of a frame."""
    columns, table = decode(data)
    return columns, list(zip(*(c.to_pylist() for c in table.columns), strict=True))


def read_frame(spark: SparkSession, schema: TableSchema, data: bytes) -> DataFrame:
    """A frame as snapshot content: column count and types have to be the schema's, names need not."""
    columns, table = decode(data)
    if [c.type for c in columns] != [c.type for c in schema.columns]:
        raise IngestRejected("the frame's columns are not the table's")
    return from_arrow(spark, schema, table)


def write_frame(df: DataFrame, schema: TableSchema) -> bytes:
    """A snapshot as one frame, rows in the frame's order."""
    return encode(list(schema.columns), df.select(*[f"`{n}`" for n in schema.names]).toArrow())
