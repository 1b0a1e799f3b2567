"""Operator 9: token-id shards with Elias-Fano document boundaries.

A shard is one blob: a header, the concatenated ids (2 bytes each where the vocabulary allows, else 4) and two
Elias-Fano sequences, the documents' end offsets and their ids, each with a sampled select structure. Its sizes are
about n * (2 + log2(U / n)) bits for n values up to U, instead of 64 n.

Documents are encoded where they lie; what is shuffled are their ids, 2 bytes each. They are dealt into ranges of
doc_id by cuts that one pass over that column estimates; rows of one very frequent doc_id (or of null), which no cut
can part, are dealt over the ranges between its equal cuts by text hash. Shards are rows of a Parquet table in the
shared folder, so that any store Spark can write will do; they are written in ascending doc_id order (sorted within
each range), each with the number of ids before it in its range. A document's global start is that plus its range's
base; the bases are a sum per range on the driver, bounded by the number of ranges.

Readers take offsets from the select structures: a whole read asks for the edges of a block of documents at a time, a
look-up by doc_id finds the shard by its bounds and the document by bisection; no 64-bit table of offsets is made.

Defined results: null text is a document with the end id only; rows with a null doc_id come first; repeated doc_ids
each keep a document, ordered by text hash; very long texts are encoded whole, and a shard ends after the document that
fills it; columns other than doc_id and text are ignored; an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Scratch, ship, slices, texts
from .bpe import PieceCoder, coder

_HEAD = struct.Struct("<4sHHQQQ")  # magic, version, bytes per id, documents, ids, documents without doc_id
_SEQ = struct.Struct("<QqHQQ")  # values, smallest value, low bits, low bytes, high bytes
_BLOCK = 512  # high bits between two rank samples
_BLOCK_DOCS = 4096  # documents whose edges a whole read selects at once
_NULL = -(1 << 63)
_DDL = "part int, shard int, start long, n_docs long, n_ids long, lo long, hi long, blob binary"
_TABLE = pa.schema([("part", pa.int32()), ("shard", pa.int32()), *[(k, pa.int64()) for k in ("start", "n_docs", "n_ids", "lo", "hi")], ("blob", pa.binary())])


class EliasFano:
    """A non-decreasing integer sequence: low bits packed, high bits in unary, ranks sampled for select."""

    def __init__(self, n: int, least: int, width: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.least, self.width, self.low, self.high, self.ranks = n, least, width, low, high, ranks

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return EliasFano(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        least = int(values[0])
        v = (values.astype(np.int64) - np.int64(least)).astype(np.uint64)
        width = max(0, (int(v[-1]) // n).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = -(-(int(ones[-1]) + 1) // _BLOCK) * _BLOCK
        high = np.zeros(size, np.uint8)
        high[ones] = 1
        ranks = np.concatenate(([0], np.cumsum(high.reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64))))[:-1].astype(np.uint32)
        return EliasFano(n, least, width, low, np.packbits(high, bitorder="little"), ranks)

    def select(self, i: np.ndarray) -> np.ndarray:
        """Values number i: the block by its rank sample, the byte by its ones, the bit within it."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        block = np.searchsorted(self.ranks, i, side="right") - 1
        per = _BLOCK // 8
        rows = self.high.reshape(-1, per)[block]
        upto = np.cumsum(np.bitwise_count(rows), axis=1, dtype=np.int64)
        rest = i - self.ranks[block]
        byte = (upto <= rest[:, None]).sum(axis=1)
        k = np.arange(len(i))
        rest -= np.where(byte > 0, upto[k, np.maximum(byte, 1) - 1], 0)
        in_byte = np.cumsum(np.unpackbits(rows[k, byte][:, None], axis=1, bitorder="little"), axis=1)
        bit = (in_byte <= rest[:, None]).sum(axis=1)
        return self._value(i, block * _BLOCK + byte * 8 + bit)

    def find(self, value: int) -> tuple[int, int]:
        """The numbers [a, b) of the values equal to value, by bisection on select."""
        out = []
        for right in (False, True):
            lo, hi = 0, self.n
            while lo < hi:
                mid = (lo + hi) // 2
                v = int(self.select(np.array([mid]))[0])
                lo, hi = (mid + 1, hi) if v < value or right and v == value else (lo, mid)
            out.append(lo)
        return out[0], out[1]

    def _value(self, i: np.ndarray, one: np.ndarray) -> np.ndarray:
        low = np.zeros(len(i), np.uint64)
        for b in range(self.width):
            at = i * self.width + b
            low |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return (((one - i).astype(np.uint64) << np.uint64(self.width)) | low).astype(np.int64) + self.least

    def dump(self) -> bytes:
        return _SEQ.pack(self.n, self.least, self.width, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.ranks.astype("<u4").tobytes()

    @staticmethod
    def load(buf: memoryview, at: int) -> tuple[EliasFano, int]:
        n, least, width, low, high = _SEQ.unpack_from(buf, at)
        at += _SEQ.size
        a = np.frombuffer(buf, np.uint8, low, at)
        b = np.frombuffer(buf, np.uint8, high, at + low)
        at += low + high
        c = np.frombuffer(buf, "<u4", high * 8 // _BLOCK, at)
        return EliasFano(n, least, width, a, b, c), at + 4 * len(c)


def pack(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """One shard; doc_ids ascending, nulls first; ends[k]: ids up to and including document k."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    head = _HEAD.pack(b"EFTK", 1, width, len(doc_ids), len(ids), len(doc_ids) - len(known))
    return head + EliasFano.of(np.asarray(ends)).dump() + EliasFano.of(known).dump() + ids.astype(f"<u{width}").tobytes()


class Shard:
    """A shard's documents, read in place: nulls, then doc_ids ascending."""

    def __init__(self, blob: bytes):
        buf = memoryview(blob)
        magic, version, width, self.n, total, self.nulls = _HEAD.unpack_from(buf, 0)
        if (magic, version) != (b"EFTK", 1):
            raise ValueError("not a token shard")
        self.ends, at = EliasFano.load(buf, _HEAD.size)
        self.known, at = EliasFano.load(buf, at)
        self.ids = np.frombuffer(buf, f"<u{width}", total, at)

    def edges(self, a: int, b: int) -> np.ndarray:
        """Where documents a to b - 1 begin, and where the last of them ends: b - a + 1 selects."""
        first = self.ends.select(np.arange(max(0, a - 1), b))
        return first if a else np.concatenate(([0], first))

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        lo, hi = max(a, self.nulls), max(b, self.nulls)
        return [None] * (min(b, self.nulls) - min(a, self.nulls)) + self.known.select(np.arange(lo, hi) - self.nulls).tolist()

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each document of that doc_id, without a look at any other's."""
        a, b = self.known.find(doc_id)
        edges = self.edges(a + self.nulls, b + self.nulls) if a < b else []
        return [self.ids[x:z] for x, z in zip(edges, edges[1:], strict=False)]


def cuts(df: DataFrame, parts: int) -> np.ndarray:
    """parts - 1 ascending doc_ids that part the rows about evenly; null counts as the smallest number, and a value that
    holds several parts' worth of rows occurs several times."""
    key = F.coalesce("doc_id", F.lit(_NULL))
    found = df.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    return np.array(found or [], np.int64)


def range_of(cut: np.ndarray, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Each row's range: between the cuts below its doc_id and those up to it, in order of the text hash."""
    lo, hi = np.searchsorted(cut, ids, side="left"), np.searchsorted(cut, ids, side="right")
    share = ((h >> np.int64(32)) + np.int64(1 << 31)).astype(np.float64) / (1 << 32)
    return (lo + np.floor(share * (hi - lo + 1)).astype(np.int64)).astype(np.int32)


def write_shards(df: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = 2_000_000, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode, append end_id to each document, and write shards of about shard_ids ids to a table at path."""
    spark = df.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("__text"))
    cut = spark.sparkContext.broadcast(cuts(rows, parts))  # a number per range
    rows = rows.withColumn("h", F.xxhash64("__text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        width = _width(c, end_id)
        for b in slices(batches, "__text", 2 << 20):
            ids, off = c.encode(texts(b, "__text"))
            ids = np.insert(ids, off[1:], end_id).astype(f"<u{width}")
            off = off + np.arange(len(off))
            docs, h = (b.column(b.schema.get_field_index(k)) for k in ("doc_id", "h"))
            part = range_of(cut.value, docs.fill_null(_NULL).to_numpy(), h.to_numpy())
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer((off * width).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([docs, h, pa.array(part), held], names=["doc_id", "h", "part", "ids"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        width = _width(coder(tokenizer), end_id)
        docs: list = []
        found: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, start, held
            blob = pack(docs, np.cumsum(np.concatenate(sizes)), np.concatenate(found), width)
            known = [d for d in (docs[0], docs[-1]) if d is not None]
            row = {"part": [part], "shard": [shard], "start": [start], "n_docs": [len(docs)], "n_ids": [held], "lo": known[:1] or [None], "hi": known[-1:] or [None], "blob": [blob]}
            shard, start, held = shard + 1, start + held, 0
            docs.clear(), found.clear(), sizes.clear()
            return pa.RecordBatch.from_pydict(row, schema=_TABLE)

        for b in batches:
            if not b.num_rows:
                continue
            at = 0
            ids = b.column(1)
            n = pc.binary_length(ids).to_numpy().astype(np.int64) // width
            while at < b.num_rows:  # as many documents as fill the shard
                upto = min(b.num_rows, at + 1 + int(np.searchsorted(np.cumsum(n[at:]), shard_ids - held)))
                docs += b.column(0)[at:upto].to_pylist()
                found.append(np.frombuffer(b"".join(ids[at:upto].to_pylist()), f"<u{width}"))
                sizes.append(n[at:upto])
                held, at = held + int(n[at:upto].sum()), upto
                if held >= shard_ids:
                    yield flush()
        if docs:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("ids")]
    encoded = rows.select("doc_id", "h", "__text").mapInArrow(encode, "doc_id long, h long, part int, ids binary")
    sorted_ = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions(*order)
    sorted_.select("doc_id", "ids").mapInArrow(gather, _DDL).write.parquet(path)


def _width(c, end_id: int) -> int:
    """Bytes per id."""
    return 2 if isinstance(c, PieceCoder) and len(c.token) <= 65536 and 0 <= end_id < 65536 else 4


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the shards at path, from the shards alone."""
    ship(spark)
    table = spark.read.schema(_DDL).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row per range
    bases, base = [], 0
    for part, n in totals:
        bases.append((part, base))
        base += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, start, blob in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                shard = Shard(blob)
                for a in range(0, shard.n, _BLOCK_DOCS):
                    z = min(shard.n, a + _BLOCK_DOCS)
                    edges = shard.edges(a, z)
                    crc = [zlib.crc32(shard.ids[x:y].astype("<u4").tobytes()) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * (z - a), pa.int32()), pa.array(shard.doc_ids(a, z), pa.int64()), pa.array(edges[:-1] + start, pa.int64()), pa.array(np.diff(edges), pa.int64()), pa.array(crc, pa.int64())],
                        names=["part", "doc_id", "local", "n_tokens", "ids_crc32"],
                    )

    rows = table.select("part", "start", "blob").mapInArrow(run, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    by_part = spark.createDataFrame(bases, "part int, base long")
    return rows.join(F.broadcast(by_part), "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """doc_id and ids of one document (of each row that repeats the doc_id): the shards whose bounds hold it are read,
    and of those only what select names."""
    ship(spark)
    table = spark.read.schema(_DDL).parquet(path).where((F.col("lo") <= doc_id) & (F.col("hi") >= doc_id)).select("blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                found = [x.astype(np.int64) for x in Shard(blob.as_py()).find(doc_id)]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return table.mapInArrow(run, "doc_id long, ids array<long>")


def store_and_read(df: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, shard_ids: int = 2_000_000) -> DataFrame:
    """Write the shards (to path, or to a scratch table of this application) and read every document back."""
    path = path or Scratch(df.sparkSession, "tokens").new_path("shards")
    write_shards(df, path, tokenizer, end_id, shard_ids)
    return read_shards(df.sparkSession, path)
