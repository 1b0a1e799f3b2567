r"""Operator 1: chat formatting by columnar byte assembly.

A turn becomes `### ` + role + `: ` + text + `</turn>` + line feed, a conversation its turns in order. In roles and
texts a backslash goes before each backslash, `#` and `<`, in roles also before `:`, so that no text can hold the
template's marks and reading back is exact.

Rows are dealt by conversation and sorted within partitions; batches stream through the assembler, which holds back
only a batch's last conversation; batches are cut at about 4 MB of text, as the index arrays weigh some 30 bytes for each
of theirs. Per batch it computes segment lengths, cumulative offsets and scatter indices in
numpy and copies headers, contents and end marks into one preallocated buffer that becomes the Arrow column as it is.
A conversation becomes one value, so it has to fit in one (2 GB); nothing else is gathered.

Defined results: null roles and texts are empty; turns go by turn (nulls first), then role, then text; repeated rows are
repeated turns; rows with a null conv_id form one conversation without id; an empty table gives no rows; other columns
are not read, whatever their names; a text longer than a batch is a batch of its own, and whole; the loss mask
covers the texts of turns whose role is `assistant`, as code point ranges of the formatted text, escapes included.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import ship, slices

_SPECIAL = np.zeros(256, bool)
_SPECIAL[list(b"\\#<")] = True
_END = np.frombuffer(b"</turn>\n", np.uint8)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.)*+)</turn>\n", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _header(role: str) -> bytes:
    return b"### " + re.sub(r"([\\#<:])", r"\\\1", role).encode() + b": "


def assemble(batch: pa.Table, loss_role: str = "assistant") -> pa.RecordBatch:
    """One row per conversation: conv_id, formatted, loss. Rows arrive sorted; batch has whole conversations."""
    ids = batch.column("conv_id").combine_chunks()
    n = len(ids)
    key = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    null = pc.is_null(ids).to_numpy(zero_copy_only=False)
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])))
    text = pc.fill_null(batch.column("text").combine_chunks().cast(pa.large_binary()), b"")
    _, off_buf, data_buf = text.buffers()
    off = np.frombuffer(off_buf, np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8)[off[0] : off[-1]] if data_buf is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    roles = pc.fill_null(batch.column("role").combine_chunks().cast(pa.string()), "").dictionary_encode()
    names, role = roles.dictionary.to_pylist(), roles.indices.to_numpy()
    headers = [np.frombuffer(_header(r), np.uint8) for r in names]

    special = _SPECIAL[data]
    before = np.concatenate(([0], np.cumsum(special)))  # specials before each byte
    head = np.fromiter(map(len, headers), np.int64, len(headers))[role]
    body = np.diff(off) + before[off[1:]] - before[off[:-1]]
    size = head + body + len(_END)
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    at = np.repeat(start + head - off[:-1] - before[off[:-1]], np.diff(off)) + np.arange(len(data)) + before[1:]
    out[at] = data
    out[at[special] - 1] = 0x5C
    for k, h in enumerate(headers):
        rows = np.flatnonzero(role == k)
        out[start[rows][:, None] + np.arange(len(h))] = h
    out[(start + head + body)[:, None] + np.arange(len(_END))] = _END

    first = np.flatnonzero(new)
    edges = np.concatenate((start[first], [len(out)]))
    points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))  # code points before each byte
    lost = role == (names.index(loss_role) if loss_role in names else -1)
    conv = np.cumsum(new) - 1
    zero = points[edges[conv]]
    a, b = (points[start + head] - zero)[lost], (points[start + head + body] - zero)[lost]
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(conv[lost], minlength=len(first))))).astype(np.int32)), pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["start", "end"]))
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), formatted.cast(pa.string()), spans], names=["conv_id", "formatted", "loss"])


def format_chats(df: DataFrame, loss_role: str = "assistant", max_bytes: int = 4 << 20) -> DataFrame:
    """conv_id, formatted and loss (ranges) of every conversation of (conv_id, turn, role, text)."""
    ship(df.sparkSession)
    rows = df.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # batches whose rows are all of one conversation, the last one seen
        for b in slices(batches, "text", max_bytes):
            ids = b.column(0)
            last = ids[b.num_rows - 1]
            same = pc.is_null(ids) if not last.is_valid else pc.fill_null(pc.equal(ids, last), False)
            cut = pc.index(same, True).as_py()
            if cut or (held and held[-1].column(0)[0] != last):
                yield assemble(pa.Table.from_batches([*held, b.slice(0, cut)]), loss_role)
                held = []
            held.append(b.slice(cut))
        if held:
            yield assemble(pa.Table.from_batches(held), loss_role)

    return rows.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, formatted string, loss array<struct<start:bigint,end:bigint>>")


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def read_back(df: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from their text and loss ranges alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, text, loss in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                turns = read_turns(text)
                lost = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(text)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return df.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
