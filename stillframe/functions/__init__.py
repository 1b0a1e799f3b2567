"""Scalar expressions on snapshot rows: keys, days, digests, typed parsing. All built-in functions, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_of(pk: str) -> Column:
    """The key's identity: its string form, so that -0.0 and 0.0 are two keys."""
    return F.col(f"`{pk}`").cast("string")


def join_key(pk: str, kind: str) -> Column:
    """The same identity in its cheapest type: whole numbers as they are, all else by its string form."""
    return F.col(f"`{pk}`").cast("long") if kind in ("INT", "LONG") else key_of(pk)


def is_blank(key: Column, kind: str) -> Column:
    """Null, empty or white space only, Unicode spaces included."""
    return key.isNull() | key.rlike(r"^(?U)\s*$") if kind == "STRING" else key.isNull()


def local_day(ts: Column, zone: str) -> Column:
    """The calendar day of epoch milliseconds in a zone."""
    return F.from_utc_timestamp(_utc(ts), zone).cast("date")


def day_start(ts: Column, zone: str) -> Column:
    """Epoch milliseconds of the start of that day."""
    at = F.date_trunc("DAY", F.from_utc_timestamp(_utc(ts), zone))
    return F.unix_millis(F.to_utc_timestamp(at, zone))


def _utc(ts: Column) -> Column:
    """The instant, shifted so that from_utc_timestamp reads UTC whatever the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_millis(ts).cast("timestamp_ntz")).cast("timestamp")


def typed(raw: Column, kind: str) -> Column:
    """A text cell's value, null where it can't be parsed: numbers are trimmed, strings are not."""
    if kind == "STRING":
        return raw
    cell = F.trim(raw)
    if kind == "DOUBLE":
        cell = F.when(~F.lower(cell).rlike(r"^[+-]?inf$"), cell)
        return cell.try_cast("double")
    return F.when(cell.rlike(r"^[+-]?[0-9]+$"), cell).try_cast("int" if kind == "INT" else "bigint")


def row_digest(columns: list[tuple[str, str]], seed: int) -> Column:
    """64 bits of a row: of each column whether it is null, and its value (doubles by their text: -0.0 is not 0.0).

    A row's position is no part of it: keys are unique in a snapshot, so the sum over its rows says which rows there are,
    however they are dealt over partitions.
    """
    parts = [F.lit(seed)]
    for name, kind in columns:
        c = F.col(f"`{name}`")
        parts += [c.isNull(), c.cast("string") if kind == "DOUBLE" else c]
    return F.xxhash64(*parts)


def place_digest(key: str) -> Column:
    """31 bits of a key. Their sum weighted with the rows' positions says in which order the rows are; taking the first
    position times their plain sum from it makes it count from the first row, wherever a source starts to count."""
    return F.xxhash64(F.lit(3), F.col(key)).bitwiseAND(F.lit((1 << 31) - 1))
