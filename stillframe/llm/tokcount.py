"""Operator 5: token counts without ids.

Texts are cut into pre-tokens. In each slice of a task's texts the distinct pre-tokens are joined to the texts'
pre-token frequencies, each with its number of pieces, which is found once per distinct pre-token (while it stays in
the worker's cache, bounded by entries and bytes) and kept as a number: no id list is stored or passed on. The join is
within the task, so nothing is shuffled. Other .json files do the same with their own pre-tokenizer; .model files, which
have none, count whole texts.

Defined results: null text is empty, with 0 bytes and 0 tokens; special strings inside texts count as the library's
default has it (one token each where the file names them); repeated rows give a row each; very long texts are counted
whole; an empty table gives no rows; columns not kept are ignored, a kept one named like an output gets `_in` appended
to its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import kept, ship, slices, texts
from .bpe import counter


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, n_bytes, n_tokens and over_limit (n_tokens > limit); one row per input row; map-only."""
    ship(df.sparkSession)
    outputs = ("n_bytes", "n_tokens", "over_limit")
    cols_in, names, ddl = kept(df, keep, outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for b in slices(batches, "__text", 4 << 20):
            raw = texts(b, "__text")
            n = c.count(raw)
            cols = [b.column(b.schema.get_field_index(k)) for k in names]
            cols += [pa.array(map(len, raw), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *outputs])

    return df.select(*cols_in, F.col(f"`{text}`").alias("__text")).mapInArrow(run, f"{ddl}n_bytes long, n_tokens long, over_limit boolean")
