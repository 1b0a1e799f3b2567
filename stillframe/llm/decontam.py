"""Operator 3: benchmark decontamination by a prefix-filtered set join.

A window is `window` consecutive words of an item (the whole item where it has fewer). A text holds a window only if it
holds all of the window's word shingles, so a prefix of one shingle is necessary: each window is posted under the
shingle of it that is rarest in all the documents (one counting pass). The second pass looks up the documents'
shingles, applies the positional and length bounds (the window has to start and end inside the text) and verifies the
words of the whole window. Words are compared as numbers of the benchmark's own vocabulary, so equality is exact.

Both passes are map-only over whole texts. The index of the benchmark is broadcast in blocks of at most
`block_bytes` of item text, measured first; a larger benchmark takes one scan per block, and the blocks' hits are
merged per document, so memory stays bounded at any benchmark size.

Defined results: null and empty texts have no words; items without words have no window; items with a null id hit words
but are listed nowhere; repeated items count once; repeated documents get a row each; very
long texts are read whole, in a batch of their own; an empty benchmark hits nothing, an empty table gives no rows; a kept
column named like an output gets `_in` appended to its name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Scratch, claim, kept, ship, slices, texts

#: Byte table: A-Z to a-z, digits, a-z and bytes of non-ASCII characters stay, all else separates words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass
class Index:
    """Windows of one block of items, by length; shingles of k words by hash."""

    vocab: dict[bytes, int]
    windows: list[tuple[int, ...]]  # distinct
    items: list[list[str]]  # each window's items
    keys: dict[int, np.ndarray]  # shingle length: sorted distinct hashes
    posts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # shingle length: edges by key, window, offset in it


def _hashes(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of k consecutive known words, and their hashes."""
    size = len(ids) - k + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = np.concatenate(([0], np.cumsum(ids != 0)))
    at = np.flatnonzero(known[k:] - known[:-k] == k)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = (h ^ ids[at + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return at, h


def build(items: list[tuple[str | None, bytes]], window: int, shingle: int) -> Index:
    vocab: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for item, text in items:
        ids = tuple(vocab.setdefault(w, len(vocab) + 1) for w in words(text))
        size = min(window, len(ids))
        for k in range(len(ids) - size + 1 if ids else 0):
            found[ids[k : k + size]] |= {item} - {None}
    windows = sorted(found)
    keys = {}
    for k in sorted({min(shingle, len(w)) for w in windows}):
        keys[k] = np.unique(np.concatenate([_hashes(np.array(w), k)[1] for w in windows if min(shingle, len(w)) == k]))
    return Index(vocab, windows, [sorted(found[w]) for w in windows], keys, {})


def post(index: Index, counts: dict[int, np.ndarray], shingle: int) -> None:
    """Post each window under its rarest shingle (ties: the smaller hash)."""
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for n, w in enumerate(index.windows):
        k = min(shingle, len(w))
        at, h = _hashes(np.array(w), k)
        key = np.searchsorted(index.keys[k], h)
        best = int(np.lexsort((key, counts[k][key]))[0])
        if counts[k][key[best]]:  # a shingle that occurs nowhere: neither does the window
            rows[k].append((int(key[best]), n, int(at[best])))
    index.posts = {}
    for k, r in rows.items():
        a = np.array(sorted(r), np.int64)
        index.posts[k] = (np.searchsorted(a[:, 0], np.arange(len(index.keys[k]) + 1)), a[:, 1], a[:, 2])


def _numbered(index: Index, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts as vocabulary numbers with a 0 after each text; each text's first position and word count."""
    split = [words(x) for x in raw]
    n = np.fromiter(map(len, split), np.int64, len(split))
    first = np.cumsum(n + 1) - (n + 1)
    ids = np.fromiter(map(index.vocab.get, chain.from_iterable(chain(s, (b" ",)) for s in split), repeat(0)), np.int64, int(n.sum()) + len(n))
    return ids, first, n


def count_shingles(index: Index, raw: list[bytes], counts: dict[int, np.ndarray]) -> None:
    ids, _, _ = _numbered(index, raw)
    for k, keys in index.keys.items():
        _, h = _hashes(ids, k)
        where = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        counts[k] += np.bincount(where[keys[where] == h], minlength=len(keys))


def match(index: Index, raw: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Each text's word count, hit word ranges (disjoint, ascending) and items, sorted as strings."""
    ids, first, n = _numbered(index, raw)
    owner_of = lambda p: np.searchsorted(first, p, side="right") - 1
    hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for k, (edges, which, offset) in index.posts.items():
        keys = index.keys[k]
        at, h = _hashes(ids, k)
        key = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        ok = keys[key] == h
        at, key = at[ok], key[ok]
        many = edges[key + 1] - edges[key]
        at, key = np.repeat(at, many), np.repeat(key, many)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        w = which[edges[key] + nth]
        start = at - offset[edges[key] + nth]
        for a, own, win in zip(start.tolist(), owner_of(at).tolist(), w.tolist(), strict=True):
            ws = index.windows[win]
            if first[own] <= a and a + len(ws) <= first[own] + n[own] and tuple(ids[a : a + len(ws)].tolist()) == ws:
                hits[own].append((a - int(first[own]), a - int(first[own]) + len(ws), win))
    ranges: list[list[tuple[int, int]]] = [[] for _ in raw]
    items: list[list[str]] = [[] for _ in raw]
    for own, found in hits.items():
        ranges[own] = merge_ranges([(a, b) for a, b, _ in found])
        items[own] = sorted({i for _, _, win in found for i in index.items[win]})
    return n, ranges, items


def merge_ranges(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, block_bytes: int = 8 << 20, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns keep (the doc_id), n_words, hits (word ranges) and items (ids as strings); one row per document row."""
    spark = docs.sparkSession
    ship(spark)
    keep = (doc_id,) if keep is None else keep
    given = tuple(keep)
    cols_in, keep, _ = kept(docs, keep, ("n_words", "hits", "items", "__row", "h", "i"))
    items = benchmark.select(benchmark[item_id].cast("string").alias("item"), benchmark[text].alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    own = keep[given.index(text)] if text in given else "__text"  # a kept text is not sent twice
    rows = docs.select(*cols_in, *[F.col(f"`{text}`").alias("__text")] * (text not in given))
    if blocks == 1:
        return _one_block(rows, [(r["item"], r["text"].encode()) for r in items.collect()], window, shingle, keep, own)
    scratch = Scratch(spark, "decontam")
    keyed = rows.withColumn("__row", F.xxhash64(*[F.col(c) for c in rows.columns]))
    parts = []
    for k in range(blocks * 2):  # halves of the mean, so that an uneven hash stays under the bound
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks * 2)) == k)
        got = _one_block(keyed, [(r["item"], r["text"].encode()) for r in block.toLocalIterator()], window, shingle, ("__row",), own)
        parts.append(scratch.save(got.where("size(hits) > 0").distinct(), f"block{k}"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("__row").agg(F.flatten(F.collect_list("hits")).alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    none_r, none_i = F.array().cast("array<struct<start:bigint,end:bigint>>"), F.array().cast("array<string>")
    joined = _one_block(keyed, [], window, shingle, (*keep, "__row"), own).drop("hits", "items").join(found, "__row", "left")
    return joined.select(*keep, "n_words", F.coalesce(_merged("h"), none_r).alias("hits"), F.coalesce("i", none_i).alias("items"))


def _merged(col: str):
    """Disjoint ascending ranges of an array of ranges, in SQL."""
    return F.expr(
        f"aggregate(array_sort({col}), cast(array() as array<struct<start:bigint,end:bigint>>), (acc, x) -> if(size(acc) > 0 and x.start <= element_at(acc, -1).end,"
        " concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(x.end, element_at(acc, -1).end)))),"
        " concat(acc, array(named_struct('start', x.start, 'end', x.end)))))"
    )


def _one_block(rows: DataFrame, items: list[tuple[str | None, bytes]], window: int, shingle: int, keep, own: str) -> DataFrame:
    spark = rows.sparkSession
    index = build(items, window, shingle)
    if index.keys:
        bare = spark.sparkContext.broadcast(index)  # at most block_bytes of items

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = bare.value
            claim("decontam", int)
            counts = {k: np.zeros(len(v), np.int64) for k, v in ix.keys.items()}
            for b in slices(batches, own, 4 << 20):
                count_shingles(ix, texts(b, own), counts)
            for k, c in counts.items():
                where = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), k), pa.int32()), pa.array(where, pa.int32()), pa.array(c[where], pa.int64())], names=["k", "key", "n"])

        counts = {k: np.zeros(len(v), np.int64) for k, v in index.keys.items()}
        for r in rows.select(own).mapInArrow(tally, "k int, key int, n long").groupBy("k", "key").agg(F.sum("n").alias("n")).collect():  # a row per benchmark shingle at most
            counts[r["k"]][r["key"]] = r["n"]
        post(index, counts, shingle)
    shared = spark.sparkContext.broadcast(index)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        claim("decontam", int)
        for b in slices(batches, own, 4 << 20):
            n, ranges, found = match(ix, texts(b, own))
            cols = [b.column(b.schema.get_field_index(k)) for k in keep]
            cols += [pa.array(n, pa.int64()), pa.array([[{"start": a, "end": z} for a, z in r] for r in ranges], _RANGES), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_words", "hits", "items"])

    return rows.mapInArrow(run, f"{fields}{', ' * bool(keep)}n_words long, hits array<struct<start:bigint,end:bigint>>, items array<string>")
