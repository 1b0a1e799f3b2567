"""Operator 6: language-model scores by context-tree weighting.

Texts are lower-cased (A-Z) bytes closed by a zero byte; a byte is eight binary decisions, each with a context tree over
the preceding bytes up to `depth` (zero bytes before the start). All training texts are counted: distinct
(depth + 1)-grams per task, summed by a shuffle. From the counts a node's Krichevsky-Trofimov block probability P_e has
a closed form, and bottom-up P_w = P_e / 2 + (product of the children's P_w) / 2, one grouped aggregation per depth. A
decision's probability mixes the KT estimates of the nodes on its path with weights w = P_e / (2 P_w) to stop at a node
and 1 - w to go on; contexts that training never saw end the path.

Every node is kept under its exact key. A first pass cuts the texts into slices (one task's texts, closed at 2^most_bits
distinct grams) and writes each slice's distinct grams and its packed rows. The nodes of a gram of depth 2 and more share
its last two context bytes, so grams dealt by those give all of their nodes within a task; depths 0 and 1 have at most
65,536 nodes, which are broadcast. Two-byte contexts with more than a thousandth of all distinct grams (999 at most) are
dealt by their third byte as well; their nodes of depth 2, 256 each, are broadcast with the others. The distinct grams' code lengths are joined to the slices' grams, and a slice is scored
with its own grams at hand. So nothing held at once grows with the corpus, and no two nodes ever share a count.

The base score is an add-one unigram word model over all training words. Word counts are shuffled by hash; the
`head_words` most frequent ones are broadcast (bounded), the rest of a text's words join the count table by hash,
which has no hot key left.

Defined results: null text is empty: its end is its only token; rows with a null doc_id count as id remainder 0, so they
train; repeated rows count and score each; without training rows N = 0 and V = 0; very long texts are read whole, in a
slice of their own; an empty table gives no rows; a kept
column named like an output gets `_in` appended to its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import Scratch, claim, kept, ship, slices, texts

_END = 0x0E6D  # the end token's key; words' keys are 64-bit hashes
_MUL = np.uint64(0x9E3779B97F4A7C15)


def grams(raw: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed (context, byte) of every byte of every closed text, and the texts' lengths."""
    pad = b"\0" * depth
    buf = np.frombuffer(b"".join(pad + x + b"\0" for x in raw), np.uint8).astype(np.uint64)
    n = np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw))
    size = max(0, len(buf) - depth)
    g = np.zeros(size, np.uint64)
    for k in range(depth + 1):
        g = (g << np.uint64(8)) | buf[k : k + size]
    keep = np.ones(size, bool)  # a window that starts in a text's last bytes and ends in the next one's padding is none
    ends = np.cumsum(n + depth)[:-1]
    for k in range(depth):
        keep[ends - depth + k] = False
    return g[keep], n


class _Codes(dict):
    def __missing__(self, key):
        v = self[key] = len(self)
        return v


class WordKeys:
    """Words' 64-bit keys, hashed once per distinct word while cached."""

    def __init__(self, most: int = 600_000):
        self.most = most
        self.codes, self.keys, self.known = _Codes(), np.zeros(1 << 16, np.int64), 0

    def of(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words of the texts in order, and the number of words of each."""
        split = [x.split() for x in raw]
        n = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        if len(self.codes) > self.known:
            from itertools import islice

            new = [*islice(reversed(self.codes), len(self.codes) - self.known)][::-1]
            while len(self.codes) > len(self.keys):
                self.keys = np.concatenate((self.keys, np.zeros_like(self.keys)))
            self.keys[self.known : len(self.codes)] = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new)).view(np.int64)
            self.known = len(self.codes)
        return codes, n

    def full(self) -> bool:
        return len(self.codes) > self.most

    def clear(self) -> None:
        self.codes.clear()
        self.known = 0


_PASS = "kind int, slice long, key long, n long, blob binary"  # kind 0 grams, 1 words, 2 packed rows
_SLICE_BYTES = 64 << 20
_LN2 = 0.6931471805599453
_HOT = 1000  # contexts of two bytes with more than one in so many distinct grams are dealt by a third byte


def _pack(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


def _tally(depth: int, most: int):
    """A task's texts in slices: each slice's rows, its distinct grams with their training counts (0 where only other
    texts have them), and partial counts of the training texts' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = WordKeys(), np.zeros(0, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        ends = size = 0
        at = TaskContext.get().partitionId() << 32

        def out(kind: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(key), 100_000):
                part = key[k : k + 100_000]
                cols = [np.full(len(part), kind, np.int32), np.full(len(part), at), part, n[k : k + 100_000]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.nulls(len(part), pa.binary())], names=["kind", "slice", "key", "n", "blob"])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, distinct = pd.factorize(np.concatenate([p[0] for p in parts]), sort=True)
            return distinct, np.bincount(codes, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for b in slices(batches, "__text", 2 << 20):
            raw = [x.lower() for x in texts(b, "__text")]
            train = np.array(b.column(b.schema.get_field_index("__train")).to_pylist(), bool)
            learn = [x for x, t in zip(raw, train, strict=True) if t]
            if learn:
                codes, _ = words.of(learn)
                counts = np.pad(counts, (0, max(0, words.known - len(counts)))) + np.bincount(codes, minlength=max(words.known, len(counts)))
                ends += len(learn)
            if words.full():
                yield from out(1, words.keys[: words.known], counts)
                words.clear()
                counts = np.zeros(0, np.int64)
            g, n = grams(raw, depth)
            codes, distinct = pd.factorize(g.view(np.int64))
            parts.append((distinct, np.bincount(codes, np.repeat(train, n), len(distinct)).astype(np.int64)))
            packed = pa.array([_pack(b.drop_columns(["__train"]))], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([at]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), packed], names=["kind", "slice", "key", "n", "blob"])
            size += len(g)
            if sum(len(p[0]) for p in parts) > 2_000_000:
                parts = [merged()]
            if len(parts[0][0]) >= most or size >= _SLICE_BYTES:
                yield from out(0, *merged())
                parts, size, at = [], 0, at + 1
        if parts:
            yield from out(0, *merged())
        if words.known:
            yield from out(1, words.keys[: words.known], counts)
        if ends:
            yield from out(1, np.array([_END]), np.array([ends]))

    return run


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma of x >= 1/2: Stirling's series at x + 8, shifted down."""
    y = x + 8
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _log_pe(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - 1.1447298858494002


def _node(key: np.ndarray, j: int) -> np.ndarray:
    """The partial byte before bit j of each gram's byte."""
    return (1 << j) | ((key & 255) >> (8 - j))


def _above(ids: np.ndarray, d: int) -> np.ndarray:
    """The nodes' ids at depth d: (context << 8) | partial byte, of the context's last d bytes."""
    return (((ids >> 8) & ((1 << (8 * d)) - 1)) << 8) | (ids & 255)


class _Level:
    """All nodes of one depth by id: counts, log P_w, weight to stop; `up` maps the nodes below to theirs."""

    def __init__(self, ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, split: np.ndarray | None):
        self.ids, self.up = np.unique(ids, return_inverse=True)
        add = lambda x: np.bincount(self.up, x, len(self.ids))
        self.n0, self.n1 = add(n0), add(n1)
        self.pw, self.stop = _log_pe(self.n0, self.n1), np.ones(len(self.ids))
        if split is not None:
            pe, self.pw = self.pw - _LN2, np.logaddexp(self.pw - _LN2, add(split) - _LN2)
            self.stop = np.exp(pe - self.pw)
        self.kt = (self.n1 + 0.5) / (self.n0 + self.n1 + 1)

    def mix(self, go: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the nodes above: the weight to go on below, the sum so far, and the estimate where the path ends here."""
        return go * (1 - self.stop), base + go * self.stop * self.kt, base + go * self.kt


def _levels(key: np.ndarray, n: np.ndarray, depth: int, last: int) -> list[_Level]:
    """The levels from `depth` up to `last` over grams with training counts."""
    key, n = key[n > 0], n[n > 0]
    ids = np.concatenate([((key >> 8) << 8) | _node(key, j) for j in range(8)])
    bit = np.concatenate([(key >> (7 - j)) & 1 for j in range(8)]).astype(bool)
    n = np.tile(n, 8).astype(float)
    out = [_Level(ids, np.where(bit, 0, n), np.where(bit, n, 0), None)]
    for d in range(depth - 1, last - 1, -1):
        x = out[-1]
        out.append(_Level(_above(x.ids, d), x.n0, x.n1, x.pw))
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _parts(key: np.ndarray, n: np.ndarray, hot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Grams whose nodes are whole within the task from depth 2 on, and those of hot contexts, whole from depth 3 on."""
    of = np.isin((key >> 8) & 0xFFFF, hot)
    for which, first in ((~of, 2), (of, 3)):
        if which.any():
            yield key[which], n[which], first


def _to_top(depth: int, hot: np.ndarray):
    """What a task's lowest whole nodes (of depth 1 where that is the deepest) add to those of the depth below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, first in _parts(*_gathered(batches), hot):
            if (n > 0).any():
                x = _levels(key, n, depth, min(depth, first))[-1]
                ids, up = np.unique(_above(x.ids, first - 1), return_inverse=True)
                cols = [np.full(len(ids), first - 1, np.int32), ids, *(np.bincount(up, y, len(ids)) for y in (x.n0, x.n1, x.pw))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["depth", "id", "n0", "n1", "split"])

    return run


def _top(nodes: pa.Table, depth: int) -> tuple[np.ndarray, ...]:
    """For each of the 65,536 nodes of depth 1: weight to go on, sum so far, estimate where the path ends there or above;
    then the ids of the hot contexts' nodes of depth 2, and the same of these."""
    go, base, end = np.zeros(1 << 16), np.zeros(1 << 16), np.full(1 << 16, 0.5)
    if not nodes.num_rows:
        return go, base, end, np.zeros(0, np.int64), *[np.zeros(0)] * 3
    d, *cols = (nodes.column(k).to_numpy() for k in ("depth", "id", "n0", "n1", "split"))
    two = _Level(*(x[d == 2] for x in cols))
    ids, n0, n1, split = (np.concatenate((x[d == 1], y)) for x, y in zip(cols, (_above(two.ids, 1), two.n0, two.n1, two.pw), strict=True))
    one = _Level(ids, n0, n1, split if depth > 1 else None)
    root = _Level(_above(one.ids, 0), one.n0, one.n1, one.pw)
    above = root.mix(np.ones(len(root.ids)), np.zeros(len(root.ids)))
    every = np.arange(1 << 16) & 255
    at = np.minimum(np.searchsorted(root.ids, every), len(root.ids) - 1)
    end = np.where(root.ids[at] == every, above[2][at], 0.5)
    go[one.ids], base[one.ids], end[one.ids] = one.mix(above[0][root.up], above[1][root.up])
    return go, base, end, two.ids, *two.mix(go[_above(two.ids, 1)], base[_above(two.ids, 1)])


def _code_lengths(depth: int, hot: np.ndarray, top):
    """log10 probability of each gram's byte after its context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        go, base, end, two, *of_two = top.value
        for key, n, first in _parts(*_gathered(batches), hot):
            ends: list[tuple[np.ndarray, np.ndarray]] = [(two, of_two[2])] if first == 3 and len(two) else []  # ids and estimates, from depth 2 down
            if depth >= first and (n > 0).any():
                levels = _levels(key, n, depth, first)[::-1]
                at = _above(levels[0].ids, first - 1)
                here = (go[at], base[at]) if first == 2 else [x[np.searchsorted(two, at)] for x in of_two[:2]]
                for k, x in enumerate(levels):
                    if k:
                        here = here[0][levels[k - 1].up], here[1][levels[k - 1].up]
                    *here, stop = x.mix(*here)
                    ends.append((x.ids, stop))
            total = np.zeros(len(key))
            for j in range(8):
                ids = ((key >> 8) << 8) | _node(key, j)
                p = end[_above(ids, 1)]
                for d, (known, stop) in enumerate(ends, 2):
                    want = _above(ids, d)
                    at = np.minimum(np.searchsorted(known, want), len(known) - 1)
                    p = np.where(known[at] == want, stop[at], p)
                total += np.log10(np.where((key >> (7 - j)) & 1, p, 1 - p))
            for k in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 100_000]), pa.array(total[k : k + 100_000])], names=["key", "v"])

    return run


class _Lengths:
    """The code lengths of a slice's grams: most by one look-up, those that share a place by search."""

    def __init__(self, key: np.ndarray, v: np.ndarray):
        order = np.argsort(key)
        self.key, self.v = key[order].view(np.uint64), v[order]
        self.bits = max(8, len(key).bit_length() + 1)
        self.place = np.zeros(1 << self.bits, np.int64)
        self.place[self._at(self.key)] = np.arange(len(key))

    def _at(self, g: np.ndarray) -> np.ndarray:
        return ((g * _MUL) >> np.uint64(64 - self.bits)).astype(np.int64)

    def score(self, raw: list[bytes], depth: int) -> np.ndarray:
        g, n = grams(raw, depth)
        at = self.place[self._at(g)]
        miss = self.key[at] != g
        if miss.any():
            codes, distinct = pd.factorize(g[miss])
            found = np.searchsorted(self.key, distinct)
            if (self.key[np.minimum(found, len(self.key) - 1)] != distinct).any():
                raise ValueError("a slice lacks one of its grams")
            at[miss] = found[codes]
        return np.add.reduceat(self.v[at], np.cumsum(n) - n) if len(n) else np.zeros(0)


def score(df: DataFrame, train: Column, depth: int = 5, most_bits: int = 22, head_words: int = 1 << 18, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, n_tokens, n_known, train_tokens, base_score and score (log10), one row per input row."""
    outputs = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "__slice", "__uid", "__known", "__sum", "__tail", "__train", "__more", "__found")
    cols_in, keep, ddl = kept(df, keep, outputs)
    if not 1 <= depth <= 6:
        raise ValueError("depth is 1 to 6: a gram has to fit in a long")
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ctw")
    rows = df.select(*cols_in, F.col(f"`{text}`").alias("__text"), F.coalesce(train, F.lit(False)).alias("__train"))
    told = scratch.save(rows.mapInArrow(_tally(depth, 1 << most_bits), _PASS), "slices")
    counts = scratch.save(told.where("kind < 2").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    part = lambda shift, mask: F.shiftright("key", shift).bitwiseAND(F.lit(mask).cast("long"))
    per = counts.where("kind = 0").groupBy(part(8, 65535).alias("of")).agg(F.count("*").alias("n")).toArrow()  # 65,536 rows at most
    many = per.column("n").to_numpy()
    hot = np.sort(per.column("of").to_numpy()[many * _HOT > many.sum()]) if depth > 2 else np.zeros(0, np.int64)
    dealt = counts.where("kind = 0").select("key", "n").repartition(part(8, 65535), F.when(part(8, 65535).isin(hot.tolist()), part(24, 255)))
    tops = dealt.mapInArrow(_to_top(depth, hot), "depth int, id long, n0 double, n1 double, split double").groupBy("depth", "id")
    top = spark.sparkContext.broadcast(_top(tops.agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "split")]).toArrow(), depth))  # 65,536 rows at most, and 256 a hot context
    lengths = dealt.mapInArrow(_code_lengths(depth, hot, top), "key long, v double")
    pairs = told.where("kind = 0").select("slice", "key").join(lengths.hint("shuffle_hash"), "key").select(F.col("slice").alias("of"), "key", "v")

    words = counts.where("kind = 1").select("key", "n")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = int(total["n"] or 0), int(total["v"])
    head = words.orderBy(F.desc("n"), "key").limit(head_words).toArrow()  # 16 bytes each
    key, n = head.column("key").to_numpy(), head.column("n").to_numpy()
    order = np.argsort(key)
    common = spark.sparkContext.broadcast((key[order], n[order]))
    ends = n[key == _END]
    end_count = int(ends[0]) if len(ends) else int((words.where(F.col("key") == _END).agg(F.sum("n")).first()[0]) or 0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        claim("ctw", lambda: None)
        at = left.column("slice")[0].as_py() if left.num_rows else 0
        lengths_ = _Lengths(right.column("key").to_numpy(), right.column("v").to_numpy())
        del right
        hk, hn = common.value
        words_, gain = WordKeys(), np.zeros(0)
        known, tail = np.zeros(0, bool), np.zeros(0, bool)
        done_, row = [], 0
        for blob in left.column("blob"):
            b = pa.ipc.open_stream(blob.as_buffer()).read_next_batch()
            if words_.full():
                words_.clear()
                gain, known, tail = np.zeros(0), np.zeros(0, bool), np.zeros(0, bool)
            raw = [x.lower() for x in texts(b, "__text")]
            codes, n = words_.of(raw)
            if words_.known > len(gain):
                new = words_.keys[len(gain) : words_.known]
                where = np.minimum(np.searchsorted(hk, new), max(0, len(hk) - 1))
                hit = hk[where] == new if len(hk) else np.zeros(len(new), bool)
                gain = np.concatenate((gain, np.where(hit, np.log10((hn[where] if len(hk) else np.zeros(len(new))) + 1.0), 0.0)))
                known, tail = np.concatenate((known, hit)), np.concatenate((tail, ~hit & (len(hk) >= head_words)))
            owner = np.repeat(np.arange(len(raw)), n)
            sums = np.bincount(owner, gain[codes], len(raw)) + np.log10(end_count + 1.0)
            found = np.bincount(owner, known[codes], len(raw)).astype(np.int64) + (end_count > 0)
            rare = tail[codes]
            per = np.bincount(owner[rare], minlength=len(raw))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32)), pa.array(words_.keys[codes[rare]]))
            cols = [b.column(b.schema.get_field_index(k)) for k in keep]
            cols += [pa.array(np.full(len(raw), at)), pa.array(row + np.arange(len(raw))), pa.array(n + 1), pa.array(found), pa.array(sums), pa.array(lengths_.score(raw, depth)), lists]
            row += len(raw)
            done_.append(pa.RecordBatch.from_arrays(cols, names=[*keep, "__slice", "__uid", "n_tokens", "__known", "__sum", "score", "__tail"]))
        return pa.Table.from_batches(done_)

    packed = told.where("kind = 2").select("slice", "blob").groupBy("slice")
    done = scratch.save(packed.cogroup(pairs.groupBy("of")).applyInArrow(run, f"{ddl}__slice long, __uid long, n_tokens long, __known long, __sum double, score double, __tail array<long>"), "scored")
    rare = done.select("__slice", "__uid", F.explode("__tail").alias("key")).groupBy("__slice", "__uid", "key").agg(F.count("*").alias("f"))
    rare = rare.join(words, "key").groupBy("__slice", "__uid").agg(F.sum(F.col("f") * F.log10(F.col("n") + 1.0)).alias("__more"), F.sum("f").alias("__found"))
    return done.drop("__tail").join(rare, ["__slice", "__uid"], "left").select(
        *keep,
        "n_tokens",
        (F.col("__known") + F.coalesce("__found", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("__sum") + F.coalesce("__more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n_all + v_all + 1)))).alias("base_score"),
        "score",
    )
