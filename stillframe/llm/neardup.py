"""Operator 2: near-duplicate documents by MinHash, banding, verification and connected components.

1. One map-only pass: lower-case words, distinct word shingles as 64-bit hashes, `bands * rows` universal hash minima,
   a key per band, a one-byte sketch per minimum, and a digest of the word sequence. Rows with the same digest are one
   class; its smallest doc_id stands for it in all later steps.
2. Classes that share a band key are candidates. First every member of a bucket is compared with the bucket's leader;
   links join components. Where a bucket still holds several components, each pair of members of different components
   is compared inside tasks: the members outside the leader's component, in blocks of `block` rows by hash, meet each
   other's and the leader's component's blocks, which hold no more than `block` rows and about `block_bytes` of sets.
   So a bucket of copies of any size costs a comparison per member, no
   pair rows are made beyond the leaders', and no link between components is lost. A pair that shares several buckets
   is compared in the first one only, and a block returns a spanning forest of its links.
3. A candidate pair passes if its sketches agree often enough (seven standard deviations below the threshold's mean),
   then if its full shingle sets meet the threshold exactly. Sets are rebuilt for the documents concerned only, found
   through a bitmap of 8 bits an id (1 MB of bits at least, 32 MB at most: beyond some 30 million ids it lets more and
   more other documents through, which costs time and changes no result).
4. Links become components by large-star and small-star.

With 50 bands of 6 rows a pair at similarity 0.8 shares no band with probability (1 - 0.8^6)^50 = 2.5e-7.

Joins on a bucket's key deal the members of very frequent keys over several tasks (`_spread`): at most 10,000 keys can
hold more than a ten-thousandth of all members, and that list is broadcast.

Defined results: texts without words (or null) have an empty set and no links; with fewer words than a shingle the
whole sequence is the one shingle; very long texts are read whole, in a batch of their own; repeated rows and rows with
the same doc_id are the same document, whose links are those of all its texts; an empty table gives no rows; extra
columns are ignored, whatever their names. A row with a null doc_id is linked by its text like any other and takes the
component's smallest doc_id; identical texts without an id are one document. A component of such rows alone has a null
component_id, and each of them is kept; `drop_near_duplicates` leaves one of them. doc_ids are above -2^62.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Scratch, claim, ship, slices, texts
from .components import MADE, connected_components, named

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_LEAST_BITS, _MOST_BITS = 1 << 20, 1 << 28  # of the bitmap of documents to rebuild
_HOT = 2000  # members of a bucket that one task may get at least


class _Hashed(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


_WORDS = _Hashed()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(raw: list[bytes], k: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Each text's words and its sorted distinct shingle hashes."""
    if len(_WORDS) > 300_000:
        _WORDS.clear()
    split = [x.lower().split() for x in raw]
    n = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(split)), np.uint64, int(n.sum()))
    rolled = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for j in range(k):
        rolled = (rolled ^ ids[j : j + len(rolled)]) * _MIX[j % len(_MIX)] + np.uint64(j)
    rolled = _mix(rolled)
    at = 0
    for words, m in zip(split, n.tolist(), strict=True):
        if m >= k:
            yield words, np.unique(rolled[at : at + m - k + 1])
        elif m:
            yield words, np.array([xxhash.xxh64_intdigest(b"\x00".join(words), seed=m)], np.uint64)
        else:
            yield words, np.zeros(0, np.uint64)
        at += m


def coefficients(count: int, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the universal hash functions."""
    r = np.random.Generator(np.random.PCG64(seed))
    return r.integers(1, 1 << 32, count, np.uint32) | np.uint32(1), r.integers(0, 1 << 32, count, np.uint32)


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of a * x + b (32 bits) over the set, for every function."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        t = a[:, None] * x[None, k : k + 1024]
        t += b[:, None]
        np.minimum(out, t.min(axis=1), out=out)
    return out


def _signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n, digest, keys (one per band) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("neardup", _WORDS.clear)
        a, b = coefficients(bands * rows)
        odd = _MIX[np.arange(rows) % len(_MIX)] + np.arange(rows, dtype=np.uint64) * np.uint64(2)
        for batch in slices(batches, "__text", 4 << 20):
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            n, digest, mins = [], [], []
            for ws, h in shingle_sets(texts(batch, "__text"), words):
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(b" ".join(ws)) if ws else None)
                mins.append(minima(h, a, b) if ws else np.zeros(len(a), np.uint32))
            m = np.array(mins, np.uint32)
            keys = np.zeros((len(n), bands), np.uint64)
            for j in range(rows):
                keys = (keys ^ m[:, j::rows].astype(np.uint64)) * odd[j]
                keys ^= keys >> np.uint64(31)
            keys = _mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * _MIX[3]).view(np.int64)
            sketch = (m & np.uint32(255)).astype(np.uint8)
            offsets = np.arange(0, len(n) * bands + 1, bands).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())), pa.array([s.tobytes() for s in sketch], pa.binary())],
                names=["doc_id", "n", "digest", "keys", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, keys array<long>, sketch binary")


def _least(percent: int, count: int) -> int:
    """Agreeing minima that a pair at the threshold misses by seven standard deviations."""
    j = percent / 100
    return int(count * j - 7 * (count * j * (1 - j)) ** 0.5)


class Bitmap:
    """Bits at the hashes of a table's ids, 8 an id between the bounds: which rows may be among them."""

    def __init__(self, ids: DataFrame, column: str):
        """ids: a written table, counted and hashed in two cheap passes."""
        some = ids.agg(F.approx_count_distinct(column)).first()[0]
        self.size = min(_MOST_BITS, max(_LEAST_BITS, 1 << (8 * some).bit_length()))
        self.bits = np.zeros(self.size // 8, np.uint8)
        who = ids.select(self.at(F.col(column)).alias("x")).groupBy(F.expr("bitmap_bucket_number(x + 1)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x + 1))").alias("bits"))
        for r in who.collect():  # 8192 rows of 4 kB at most
            self.bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]).ljust(4096, b"\0"), np.uint8)

    def at(self, key) -> object:
        return F.pmod(F.xxhash64(key), F.lit(self.size))

    @staticmethod
    def holds(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc_id and hashes (sorted, 8 bytes each) of at least the documents in ids, by one map-only scan."""
    spark = docs.sparkSession
    bitmap = Bitmap(ids, "doc_id")
    shared = spark.sparkContext.broadcast(bitmap.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = shared.value
        claim("neardup", _WORDS.clear)
        for batch in slices(batches, "__text", 4 << 20):
            at = batch.column(batch.schema.get_field_index("x")).to_numpy()
            batch = batch.filter(pa.array(Bitmap.holds(mask, at)))
            if batch.num_rows:
                got = [h.tobytes() for _, h in shingle_sets(texts(batch, "__text"), words)]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(got, pa.binary())], names=["doc_id", "hashes"])

    return docs.where("doc_id is not null").withColumn("x", bitmap.at(F.col("doc_id"))).mapInArrow(run, "doc_id long, hashes binary")


def _hot_keys(counts: DataFrame) -> DataFrame:
    """key and parts of the buckets (key, c) with more than _HOT members and a ten-thousandth of all: 10,000 at most."""
    most = max(_HOT, (counts.agg(F.sum("c")).first()[0] or 0) // 10_000)
    return counts.where(F.col("c") > most).select("key", F.ceil(F.col("c") / most).cast("int").alias("parts"))


def _spread(rows: DataFrame, few: DataFrame, hot: DataFrame) -> DataFrame:
    """rows joined to few (one row a key) on key; rows of a hot key are dealt over its parts by a hash of rep."""
    parts = F.coalesce(F.col("parts"), F.lit(1))
    hot = F.broadcast(hot)
    left = rows.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("rep", F.lit("salt")), parts).cast("int")).drop("parts")
    right = few.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, ["key", "salt"]).drop("salt")


def _meets(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _star_links(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, scratch: Scratch, words: int, percent: int, count: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    least = _least(percent, count)
    left = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            ok = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    found = pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "sa", "sb").mapInArrow(alike, "a long, b long").distinct()
    found = scratch.save(found, "alike")
    sets = scratch.save(_sets(docs, found.select(F.explode(F.array("a", "b")).alias("doc_id")), words), "sets")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_meets(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    x, y = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb"))
    links = scratch.save(found.join(x, "a").join(y, "b").select("a", "b", "ha", "hb").mapInArrow(confirm, "a long, b long").distinct(), "links")
    scratch.drop(sets)
    scratch.drop(found)
    return links


def _root(parent: dict, x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def compare_block(t: pa.Table, least: int, percent: int) -> pa.Table:
    """A forest of the links between a block's two sides; rows of one root are taken as linked already."""
    key, i, j = (t.column(c)[0].as_py() for c in ("key", "i", "j"))
    rep, n, root, part = (t.column(c).to_numpy() for c in ("rep", "n", "root", "part"))
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1)
    keys = np.array(t.column("keys").to_pylist(), np.int64)
    hashes = t.column("hashes")
    xs, ys = np.flatnonzero(part == i), np.flatnonzero(part == j)
    parent: dict[int, int] = {}
    out = []
    for start in range(0, len(xs), 32):
        x = xs[start : start + 32]
        agree = (sketch[x][:, None, :] == sketch[ys][None, :, :]).sum(axis=2, dtype=np.int32)
        ok = (agree >= least) & (root[x][:, None] != root[ys][None, :])
        ok &= 100 * np.minimum(n[x][:, None], n[ys][None, :]) >= percent * np.maximum(n[x][:, None], n[ys][None, :])
        if i == j:
            ok &= x[:, None] < ys[None, :]
        p, q = np.nonzero(ok)
        if not len(p):
            continue
        order = np.argsort(-agree[p, q], kind="stable")
        a, b = x[p[order]], ys[q[order]]
        first = np.concatenate([(keys[a[s : s + 4096]] == keys[b[s : s + 4096]]).argmax(axis=1) for s in range(0, len(a), 4096)])
        here = keys[a, first] == key
        for u, v in zip(a[here].tolist(), b[here].tolist(), strict=True):
            ru, rv = _root(parent, int(root[u])), _root(parent, int(root[v]))
            if ru != rv and _meets(np.frombuffer(hashes[u].as_py(), np.uint64), np.frombuffer(hashes[v].as_py(), np.uint64), percent):
                parent[ru] = rv
                out.append((int(rep[u]), int(rep[v])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _block_links(members: DataFrame, reps: DataFrame, component: DataFrame, docs: DataFrame, scratch: Scratch, words: int, percent: int, count: int, block: int, block_bytes: int) -> DataFrame | None:
    """Links between members of a bucket that the leaders left in different components."""
    labelled = members.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("root"))
    labelled = scratch.save(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("rep", "root")).alias("lead"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi and c > 2")
    mixed = mixed.select("key", F.col("lead.rep").alias("lead"), F.col("lead.root").alias("lead_root"))
    hot = scratch.save(_hot_keys(labelled.groupBy("key").agg(F.count("*").alias("c"))), "hot")
    rows = _spread(labelled, mixed, hot).select("key", "rep", "root", (F.col("root") == F.col("lead_root")).alias("main"), (F.col("rep") == F.col("lead")).alias("first"))
    rows = scratch.save(rows, "mixed")
    scratch.drop(labelled)
    if rows.isEmpty():
        return None
    sizes = reps.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("n").alias("n"))
    rows = scratch.save(rows.where("not first").join(sizes, "rep"), "sized")  # the leader has met everyone

    def blocks_of(main: bool):
        here = F.col("main") if main else ~F.col("main")
        return F.ceil(F.greatest(F.count_if(here) / block, F.sum(F.when(here, F.col("n")).otherwise(0)) * 8 / block_bytes)).cast("int")

    blocks = rows.groupBy("key").agg(blocks_of(False).alias("rest"), blocks_of(True).alias("mains"), F.count_if(~F.col("main")).alias("c"))
    blocks = blocks.where("c > 1 or (c = 1 and mains > 0)").select("key", "rest", "mains")
    rows = _spread(rows.drop("n"), blocks, hot).withColumn("h", F.xxhash64("rep", F.lit("block")))
    rows = rows.withColumn("part", F.when(F.col("main"), F.col("rest") + F.pmod("h", F.col("mains"))).otherwise(F.pmod("h", F.col("rest"))).cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda x: F.struct(F.least(x, F.col("part")).alias("i"), F.greatest(x, F.col("part")).alias("j")))
    cross = F.transform(F.when(F.col("mains") > 0, F.sequence(F.lit(0), F.col("mains") - 1)).otherwise(F.array().cast("array<int>")), lambda y: F.struct(F.col("part").alias("i"), (F.col("rest") + y).alias("j")))
    units = rows.select("key", "rep", "root", "part", F.explode(F.when(F.col("main"), own).otherwise(F.concat(own, cross))).alias("u")).select("key", "rep", "root", "part", "u.i", "u.j")
    units = scratch.save(units, "units")
    sets = scratch.save(_sets(docs, units.select(F.col("rep").alias("doc_id")).distinct(), words), "sets")
    more = reps.select(F.col("doc_id").alias("rep"), "n", "sketch", "keys").join(sets.select(F.col("doc_id").alias("rep"), "hashes"), "rep")
    least = _least(percent, count)
    wide = units.join(more, "rep").select("key", "i", "j", "part", "rep", "root", "n", "sketch", "keys", "hashes")
    links = scratch.save(wide.groupBy("key", "i", "j").applyInArrow(lambda t: compare_block(t, least, percent), "a long, b long"), "blocklinks")
    scratch.drop(sets)
    scratch.drop(units)
    return links


def _components(docs: DataFrame, words: int, percent: int, bands: int, rows: int, block: int, block_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, n, node and digest of every row of docs (doc_id, __text), and node, component of linked nodes.

    A node is the smallest doc_id with the row's words, or a number that _with_ids made where none of them has one."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "neardup")
    all_rows = scratch.save(_signatures(docs, words, bands, rows), "signatures")
    known = F.min(F.when(F.col("doc_id") > MADE, F.col("doc_id")))
    classes = scratch.save(all_rows.where("digest is not null").groupBy("digest").agg(F.coalesce(known, F.min("doc_id")).alias("rep")), "classes")
    # a doc_id whose texts differ is one node: the sets and keys of all its texts count
    reps = all_rows.where("digest is not null").join(classes.select(F.col("rep").alias("doc_id")).where("doc_id is not null").distinct(), "doc_id", "left_semi")

    members = reps.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("lead"), F.max("rep").alias("hi")).where("lead < hi").select("key", "c", "lead")
    shared = scratch.save(shared, "shared")
    members = scratch.save(_spread(members, shared.drop("c"), scratch.save(_hot_keys(shared), "hot")).distinct(), "members")
    scratch.drop(shared)
    pairs = scratch.save(members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    reps = scratch.save(reps.dropDuplicates(["doc_id", "digest"]).join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "n", "sketch", "keys"), "reps")
    component = None
    if not pairs.isEmpty():
        links = _star_links(pairs, reps.select("doc_id", "n", "sketch"), docs, scratch, words, percent, bands * rows)
        component = connected_components(links, scratch)
        more = _block_links(members.select("key", "rep"), reps, component, docs, scratch, words, percent, bands * rows, block, block_bytes)
        if more is not None:
            component = connected_components(links.unionByName(more), scratch)
    out = all_rows.select("doc_id", "n", "digest").join(classes, "digest", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("node"))
    return out, component


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 50, rows: int = 6, text: str = "text", doc_id: str = "doc_id", block: int = 512, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id and kept; one row per input row."""
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("__text"))
    lost, docs = _with_ids(docs)
    out, component = _components(docs, words, percent, bands, rows, block, block_bytes)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.col("node").alias("rep"))
    if component is not None:
        if lost:
            component = named(component)
        out = out.join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("rep", F.coalesce("component", "rep"))
    if lost:  # numbers made here leave again
        out = out.select(*[F.when(F.col(c) > MADE, F.col(c)).alias(c) if c != "n_shingles" else c for c in ("doc_id", "n_shingles", "rep")])
    return out.select("doc_id", "n_shingles", F.col("rep").alias("component_id"), (F.col("rep").isNull() | F.coalesce(F.col("doc_id") == F.col("rep"), F.lit(False))).alias("kept"))


def _with_ids(docs: DataFrame) -> tuple[bool, DataFrame]:
    """Whether rows lack a doc_id, and docs with numbers below MADE in their place, equal for equal texts; texts
    without a word, which are linked with nothing, stay without."""
    if docs.where("doc_id is null").isEmpty():
        return False, docs
    return True, docs.withColumn("doc_id", F.coalesce("doc_id", _made("__text")))


def _made(text: str):
    return F.when(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(MADE) - 1 - F.xxhash64(F.col(f"`{text}`")).bitwiseAND(F.lit((1 << 61) - 1)))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs without all but one document of each component; of repeated rows of that document, one stays
    (that of the smallest text hash). Rows without a doc_id are documents by their text; one stays of a component of
    such rows alone."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "dedup")
    plain = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("__text"))
    lost, numbered = _with_ids(plain)
    own = "__doc"
    while own in docs.columns:
        own += "_"
    key = docs[doc_id].cast("long")
    if lost:
        key = F.coalesce(key, _made(text))
    found, component = _components(numbered, options.pop("words", 5), options.pop("percent", 80), options.pop("bands", 50), options.pop("rows", 6), options.pop("block", 512), options.pop("block_bytes", 4 << 20))
    if component is not None:
        component = named(component) if lost else component
        found = found.join(component, "node", "left").withColumn("node", F.coalesce("component", "node"))
    found = found.select("doc_id", (F.col("doc_id") == F.col("node")).alias("kept"))
    found = scratch.save(found, "found")
    gone = scratch.save(found.where("not kept").select(F.col("doc_id").alias(own)).distinct(), "gone")
    repeated = scratch.save(found.where("kept").groupBy(F.col("doc_id").alias(own)).count().where("count > 1").select(own), "repeated")
    # texts move only where the bitmap cannot tell that a document stays: no shuffle of the whole table
    bitmap = Bitmap(scratch.save(gone.unionByName(repeated), "listed"), own)
    shared = spark.sparkContext.broadcast(bitmap.bits)

    @F.pandas_udf("boolean")
    def listed(x: pd.Series) -> pd.Series:
        return pd.Series(Bitmap.holds(shared.value, x.to_numpy()))

    docs_ = docs.withColumn(own, key)
    mark = listed(bitmap.at(F.col(own)))
    sure, unsure = docs_.where(~mark), docs_.where(mark)
    left = unsure.join(gone, own, "left_anti")
    if not repeated.isEmpty():
        twice = left.join(repeated, own, "left_semi")
        first = twice.groupBy(own).agg(F.min(F.struct(F.coalesce(F.xxhash64(F.col(f"`{text}`")), F.lit(0)).alias("h"), *[F.col(f"`{c}`") for c in docs.columns])).alias("r")) if _orderable(docs) else None
        twice = first.select(own, *[F.col(f"r.`{c}`").alias(c) for c in docs.columns]) if first is not None else twice.dropDuplicates([own])
        left = left.join(repeated, own, "left_anti").unionByName(twice)
    return sure.unionByName(left).select(*[F.col(f"`{c}`") for c in docs.columns])


def _orderable(docs: DataFrame) -> bool:
    """Whether all columns have an order, so that the smallest row of several is defined."""
    return not any("map<" in t or "variant" in t for _, t in docs.dtypes)
