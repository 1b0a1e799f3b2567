"""Operator 4: near-duplicate embeddings by PCA-ordered tiled comparison.

Equal vectors are one class, compared once. Vectors are normalised, rotated to principal axes (fitted on a bounded
sample; a rotation changes no cosine), and dealt into tiles along the first axis. Two unit vectors with cosine c are
sqrt(2 - 2c) apart, so tiles further apart on the axis than that need no comparison. A pair of tiles is compared by
accumulating the leading axes first: the product of the remaining norms bounds what is missing, one matrix product
gives sum and bound for all pairs. Tiles hold the first quarter of the axes and the norm of the rest, in single
precision, and nothing else; a pair of tiles names its rows with a partner that can still reach the threshold, and only
their whole vectors are sent to be compared, at last by the cosine of the original vectors in double precision. A pair
of tiles returns row ids, link counts and a spanning forest, never all pairs or links.

Tiles have at most about `tile` vectors, and at most 16 MB of whole ones: one that gets more (equal positions on the
axis) is split by hash. Comparing stays quadratic in the distinct vectors within reach on the axis.

Where more than one pair in fifty survives the leading axes of a block of rows, one product of the whole vectors takes
the place of the steps in between; the final test, and so the result, is the same.

Defined results: null, zero, non-finite or null-holding vectors have no links; vectors of different lengths are not
compared; equal vectors are linked; a cosine equal to the threshold links; rows that repeat a vec_id are one node, each
row counting as a vector; a row with a null vec_id is compared and counted like any other, has null component_id and is
not kept, and a component is named by its smallest vec_id that is not null (vec_ids are above -2^62). Columns other
than the two named are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Scratch, ship
from .components import MADE, connected_components, named

_TILE = "tile long, lo double, hi double, ids binary, leads binary"


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, dim, vector (little-endian doubles) and digest; null vector where it links with nothing."""
    for b in batches:
        ids = b.column(0)
        dims, vectors, digests = [], [], []
        for v in b.column(1):
            a = None
            if v.is_valid and len(v) and not v.values.null_count:
                a = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                with np.errstate(over="ignore", under="ignore"):
                    norm = np.sqrt((a * a).sum())
                if not np.isfinite(a).all() or not np.isfinite(norm) or norm == 0:
                    m = np.abs(a).max()  # scale first: squares may overflow or vanish
                    a = a if np.isfinite(m) and m > 0 else None
            dims.append(len(a) if a is not None else None)
            vectors.append(a.tobytes() if a is not None else None)
            digests.append(xxhash.xxh3_128_digest(vectors[-1]) if a is not None else None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(dims, pa.int32()), pa.array(vectors, pa.binary()), pa.array(digests, pa.binary())], names=["vec_id", "dim", "vector", "digest"])


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def compare(a: np.ndarray, b: np.ndarray, same: bool, size_a: np.ndarray, size_b: np.ndarray, basis: np.ndarray, threshold: float, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Link counts of the rows of a and of b (0 for b if it is the same tile), and each row's parent in a forest of
    links over both (b's rows after a's)."""
    a, b = _unit(a), a if same else _unit(b)
    b = a if same else b
    ra = (a @ basis).astype(np.float32)
    rb = ra if same else (b @ basis).astype(np.float32)
    slack = np.float32(threshold - 1e-4)
    tails = [(np.sqrt(np.maximum(0, (ra[:, k:].astype(float) ** 2).sum(axis=1))), np.sqrt(np.maximum(0, (rb[:, k:].astype(float) ** 2).sum(axis=1)))) for k in steps]
    k = steps[0]
    left = np.column_stack((ra[:, :k], tails[0][0])).astype(np.float32)
    right = np.column_stack((rb[:, :k], tails[0][1])).astype(np.float32).T.copy()
    count_a, count_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    shift = 0 if same else len(a)
    parent = np.arange(len(a) if same else len(a) + len(b))
    for start in range(0, len(a), 512):
        can = left[start : start + 512] @ right >= slack
        if same:
            can &= np.arange(len(b))[None, :] > (start + np.arange(len(can)))[:, None]
        i, j = np.nonzero(can)
        if len(i) > can.size // 50:  # many survive: one product of the whole vectors
            i, j = np.nonzero(can & (a[start : start + 512] @ b.T >= threshold - 1e-9))
        i += start
        for n, k2 in enumerate(steps[1:], 1):
            if not len(i):
                break
            keep = [np.einsum("ij,ij->i", ra[i[s : s + 65536], :k2], rb[j[s : s + 65536], :k2]) + tails[n][0][i[s : s + 65536]] * tails[n][1][j[s : s + 65536]] >= slack for s in range(0, len(i), 65536)]
            keep = np.concatenate(keep)
            i, j = i[keep], j[keep]
        if len(i):
            keep = np.concatenate([np.einsum("ij,ij->i", a[i[s : s + 16384]], b[j[s : s + 16384]]) >= threshold for s in range(0, len(i), 16384)])
            i, j = i[keep], j[keep]
        if len(i):
            count_a += np.bincount(i, size_b[j], len(a)).astype(np.int64)
            if same:
                count_a += np.bincount(j, size_a[i], len(a)).astype(np.int64)
            else:
                count_b += np.bincount(j, size_a[i], len(b)).astype(np.int64)
            _join(parent, i, j + shift)
    return count_a, count_b, _roots(parent)


def can_link(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a and of b (leading axes, then the norm of the rest) have a partner that may reach the threshold;
    equal arrays if it is the same tile."""
    slack = np.float32(threshold - 1e-4)
    some_a, some_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    across = b.T.copy()
    for start in range(0, len(a), 512):
        can = a[start : start + 512] @ across >= slack
        if same:
            can &= np.arange(len(b))[None, :] > (start + np.arange(len(can)))[:, None]
        some_a[start : start + len(can)] = can.any(axis=1)
        some_b |= can.any(axis=0)
    if same:
        some_a |= some_b
    return some_a, some_a if same else some_b


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent[:] = up


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the trees of linked rows, larger roots under smaller ones."""
    while True:
        _roots(parent)
        x, y = parent[i], parent[j]
        apart = x != y
        if not apart.any():
            return
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def _dim_links(reps: DataFrame, dim: int, threshold: float, tile: int, pca_rows: int, scratch: Scratch) -> DataFrame:
    """node, links and parent: link counts and forest edges among the classes of one vector length."""
    spark = reps.sparkSession
    n = reps.count()
    part = F.pmod(F.xxhash64("rep", F.lit("pca")), F.lit(1 << 20)) < int(min(1.0, pca_rows / max(1, n)) * (1 << 20)) + 1
    sample = reps.where(part).select("vector").limit(2 * pca_rows).toArrow().column("vector").to_pylist()
    basis = np.eye(dim)
    if sample:
        u = _unit(np.frombuffer(b"".join(sample), np.float64).reshape(-1, dim))
        values, vectors = np.linalg.eigh(u.T @ u)
        basis = np.ascontiguousarray(vectors[:, np.argsort(values)[::-1]])
    steps = tuple(sorted({max(1, min(dim, k)) for k in (dim // 4, dim // 2)}))

    tile = max(1, min(tile, (16 << 20) // (8 * dim)))

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                turned = _unit(np.frombuffer(b"".join(b.column(2).to_pylist()), np.float64).reshape(-1, dim)) @ basis
                tail = np.sqrt((turned[:, steps[0] :] ** 2).sum(axis=1))
                leads = np.column_stack((turned[:, : steps[0]], tail)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(turned[:, 0].copy()), pa.array([r.tobytes() for r in leads], pa.binary())], names=["rep", "size", "vector", "at", "lead"])

    placed = scratch.save(reps.select("rep", "size", "vector").mapInArrow(along, "rep long, size long, vector binary, at double, lead binary"), "placed")
    tiles = max(1, -(-n // tile))
    cuts = np.array(sorted(set(placed.approxQuantile("at", [k / tiles for k in range(1, tiles)], 0.2 / tiles)))) if tiles > 1 else np.zeros(0)
    shared_cuts = spark.sparkContext.broadcast(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = np.searchsorted(shared_cuts.value, b.column(1).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(where)], names=["rep", "at", "lead", "band"])

    dealt = placed.select("rep", "at", "lead").mapInArrow(deal, "rep long, at double, lead binary, band long")
    halves = dealt.groupBy("band").agg(F.ceil(F.count("*") / tile).cast("int").alias("split"))
    dealt = dealt.join(halves, "band").withColumn("tile", F.col("band") * (1 << 24) + F.pmod(F.xxhash64("rep", F.lit("tile")), F.col("split")))

    def pack(t: pa.Table) -> pa.Table:
        at = t.column("at").to_numpy()
        row = [t.column("tile")[0].as_py(), at.min(), at.max(), t.column("rep").to_numpy().astype(np.int64).tobytes(), b"".join(t.column("lead").to_pylist())]
        return pa.table({"tile": pa.array([row[0]], pa.int64()), "lo": pa.array([row[1]], pa.float64()), "hi": pa.array([row[2]], pa.float64()), "ids": pa.array([row[3]], pa.binary()), "leads": pa.array([row[4]], pa.binary())})

    packed = scratch.save(dealt.select("tile", "rep", "at", "lead").groupBy("tile").applyInArrow(pack, _TILE), "tiles")
    meta = packed.select("tile", "lo", "hi").toArrow()  # a row per tile
    order = np.argsort(meta.column("lo").to_numpy(), kind="stable")
    lo, hi, number = (meta.column(c).to_numpy()[order] for c in ("lo", "hi", "tile"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    last = np.searchsorted(lo, hi + reach, side="right") - 1
    ranks = spark.createDataFrame([(int(t), k, int(z)) for k, (t, z) in enumerate(zip(number, last, strict=True))], "tile long, rank int, last int")
    ranked = packed.join(ranks, "tile")
    left = ranked.select(F.col("rank").alias("i"), F.explode(F.sequence("rank", "last")).alias("j"), F.col("ids").alias("ids_a"), F.col("leads").alias("leads_a"))
    right = ranked.select(F.col("rank").alias("j"), F.col("ids").alias("ids_b"), F.col("leads").alias("leads_b"))

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = {c: b.column(m)[k].as_py() for m, c in enumerate(b.schema.names)}
                ids_a, ids_b = (np.frombuffer(r[c], np.int64) for c in ("ids_a", "ids_b"))
                la, lb = (np.frombuffer(r[c], np.float32).reshape(-1, steps[0] + 1) for c in ("leads_a", "leads_b"))
                same = r["i"] == r["j"]
                some_a, some_b = can_link(la, lb, same, threshold)
                for side, ids in enumerate((ids_a[some_a],) if same else (ids_a[some_a], ids_b[some_b])):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), v, np.int32)) for v in (r["i"], r["j"], side)] + [pa.array(ids)], names=["i", "j", "side", "rep"])

    def run(t: pa.Table) -> pa.Table:
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        side = t.column("side").to_numpy()
        ids, sizes = t.column("rep").to_numpy(), t.column("size").to_numpy()
        vectors = np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(-1, dim)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        ca, cb, parent = compare(vectors[a], vectors[b], same, sizes[a], sizes[b], basis, threshold, steps)
        ids, links = (ids[a], ca) if same else (np.concatenate((ids[a], ids[b])), np.concatenate((ca, cb)))
        some = np.flatnonzero(links)
        return pa.table({"node": pa.array(ids[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "parent": pa.array(ids[parent[some]], pa.int64())})

    pairs = left.join(right, "j").select("i", "j", "ids_a", "ids_b", "leads_a", "leads_b")
    left_over = scratch.save(pairs.mapInArrow(survivors, "i int, j int, side int, rep long"), "survivors")
    whole = left_over.join(placed.select("rep", "size", "vector"), "rep")
    return scratch.save(whole.groupBy("i", "j").applyInArrow(run, "node long, links long, parent long"), "links")


def near_duplicate_vectors(df: DataFrame, threshold: float = 0.95, tile: int = 8192, pca_rows: int = 4096, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per input row."""
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "embed")
    rows = df.select(df[vec_id].cast("long").alias("vec_id"), df[vector].alias("vector"))
    rows = scratch.save(rows.mapInArrow(_prepare, "vec_id long, dim int, vector binary, digest binary"), "vectors")
    classes = scratch.save(rows.where("digest is not null").groupBy("digest").agg(F.coalesce(F.min("vec_id"), F.lit(MADE) - 1 - F.xxhash64("digest").bitwiseAND(F.lit((1 << 61) - 1))).alias("rep"), F.count("*").alias("size"), F.first("dim").alias("dim")), "classes")
    reps = rows.select("digest", "vec_id", "vector").join(classes, "digest").where((F.col("vec_id") == F.col("rep")) | (F.col("rep") <= MADE)).groupBy("digest").agg(F.first("rep").alias("rep"), F.first("size").alias("size"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    reps = scratch.save(reps.drop("digest"), "reps")
    found = None
    for r in reps.select("dim").distinct().orderBy("dim").toLocalIterator():
        got = _dim_links(reps.where(F.col("dim") == r["dim"]), r["dim"], threshold, tile, pca_rows, scratch)
        found = got if found is None else found.unionByName(got)
    own = F.when(F.col("size").isNull(), 0).otherwise(F.col("size") - 1)
    out = rows.select("vec_id", "digest").join(classes.drop("dim"), "digest", "left").withColumn("rep", F.coalesce("rep", "vec_id"))
    if found is None:
        out = out.withColumn("links", F.lit(0)).withColumn("component", F.col("rep"))
    else:
        counts = found.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
        component = named(connected_components(found.select(F.col("node").alias("a"), F.col("parent").alias("b")), scratch)).withColumnRenamed("node", "rep")
        out = out.join(counts, "rep", "left").join(component, "rep", "left")
    out = out.select("vec_id", (own + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
