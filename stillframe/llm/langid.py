"""Operator 10: language identification.

Sparse multinomial logistic regression over hashed character 1- to 3-grams (lower case, runs of non-letters as one
boundary class) weighted by TF-IDF, trained with FTRL-proximal under an elastic net, then calibrated by a temperature
on rows that the training did not see. Document frequencies cover every training document. The classifier is fitted on
a bounded sample: about `per_lang` documents of each language, chosen by a hash of their id and text; every language is
learned. The driver holds 1 MB a language while it fits, and 256 kB a language are broadcast. The label, source and id are no input of a prediction.

With fewer than 20 rows to calibrate on, or one language, the temperature is 1 and scores are as learned.

Defined results: null text or text without a letter gives 'und' with score 0; so does every text when no row can be
learned from; equal scores go to the first language by name; rows with null lang are not learned from; a null id counts
as id remainder 0; repeated rows get the same prediction and are learned from once; an empty table gives no rows; very long texts are read whole; a kept column named like an output
gets `_in` appended to its name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import Scratch, claim, kept, ship, slices, texts

BUCKETS = 1 << 16
OUTPUTS = ("lang_pred", "score", "known")
COMMON = 0.01
_SCALE = 100.0  # relative term frequencies are small numbers; one constant brings logits into range


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x languages, idf included
    bias: np.ndarray
    temperature: float
    common: np.ndarray  # the buckets that a share COMMON of the training documents has


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point of the basic plane is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x10000)])


def ngrams(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n of 1, 2, 3: the buckets of all n-grams that hold a letter, and the text of each (ascending)."""
    found = [f" {x.decode('utf-8', 'replace').lower()} " for x in raw]
    points = np.frombuffer("".join(found).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found)))
    is_letter = _letters()[np.minimum(points, 0xFFFF)]
    if len(high := np.flatnonzero(points > 0xFFFF)):
        is_letter = is_letter.copy()
        is_letter[high] = [chr(c).isalpha() for c in points[high].tolist()]
    c = np.where(is_letter, points, 32).astype(np.uint64)
    for n in (1, 2, 3):
        size = max(0, len(c) - n + 1)
        h, some = np.full(size, n, np.uint64), np.zeros(size, bool)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + c[k : k + size] + np.uint64(1)
            some |= is_letter[k : k + size]
        some &= owner[:size] == owner[n - 1 : n - 1 + size]
        h = h[some] * np.uint64(0x9E3779B97F4A7C15)
        yield (h >> np.uint64(48)).astype(np.int64), owner[:size][some]


def scores(m: Model, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits before the temperature, the number of n-grams of each text, and how many of them are common."""
    total = np.zeros((len(raw), len(m.langs)))
    count, known = np.zeros(len(raw), np.int64), np.zeros(len(raw))
    for h, owner in ngrams(raw):
        here, first = np.unique(owner, return_index=True)
        if len(here):
            total[here] += np.add.reduceat(m.weights[h], first, axis=0, dtype=np.float64)
            count += np.bincount(owner, minlength=len(raw))
            known += np.bincount(owner, m.common[h], len(raw))
    return total * (_SCALE / np.maximum(count, 1))[:, None] + m.bias, count, known


def _features(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's buckets and their share of its n-grams."""
    parts = list(ngrams(raw))
    h, owner = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(owner, kind="stable")
    h, edges = h[order], np.searchsorted(owner[order], np.arange(len(raw) + 1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        idx, n = np.unique(h[a:b], return_counts=True)
        yield idx.astype(np.int32), (n / max(1, b - a)).astype(np.float32)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net over (class, buckets, values); returns weights and bias."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for y, idx, x in rows:
            idx, x = np.append(idx, BUCKETS), np.append(x, 1.0)
            zi, ni = z[idx], n[idx]
            w = weights(zi, ni)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            more = ni + g * g
            z[idx] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[idx] = more
    w = weights(z, n)
    return w[:BUCKETS], w[BUCKETS]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least negative log likelihood, by golden section on its logarithm."""

    def loss(t: float) -> float:
        v = logits / np.exp(t)
        v = v - v.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(y)), y]))

    a, b, r = -2.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(df: DataFrame, train: Column, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", per_lang: int = 500) -> Model:
    """Learn from the rows where train holds and lang is not null."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(df[doc_id].alias("doc_id"), df[lang].alias("lang"), df[text].alias("__text"), train.alias("__train")).where("__train and lang is not null")
    n_of = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not n_of:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, np.zeros(BUCKETS, bool))
    share = F.create_map(*[F.lit(x) for k, n in n_of.items() for x in (k, min(1.0, per_lang / n))])
    order = F.xxhash64(F.col("doc_id").cast("string"), "__text", F.lit("langid"))
    unit = (F.pmod(order, F.lit(1 << 30)) / float(1 << 30)).alias("__unit")
    rows = rows.select("lang", "__text", order.alias("__order"), F.coalesce(unit < F.try_element_at(share, F.col("lang")), F.lit(False)).alias("__fit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df_counts, seen = np.zeros(BUCKETS, np.int64), 0
        claim("langid", int)
        schema = pa.schema([("lang", pa.string()), ("order", pa.int64()), ("idx", pa.list_(pa.int32())), ("val", pa.list_(pa.float32()))])
        for b in slices(batches, "__text", 1 << 18):
            raw = texts(b, "__text")
            parts = list(ngrams(raw))
            for h, owner in parts:
                key = np.unique(owner * BUCKETS + h)  # one n-gram length after the other: a bucket of two lengths counts twice
                df_counts += np.bincount(key % BUCKETS, minlength=BUCKETS)
            seen += len(raw)
            fit_, langs, orders = (b.column(b.schema.get_field_index(k)).to_pylist() for k in ("__fit", "lang", "__order"))
            if chosen := [k for k, x in enumerate(fit_) if x]:
                got = list(_features([raw[k] for k in chosen]))
                yield pa.RecordBatch.from_pydict({"lang": [langs[k] for k in chosen], "order": [orders[k] for k in chosen], "idx": [g[0] for g in got], "val": [g[1] for g in got]}, schema=schema)
        where = np.flatnonzero(df_counts)
        if seen:
            yield pa.RecordBatch.from_pydict({"lang": [None], "order": [seen], "idx": [where.astype(np.int32)], "val": [df_counts[where].astype(np.float32)]}, schema=schema)

    scratch = Scratch(spark, "langid")
    got = scratch.save(rows.mapInArrow(run, "lang string, order long, idx array<int>, val array<float>"), "features")
    counts = got.where("lang is null")
    total = counts.agg(F.sum("order")).first()[0] or 0
    df_counts = np.zeros(BUCKETS)
    for r in counts.select(F.explode(F.arrays_zip("idx", "val")).alias("e")).groupBy("e.idx").agg(F.sum("e.val").alias("n")).collect():  # at most BUCKETS rows
        df_counts[r["idx"]] = r["n"]
    idf = np.log((1 + total) / (1 + df_counts).clip(max=1 + total)) + 1
    langs = sorted(n_of)
    sample = got.where("lang is not null").dropDuplicates(["order", "lang"]).toPandas().sort_values(["order", "lang"], kind="stable")
    scratch.clear()
    data = [(langs.index(r.lang), (i := np.asarray(r.idx, np.int64)), np.asarray(r.val, float) * idf[i] * _SCALE) for r in sample.itertuples()]
    held, learn = data[::5], [x for k, x in enumerate(data) if k % 5]
    w, bias = ftrl(learn or data, len(langs))
    logits = np.array([x @ w[i] + bias for _, i, x in held])
    t = temperature(logits, np.array([y for y, _, _ in held])) if len(held) >= 20 and len(langs) > 1 else 1.0
    return Model(langs, (w * idf[:, None]).astype(np.float32), bias, t, df_counts >= max(1, COMMON * total))


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, lang_pred, score (the calibrated probability of the prediction) and known (the share of the text's
    n-grams that are common in training: small for a language that is none of the learned ones); map-only."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS floats a language
    cols_in, names, ddl = kept(df, keep, OUTPUTS)
    own = names[keep.index(text)] if text in keep else "__text"  # a kept text is not sent twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        claim("langid", int)
        for b in slices(batches, own, 1 << 18):
            raw = texts(b, own)
            if m.langs:
                logits, count, known = scores(m, raw)
                v = logits / m.temperature
                v = np.exp(v - v.max(axis=1, keepdims=True))
                best = v.argmax(axis=1)
                p = np.where(count > 0, v.max(axis=1) / v.sum(axis=1), 0.0)
                known = known / np.maximum(count, 1)
                pred = [m.langs[k] if n else "und" for k, n in zip(best, count, strict=True)]
            else:
                p, known, pred = np.zeros(len(raw)), np.zeros(len(raw)), ["und"] * len(raw)
            cols = [b.column(b.schema.get_field_index(k)) for k in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(p, pa.float64()), pa.array(known, pa.float64())], names=[*names, *OUTPUTS])

    return df.select(*cols_in, *[F.col(f"`{text}`").alias("__text")] * (text not in keep)).mapInArrow(run, f"{ddl}lang_pred string, score double, known double")
