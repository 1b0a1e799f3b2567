"""Near-duplicates, decontamination, embeddings, language model and the pipeline against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stillframe.llm import ctw, decontam, embed, neardup
from stillframe.llm import queries as q
from stillframe.llm._util import Scratch
from stillframe.llm.components import connected_components

SMALL = "/root/testdata/sf0.001"


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2300)] + [(5, 5), (-7, 3)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame([*edges, (None, 4)], "a long, b long"), Scratch(spark, "t")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def copies(seed=5):
    """A hot group of exact copies, groups of near copies around the threshold, shared passages, odd rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    rows, n = [], 0
    for size in (3, 30, 60):
        base = [word() for _ in range(120)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
                w[r.randrange(len(w))] = word()
            rows.append((n := n + 1, " ".join(w)))
    rows += [(n := n + 1, passage + " " + " ".join(word() for _ in range(20))) for _ in range(40)]
    rows += [(n := n + 1, "Exactly   THE same\ttext here now") for _ in range(50)] + [(n := n + 1, "exactly the same text here now")]
    rows += [(n := n + 1, t) for t in ("a b", "A  b", "b a", "", None, " \n", "x", "é É", "long " * 30_000)]
    return [*rows, rows[0], rows[0]]


@pytest.mark.parametrize("words, block, hot", [(4, 512, 2000), (5, 4, 5)])
def test_near_duplicates(spark, words, block, hot, monkeypatch):
    monkeypatch.setattr(neardup, "_HOT", hot)  # buckets of more members are dealt over several tasks
    rows = copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).repartition(3)
    sets = {d: shingles(t, words) for d, t in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(ids, links)
    got = neardup.near_duplicates(df, words=words, block=block).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {d: (len(sets[d]), want[d], want[d] == d) for d in ids}
    if block == 4:  # blocks by bytes rather than rows
        same = neardup.near_duplicates(df, words=words, block_bytes=3000).collect()
        assert sorted(map(str, same)) == sorted(map(str, got))
    left = neardup.drop_near_duplicates(df, words=words, block=block)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(set(want.values()))


def test_near_duplicates_of_nothing_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(none).count() == 0 and neardup.drop_near_duplicates(none).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (9, "a b c d e f"), (None, "only here"), (3, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()}
    assert got == {(None, 2): (9, False), (9, 2): (9, True), (None, 1): (None, True), (3, 0): (3, True)}


def test_near_duplicates_without_ids(spark):
    """Null-id rows are linked by their text; one row of each component stays, the one with an id where there is one."""
    r = random.Random(11)
    base = [["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(100)] for _ in range(2)]
    near = lambda k, at: " ".join([*base[k][:at], "changed", *base[k][at + 1 :]])
    rows = [(None, near(0, 9)), (5, near(0, 50)), (None, near(0, 90)), (None, near(1, 9)), (None, near(1, 80)), (None, near(1, 80)), (None, "  "), (None, ""), (None, None), (None, None), (8, "x y"), (8, "x y"), (8, "z z z z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("__doc", F.lit(1)).repartition(4)
    got = sorted(str((x["doc_id"], x["component_id"], x["kept"])) for x in neardup.near_duplicates(df).collect())
    assert got == sorted(["(None, 5, False)"] * 2 + ["(5, 5, True)"] + ["(None, None, True)"] * 7 + ["(8, 8, True)"] * 3)
    left = neardup.drop_near_duplicates(df)
    assert left.columns == df.columns
    left = [(x["doc_id"], x["text"]) for x in left.collect()]
    assert len(left) == 1 + 1 + 4 + 1 and (5, near(0, 50)) in left and sum(t in (near(1, 9), near(1, 80)) for _, t in left) == 1 and sum(d == 8 for d, _ in left) == 1
    again = neardup.drop_near_duplicates(df.repartition(2)).collect()  # the same row of a repeated doc_id, however it is dealt
    assert {x["text"] for x in again if x["doc_id"] == 8} == {t for d, t in left if d == 8}


def test_bitmap_follows_the_number_of_ids(spark):
    few = neardup.Bitmap(spark.range(100), "id")
    more = neardup.Bitmap(spark.range(0, 1_000_000, 2), "id")
    assert few.size == neardup._LEAST_BITS and 4_000_000 <= more.size <= 8 << 20
    at = np.array([x[0] for x in spark.range(200_000).select(more.at(F.col("id"))).collect()])
    held = more.holds(more.bits, at)
    assert held[::2].all() and held[1::2].mean() < 0.2

def brute_hits(text, items, window=10):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        size = min(window, len(iw))
        for k in range(len(iw) - size + 1 if iw else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == iw[k : k + size]:
                    hit |= set(range(i, i + size))
                    found |= {str(item)} - {"None"}
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_decontamination(spark, block_bytes):
    r = random.Random(6)
    vocab = ["the", "of", "a", "é1", "zeta", "omega9", "x", "rare"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, say(r.choice([1, 2, 3, 4, 9, 10, 11, 25]))) for k in range(12)] + [(5, "Dup, item one two three four five six"), (5, "Dup, item one two three four five six"), (7, None), (8, "..."), (None, "null id words here")]
    docs = [(k, say(r.randint(0, 60)) + r.choice(["", "; ", "\n"]) + r.choice([t or "" for _, t in items]).upper()) for k in range(60)] + [(90, None), (91, ""), (92, "the"), (None, "null ID, words here!"), (93, "the same"), (93, "the same")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_contamination(df, bench, block_bytes=block_bytes, keep=("doc_id", "hits")).collect()
    view = sorted((str(x["doc_id"]), x["n_words"], sum(h["end"] - h["start"] for h in x["hits"]), list(x["items"])) for x in got)
    assert view == sorted((str(d), *brute_hits(t, items)) for d, t in docs)
    assert all(a["end"] < b["start"] for x in got for a, b in zip(x["hits"], x["hits"][1:], strict=False)) and got[0]["hits_in"] == 0


def test_decontamination_of_nothing(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontam.find_contamination(docs, none).collect()] == [(1, 2, [], [])]
    assert decontam.find_contamination(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(8)
    dim = 12
    hot, base = r.normal(size=dim), r.normal(size=(150, dim))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(1000 + k, (hot + r.normal(scale=0.12, size=dim)).tolist()) for k in range(120)] + [(2000 + k, hot.tolist()) for k in range(40)] + [(3000 + k, (hot * (k + 1) * 3).tolist()) for k in range(3)]
    rows += [(4000 + k, (base[k] + r.normal(scale=0.3, size=dim)).tolist()) for k in range(60)]
    bad = [(5000, None), (5001, [0.0] * dim), (5002, [1.0, None] + [0.0] * (dim - 2)), (5003, [float("nan")] * dim), (5004, [float("inf")] + [1.0] * (dim - 1)), (5005, []), (5006, hot.tolist()[:5]), (5007, [1e200] * dim), (5008, [1e-200] * dim)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("x"))
    good = {i: np.array(v) for i, v in rows} | {5007: np.ones(dim), 5008: np.ones(dim)}
    ids = sorted(good)
    x = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)), strict=True)]
    count = Counter(k for e in links for k in e)
    want = components([i for i, _ in rows + bad], links)
    for tile in (2048, 16):
        got = {q["vec_id"]: (q["n_links"], q["component_id"], q["kept"]) for q in embed.near_duplicate_vectors(df, 0.95, tile=tile).collect()}
        assert got == {i: (count.get(i, 0), want[i], want[i] == i) for i, _ in rows + bad}
    assert embed.near_duplicate_vectors(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<float>")
    assert sorted(map(str, embed.near_duplicate_vectors(twice).collect())) == sorted(["Row(vec_id=1, n_links=2, component_id=1, kept=True)"] * 2 + ["Row(vec_id=None, n_links=2, component_id=None, kept=False)", "Row(vec_id=2, n_links=0, component_id=2, kept=True)"])


def brute_ctw(train, texts, depth):
    """The same model by dictionaries: counts, log P_w top down, mixing along the path."""
    count = Counter()
    for t in train:
        b = b"\0" * depth + t.lower() + b"\0"
        for i in range(depth, len(b)):
            for j in range(8):
                node, bit = (1 << j) | (b[i] >> (8 - j)), (b[i] >> (7 - j)) & 1
                for d in range(depth + 1):
                    count[b[i - d : i], node, bit] += 1
    nodes = {(c, n) for c, n, _ in count}
    kt = lambda c, n: math.lgamma(count[c, n, 0] + 0.5) + math.lgamma(count[c, n, 1] + 0.5) - math.lgamma(count[c, n, 0] + count[c, n, 1] + 1) - math.log(math.pi)
    children, pw = {}, {}
    for c, n in nodes:
        if c:
            children.setdefault((c[1:], n), []).append((c, n))
    for c, n in sorted(nodes, key=lambda x: -len(x[0])):
        pe = kt(c, n)
        pw[c, n] = pe if len(c) == depth else np.logaddexp(pe, sum(pw[x] for x in children[c, n])) - math.log(2)
    out = []
    for t in texts:
        b, total = b"\0" * depth + t.lower() + b"\0", 0.0
        for i in range(depth, len(b)):
            for j in range(8):
                node, bit = (1 << j) | (b[i] >> (8 - j)), (b[i] >> (7 - j)) & 1
                p = None
                for d in range(depth, -1, -1):
                    c = b[i - d : i]
                    if (c, node) in nodes:
                        own = (count[c, node, 1] + 0.5) / (count[c, node, 0] + count[c, node, 1] + 1)
                        w = 1.0 if d == depth else math.exp(kt(c, node) - math.log(2) - pw[c, node])
                        p = own if p is None else w * own + (1 - w) * p
                p = 0.5 if p is None else p
                total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_language_model(spark):
    r = random.Random(9)
    say = lambda n: " ".join(r.choice(["The", "cat", "sat", "on", "ünd", "mat", "xyzzy%d" % r.randint(0, 30)]) for _ in range(n))
    rows = [(k, say(r.randint(0, 12))) for k in range(40)] + [(50, None), (51, ""), (52, "never seen words"), (3, "the cat"), (3, "the cat"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(3)
    is_train = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 != 2
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]
    c = Counter(w for d, t in rows if is_train(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    model = brute_ctw([(t or "").encode() for d, t in rows if is_train(d)], [(t or "").encode() for _, t in rows], 2)
    want = sorted((str(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6), round(s, 2)) for (d, t), s in zip(rows, model, strict=True))
    for head in (1 << 18, 3):  # all words broadcast; nearly all joined
        got = ctw.score(df, train, depth=2, most_bits=24, head_words=head)
        assert sorted((str(x["doc_id"]), x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6), round(x["score"], 2)) for x in got.collect()) == want
    assert ctw.score(df.limit(0), train).count() == 0
    none = ctw.score(df.where("doc_id = 51"), F.lit(False)).first()
    assert (none["n_known"], none["train_tokens"], none["base_score"]) == (0, 0, 0.0) and none["score"] < 0


def test_language_model_keeps_every_node(spark, monkeypatch):
    """The registered depth and bits against brute force; few bits make more slices and change no score."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(300)]  # deep nodes decide
    rows = [(k, " ".join(r.choices(words, k=50))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = brute_ctw([t.encode() for d, t in rows if d % 5], [t.encode() for _, t in rows], 5)
    off = {}
    for bits, hot in ((12, 1000), (22, 1000), (22, 1), (22, 10**9)):  # few slices, many; as many hot contexts as there are, none, all
        monkeypatch.setattr(ctw, "_HOT", hot)
        got = {x["doc_id"]: x["score"] for x in ctw.score(df, F.col("doc_id") % 5 != 0, most_bits=bits).collect()}
        off[bits, hot] = max(abs(got[d] - s) for (d, _), s in zip(rows, model, strict=True))
    assert max(off.values()) < 1e-6, off


def test_language_model_reads_long_texts_whole(spark):
    r = random.Random(5)
    long = " ".join(r.choices(["alpha", "beta", "gamma", "Delta"], k=12_000)) + " the very last words"
    rows = [(1, "alpha beta"), (2, long), (3, ""), (4, "the last words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    model = brute_ctw([t.encode() for d, t in rows if d != 4], [t.encode() for _, t in rows], 2)
    got = {x["doc_id"]: x for x in ctw.score(df, F.col("doc_id") != 4, depth=2, most_bits=6).collect()}
    assert all(abs(got[d]["score"] - s) < 1e-6 * max(1, len(t)) for (d, t), s in zip(rows, model, strict=True))
    assert (got[2]["n_tokens"], got[4]["n_known"]) == (12_005, 4)


def test_language_model_probabilities_sum():
    """Over all 256 bytes after a context, seen or not, hot or not."""
    r = np.random.default_rng(2)
    seen = np.unique(r.integers(97, 101, (400, 4)) @ np.array([1 << 24, 1 << 16, 1 << 8, 1]))
    for train in (r.integers(0, 5, len(seen)), np.zeros(len(seen), np.int64)):
        for hot in (np.zeros(0, np.int64), np.array([0x6162, 0x6263])):
            held = lambda key, n: pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])
            rows = [*ctw._to_top(3, hot)(iter([held(seen, train)]))]
            nodes = pa.Table.from_batches(rows) if rows else pa.table({"depth": pa.array([], pa.int32())})
            top = SimpleNamespace(value=ctw._top(nodes, 3))
            for ctx in (0x616162, 0x636263, 0x616364, 0, 0xFFFFFF):
                every = (ctx << 8) + np.arange(256)
                rest = seen[~np.isin(seen, every)]
                n = dict(zip(seen.tolist(), train.tolist(), strict=True))
                key = np.concatenate((every, rest))
                got = pa.Table.from_batches(ctw._code_lengths(3, hot, top)(iter([held(key, np.array([n.get(k, 0) for k in key.tolist()]))])))
                p = dict(zip(got.column("key").to_pylist(), got.column("v").to_pylist(), strict=True))
                assert abs(sum(10 ** p[k] for k in every.tolist()) - 1) < 1e-9


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cur = con.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr(dict(sorted(zip(names, r, strict=True)))) for r in cur.fetchall())
    assert sorted(repr(dict(sorted(r.asDict().items()))) for r in q.QUERIES[name](spark, SMALL).collect()) == want


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, seen = docs, []
    scratch = Scratch(spark, "t")
    for name, stage in p.STAGES:
        clash = kept.withColumn("hits", F.lit(7)).withColumn("lang_pred", F.lit("x")).withColumn("spans", F.lit("y")).withColumn("ids", F.lit("z"))
        out = scratch.save(stage(spark, clash, SMALL), name)
        if name != "encode":
            assert out.columns == clash.columns and out.agg(F.min("hits"), F.max("spans")).first() == (7, "y")
            out = out.select(*docs.columns)
        seen.append(out.count())
        kept = out
    assert seen[0] <= docs.count() and seen == sorted(seen, reverse=True) and seen[2] == seen[3] == seen[4]
    rows = {r["doc_id"]: r for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    letters = {d for d, r in rows.items() if re.search(r"[^\W\d_]", r["text"] or "")}
    sets = {d: shingles(rows[d]["text"], 5) for d in letters}
    ids = sorted(letters)
    comp = components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    want = {d for d in ids if comp[d] == d and not brute_hits(rows[d]["text"], items)[1]}
    got = {r["doc_id"]: r for r in p.run(spark, SMALL).collect()}
    assert set(got) == want
    for d, r in got.items():
        assert r["n_tokens"] == len(r["ids"])
    none = spark.createDataFrame([], docs.schema)
    for _, stage in p.STAGES:
        assert stage(spark, none, SMALL).count() == 0


def test_pipeline_rejects_texts_of_no_learned_language(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    strange = [(10**6 + k, t, None, "x", len(t)) for k, t in enumerate(["Ω≈ç√∫ жшщ ъыэ 漢字 かな " * 9, "漢字仮名交じり文の例です " * 20, "Это совсем другой язык и другие буквы " * 8])]
    more = docs.unionByName(spark.createDataFrame(strange, docs.select("doc_id", "text", "lang", "source", "n_chars").schema).select(*docs.columns))
    left = {r["doc_id"] for r in p.language_id(spark, more, SMALL).select("doc_id").collect()}
    assert not any(d in left for d, *_ in strange)
    assert left == {r["doc_id"] for r in docs.collect() if re.search(r"[^\W\d_]", r["text"] or "")}
    one = docs.withColumn("lang", F.lit("all")).unionByName(more.where("doc_id >= 1000000"))  # so with one language learned
    assert {r["doc_id"] for r in p.language_id(spark, one, SMALL).select("doc_id").collect()} == left


def test_helpers():
    assert xxhash.xxh64_intdigest(b"") and hashlib.sha256(b"").hexdigest()
    x = neardup.coefficients(300)
    assert len(set(x[0].tolist())) == 300 and (x[0] % 2 == 1).all()
    y = np.random.default_rng(1).integers(0, 1 << 62, 4000).astype(np.uint64)
    a, b = neardup.minima(y[:3600], *x), neardup.minima(y[400:], *x)
    assert abs((a == b).mean() - 0.8) < 0.1  # 3,200 of 4,000 in common
