"""Operator 7: BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so a cut between its two bytes is
certain. Texts are first cut at white space (which the vocabulary's pre-tokenizer never crosses), then into
pre-tokens, then at every such byte pair; the fragments are encoded independently by the vocabulary's merges, each
distinct fragment once per worker (bounded caches), and the ids are concatenated. The last fragment of a pre-token is
encoded with the end-of-word mark, the others without.

Defined results: null text is empty and has no ids; an empty text decodes to an empty text; bytes that are not UTF-8
count as U+FFFD; repeated rows are encoded each; very long texts are encoded whole, in a batch of their own; an empty
table gives no rows; kept columns pass through untouched, one named like an output with `_in` appended to its name.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import claim, kept, ship, slices, texts

#: The pre-tokenizer pattern for which the fast path holds: white space separates and never joins a pre-token.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_WORDS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\x20\x09-\x0d]+", re.ASCII)
_LATIN_WORDS = regex.compile(r"\n|" + _WORDS)
#: Letters and signs that lower-case one to one everywhere and have no white space among them.
_LATIN = re.compile("[\x21-\x7e¡-¬®-įı-ňŊ-ž]+")


def byte_alphabet() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: itself if printable, else 256 and up."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return [out[b] for b in range(256)]


class _Codes(dict):
    """Numbers keys in order of first sight."""

    def __missing__(self, key):
        v = self[key] = len(self)
        return v


class _Pool:
    """Id lists of codes 0, 1, ... in one growing array."""

    def __init__(self):
        self._n, self._start, self._ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.size = self.used = 0

    @property
    def n(self) -> np.ndarray:
        return self._n[: self.size]

    def add(self, n: np.ndarray, ids: np.ndarray) -> None:
        while self.size + len(n) > len(self._n):
            self._n, self._start = (np.concatenate((x, np.zeros_like(x))) for x in (self._n, self._start))
        while self.used + len(ids) > len(self._ids):
            self._ids = np.concatenate((self._ids, np.zeros_like(self._ids)))
        self._n[self.size : self.size + len(n)] = n
        self._start[self.size : self.size + len(n)] = self.used + np.cumsum(n) - n
        self._ids[self.used : self.used + len(ids)] = ids
        self.size += len(n)
        self.used += len(ids)

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the codes' lists, concatenated, and each list's length."""
        n = self._n[codes]
        ends = np.cumsum(n)
        return self._ids[np.repeat(self._start[codes] - (ends - n), n) + np.arange(int(n.sum()))], n


def _edges(n: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """0 and the running sums of n; given of: those entries of n at 0 and the running sums of of."""
    if of is not None:
        return n[_edges(of)]
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(n, dtype=np.int64)))


def _newest(d: dict, n: int) -> list:
    """The last n keys, in order of insertion."""
    return [*islice(reversed(d), n)][::-1]


def _fast_spec(spec: dict) -> bool:
    """Whether texts of this tokenizer file may be cut at ASCII white space and encoded by fragments."""
    m, n, p = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = [x["type"] for x in n.get("normalizers", [])]
    parts = p.get("pretokenizers", [])
    return (
        m["type"] == "BPE"
        and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and kinds == ["NFC", "Replace", "Lowercase"]
        and n["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        and [x["type"] for x in parts] == ["Split", "ByteLevel"]
        and parts[0] == {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}
        and not parts[1]["add_prefix_space"]
        and not parts[1]["use_regex"]
        and not spec.get("post_processor")
        and all(t["special"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
    )


class _Pieces:
    """A vocabulary whose texts may be cut at white space: chunks, their pre-tokens, and the certain cuts in those."""

    def __init__(self, path: str, max_chunks: int = 600_000, max_bytes: int = 96 << 20):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.path, self.max_chunks, self.max_bytes = path, max_chunks, max_bytes
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not _fast_spec(spec):
            raise ValueError(f"{path}: no forced boundaries at white space; use LibraryCoder")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        m = spec["model"]
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in m["merges"]]
        self.end = m.get("end_of_word_suffix") or ""
        self.inner = Tokenizer(BPE(vocab=m["vocab"], merges=merges))
        self.last = Tokenizer(BPE(vocab=m["vocab"], merges=merges, end_of_word_suffix=self.end)) if self.end else self.inner
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.lead = {t[:2] for t in self.special}
        alphabet = byte_alphabet()
        self.to_char = {b: c for b, c in enumerate(alphabet)}
        self.to_byte = to_byte = {c: b for b, c in enumerate(alphabet)}
        #: joined[0][a, b]: the pair occurs inside a token before its end; joined[1][a, b]: b ends a word there.
        self.joined = np.zeros((2, 256, 256), bool)
        for token in m["vocab"]:
            ends = bool(self.end) and token.endswith(self.end)
            bs = [to_byte[c] for c in (token[: -len(self.end)] if ends else token) if c in to_byte]
            for k in range(len(bs) - 1):
                self.joined[int(ends and k == len(bs) - 2), bs[k], bs[k + 1]] = True
        if not self.end:
            self.joined[1] = self.joined[0]
        self.spec = spec
        self.clear()

    def chunks(self, text: bytes) -> list[bytes]:
        """The text's white-space chunks; lower-cased early where that cannot change a result, for fewer distinct ones."""
        if b"\xcc" not in text and b"\xcd" not in text and not any(x in text for x in self.lead):
            return text.lower().split()
        return text.split()

    def full(self) -> bool:
        """Whether the caches hold as many keys, or as many bytes of keys, as they may."""
        return len(self.words) > self.max_chunks or self.held > self.max_bytes

    def kind_of(self, chunks: list[bytes]) -> tuple[list[int], list[int], list[str], list[int]]:
        """Which chunks are ASCII, which plain Latin (and their texts), which need the library's own steps."""
        plain, latin, latin_text, other = [], [], [], []
        for k, c in enumerate(chunks):
            if any(map(c.__contains__, self.special)):
                other.append(k)
            elif c.isascii():
                plain.append(k)
            else:
                s = c.decode("utf-8", "replace")
                if _LATIN.fullmatch(s) and unicodedata.is_normalized("NFC", s):
                    latin.append(k)
                    latin_text.append(s)
                else:
                    other.append(k)
        return plain, latin, latin_text, other

    def words_of(self, s: str) -> list[str]:
        """A chunk's pre-tokens by the library's normalizer and pre-tokenizer."""
        return [self._text(p) for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(s))]

    def _text(self, piece: str) -> str:
        return bytes(map(self.to_byte.__getitem__, piece)).decode("utf-8", "replace")

    def fragments(self, words: list[str]) -> tuple[dict[tuple[bool, str], int], np.ndarray, np.ndarray]:
        """Cut pre-tokens at pairs that no token holds: the distinct fragments (whether one closes a word, its text),
        all fragments' codes in order, and where each pre-token's fragments end."""
        raw = [w.encode() for w in words]
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        text = joined.decode("latin-1").translate(self.to_char)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        is_end = np.zeros(len(data), np.int8)
        is_end[ends - 1] = 1
        cut = np.ones(len(data), bool)  # cut[i]: a fragment ends after i
        cut[:-1] = ~self.joined[is_end[1:], data[:-1], data[1:]]
        cut[ends - 1] = True
        stop = np.flatnonzero(cut) + 1
        begin = np.concatenate(([0], stop[:-1]))
        closes = is_end[stop - 1].astype(bool)
        seen = _Codes()
        keys = ((z, text[a:b]) for z, a, b in zip(closes.tolist(), begin.tolist(), stop.tolist(), strict=True))
        codes = np.fromiter(map(seen.__getitem__, keys), np.int64, len(stop))
        return seen, codes, np.searchsorted(stop, ends, side="right")

    def each(self, seen: dict[tuple[bool, str], int], of):
        """of(encoding) of every distinct fragment, by its code."""
        out: list = [None] * len(seen)
        for closing, tok in ((True, self.last), (False, self.inner)):
            which = [(i, f) for (z, f), i in seen.items() if z == closing]
            for (i, _), e in zip(which, tok.encode_batch_fast([f for _, f in which], add_special_tokens=False), strict=True):
                out[i] = of(e)
        return out


class PieceCoder(_Pieces):
    """Encodes white-space chunks to ids, each distinct one once while it is in the cache."""

    def __init__(self, path: str, max_chunks: int = 600_000, max_bytes: int = 96 << 20):
        super().__init__(path, max_chunks, max_bytes)
        m, spec = self.spec["model"], self.spec
        size = max(max(m["vocab"].values()), *(t["id"] for t in spec["added_tokens"])) + 1 if spec["added_tokens"] else max(m["vocab"].values()) + 1
        self.token = [""] * size
        for token, i in chain(m["vocab"].items(), ((t["content"], t["id"]) for t in spec["added_tokens"])):
            self.token[i] = token
        self.decoder = spec.get("decoder")
        del self.spec

    def clear(self) -> None:
        """Forget all chunks and pre-tokens; code 0 of the pre-tokens is the line end, which has no ids."""
        self.codes, self.words = _Codes(), _Codes()
        self.chunk_ids, self.word_ids = _Pool(), _Pool()
        self.words["\n"]
        self.word_ids.add(np.zeros(1, np.int64), np.zeros(0, np.uint32))
        self.held = 0

    def full(self) -> bool:
        return len(self.codes) > self.max_chunks or super().full()

    def encode(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch's texts, concatenated, and the offsets of the texts in them."""
        if self.full():
            self.clear()
        split = [self.chunks(x) for x in batch]
        known = len(self.codes)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if len(self.codes) > known:
            self._learn(_newest(self.codes, len(self.codes) - known), known)
        ids, n = self.chunk_ids.take(codes)
        return ids, _edges(_edges(n), counts)

    def _learn(self, chunks: list[bytes], first: int) -> None:
        """Encode chunks not seen before; chunk k gets code first + k."""
        collecting = gc.isenabled()
        gc.disable()  # many small lists and no cycles: collections would cost more than the work
        try:
            self._learn_chunks(chunks, first)
        finally:
            if collecting:
                gc.enable()

    def _learn_chunks(self, chunks: list[bytes], first: int) -> None:
        found: list = []
        self.held += 2 * sum(map(len, chunks))
        plain, latin, latin_text, other = self.kind_of(chunks)
        found += _ASCII_WORDS.findall("".join(f"{chunks[k].decode()}\n" for k in plain).lower())
        found += _LATIN_WORDS.findall("".join(f"{s}\n" for s in latin_text).lower())
        for k in other:  # by the library, its own normalizer and pre-tokenizer
            s = chunks[k].decode("utf-8", "replace")
            if any(map(chunks[k].__contains__, self.special)):
                found += [key := ("whole", s), "\n"]
                if key not in self.words:
                    self._learn_words(_newest(self.words, len(self.words) - len(self.word_ids.n)))
                    ids = np.array(self.tok.encode(s, add_special_tokens=False).ids, np.uint32)
                    self.words[key]
                    self.word_ids.add(np.array([len(ids)]), ids)
            else:
                found += [*self.words_of(s), "\n"]
        codes = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
        if len(self.words) > len(self.word_ids.n):
            self._learn_words(_newest(self.words, len(self.words) - len(self.word_ids.n)))
        ids, n = self.word_ids.take(codes)
        edges = np.concatenate(([0], np.flatnonzero(codes == 0) + 1))
        at = _edges(n)[edges]
        order = np.array(plain + latin + other, np.int64)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        own = _Pool()
        own.add(np.diff(at), ids)
        ids, n = own.take(back)
        self.chunk_ids.add(n, ids)

    def _learn_words(self, words: list[str]) -> None:
        """Encode each distinct fragment of the pre-tokens and concatenate their ids."""
        if not words:
            return
        seen, codes, edge = self.fragments(words)
        ids_of = self.each(seen, lambda e: e.ids)
        pool = _Pool()
        n = np.fromiter(map(len, ids_of), np.int64, len(ids_of))
        pool.add(n, np.fromiter(chain.from_iterable(ids_of), np.uint32, int(n.sum())))
        ids, n = pool.take(codes)
        self.word_ids.add(np.diff(_edges(n)[np.concatenate(([0], edge))]), ids)

    def decode(self, ids: list[int]) -> str:
        """As the library with no decoder: tokens joined by one space; ids without a token are left out."""
        if self.decoder:
            return self.tok.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.token.__getitem__, ids))


class PieceCounter(_Pieces):
    """Counts tokens: the pieces of each distinct pre-token once while it is in the cache, as one number; no ids."""

    def clear(self) -> None:
        self.words, self.pieces, self.held = _Codes(), np.zeros(1024, np.int32), 0

    def count(self, batch: list[bytes]) -> np.ndarray:
        """Tokens of each text: its pre-tokens' frequencies, joined to the pieces of each distinct one, and summed."""
        if self.full():
            self.clear()
        split = [self.chunks(x) for x in batch]
        n = np.fromiter(map(len, split), np.int64, len(split))
        here = _Codes()
        codes = np.fromiter(map(here.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        words, per_chunk = self._words(list(here))
        # the occurrences of each chunk in each text, then of each pre-token
        keys, times = np.unique(np.repeat(np.arange(len(batch)), n) * max(1, len(here)) + codes, return_counts=True)
        text, chunk = np.divmod(keys, max(1, len(here)))
        size = per_chunk[chunk]
        end = np.cumsum(size)
        first = _edges(per_chunk)[chunk]
        word = words[np.repeat(first - (end - size), size) + np.arange(int(size.sum()))]
        return np.bincount(np.repeat(text, size), np.repeat(times, size) * self.pieces[word], len(batch)).astype(np.int64)

    def _words(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all chunks' pre-tokens, concatenated, and each chunk's number of them; new ones are counted."""
        plain, latin, latin_text, other = self.kind_of(chunks)
        collecting = gc.isenabled()
        gc.disable()  # many small strings and no cycles
        try:
            found: list = _ASCII_WORDS.findall("".join(f"{chunks[k].decode()}\n" for k in plain).lower())
            found += _LATIN_WORDS.findall("".join(f"{s}\n" for s in latin_text).lower())
            for k in other:
                s = chunks[k].decode("utf-8", "replace")
                if any(map(chunks[k].__contains__, self.special)):
                    found += [("whole", s), "\n"]  # special strings: the library sees the chunk as it is
                else:
                    found += [*self.words_of(s), "\n"]
            known = len(self.words)
            codes = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
            if len(self.words) > known:
                self._learn(_newest(self.words, len(self.words) - known), known)
        finally:
            if collecting:
                gc.enable()
        ends = np.flatnonzero(codes == self.words["\n"])
        sizes = np.empty(len(chunks), np.int64)
        order = np.array(plain + latin + other, np.int64)
        by_order = np.diff(np.concatenate(([-1], ends))) - 1
        sizes[order] = by_order
        # pre-tokens in the order of the chunks
        codes = np.delete(codes, ends)
        start = np.empty(len(chunks), np.int64)
        start[order] = np.cumsum(by_order) - by_order
        end = np.cumsum(sizes)
        return codes[np.repeat(start - (end - sizes), sizes) + np.arange(len(codes))], sizes

    def _learn(self, new: list, first: int) -> None:
        while first + len(new) > len(self.pieces):
            self.pieces = np.concatenate((self.pieces, np.zeros_like(self.pieces)))
        got = np.zeros(len(new), np.int32)
        for k, w in enumerate(new):
            if isinstance(w, tuple):
                got[k] = len(self.tok.encode(w[1], add_special_tokens=False))
        plain = [k for k, w in enumerate(new) if isinstance(w, str) and w and w != "\n"]
        if plain:
            seen, codes, edge = self.fragments([new[k] for k in plain])
            pieces = np.array(self.each(seen, len), np.int64)[codes]  # the length of an encoding, not its ids
            got[plain] = np.diff(_edges(pieces)[np.concatenate(([0], edge))])
        self.pieces[first : first + len(new)] = got
        self.held += sum(len(w) if isinstance(w, str) else len(w[1]) for w in new)


class LibraryCounter:
    """Counts with any other tokenizer file. A .json file's pre-tokens, whatever they hold, are counted once each while
    cached; texts that hold an added token, and .model files, go through their library whole, and only the length stays."""

    def __init__(self, path: str, max_words: int = 600_000, max_bytes: int = 96 << 20):
        self.max_words, self.max_bytes = max_words, max_bytes
        self.pieces: dict[str, int] = {}
        self.held = 0
        self.model = path.endswith(".model")
        if self.model:
            import sentencepiece

            self.p = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.bare = Tokenizer(self.tok.model)
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]

    def count(self, batch: list[bytes]) -> np.ndarray:
        return np.array([self._one(x.decode("utf-8", "replace")) for x in batch], np.int64)

    def _one(self, text: str) -> int:
        if self.model:
            return len(self.p.encode(text))
        if any(map(text.__contains__, self.added)) or self.tok.pre_tokenizer is None:
            return len(self.tok.encode(text, add_special_tokens=False))
        if len(self.pieces) > self.max_words or self.held > self.max_bytes:
            self.pieces, self.held = {}, 0
        text = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        often = Counter(p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(text))
        for p in often:
            if p not in self.pieces:
                self.pieces[p] = len(self.bare.encode(p, add_special_tokens=False))
                self.held += len(p)
        return sum(n * self.pieces[p] for p, n in often.items())


class LibraryCoder:
    """Any other tokenizer file, whole texts through its own library; the same two calls."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids, self._text = lambda xs: p.encode(xs, num_threads=1), p.decode
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_padding()
            t.no_truncation()
            self._ids = lambda xs: [e.ids for e in t.encode_batch_fast(xs, add_special_tokens=False)]
            self._text = lambda ids: t.decode(ids, skip_special_tokens=False)

    def encode(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self._ids([x.decode("utf-8", "replace") for x in batch])
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), np.concatenate(([0], np.cumsum(n)))

    def decode(self, ids: list[int]) -> str:
        return self._text(ids)


MAX_CHUNKS = 600_000


def coder(path: str, max_chunks: int = MAX_CHUNKS) -> PieceCoder | LibraryCoder:
    """One coder per worker and file; it holds at most about max_chunks distinct chunks."""
    claim("bpe", _load.cache_clear)
    return _load(path, max_chunks)


@lru_cache(maxsize=1)
def _load(path: str, max_chunks: int) -> PieceCoder | LibraryCoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            if _fast_spec(json.load(f)):
                return PieceCoder(path, max_chunks)
    return LibraryCoder(path)


def counter(path: str) -> PieceCounter | LibraryCounter:
    """One counter per worker and file, in the coder's place."""
    claim("counter", _load_counter.cache_clear)
    return _load_counter(path)


@lru_cache(maxsize=1)
def _load_counter(path: str) -> PieceCounter | LibraryCounter:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            if _fast_spec(json.load(f)):
                return PieceCounter(path)
    return LibraryCounter(path)


def encode_decode(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = True, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """Columns keep, then ids array<int>, and decoded string unless turned off. One row per input row; map-only."""
    ship(df.sparkSession)
    cols_in, names, ddl = kept(df, keep, ("ids", "decoded"))
    narrow = df.select(*cols_in, F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer, max_chunks)
        for b in slices(batches, "__text", 1 << 20):
            ids, off = c.encode(texts(b, "__text"))
            cols = [b.column(b.schema.get_field_index(k)) for k in names]
            ids = ids.astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)))
            if decoded:
                flat = ids.tolist()
                cols.append(pa.array([c.decode(flat[a:z]) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "ids", *["decoded"] * decoded])

    return narrow.mapInArrow(run, f"{ddl}ids array<int>{', decoded string' * decoded}")
