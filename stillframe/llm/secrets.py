"""Operator 8: secret scans by a linear-chain conditional random field.

Texts are cut at ASCII white space into tokens; a CRF tags each as secret begin, inside or outside from its shape, its
neighbours' shapes and, where they are among `CUES`, words, and features of the whole text, and Viterbi finds the best tags. Three base patterns always hold
(assignments, access keys, hex runs); the CRF adds spans of kind `crf` where it finds more, and never takes one away.

The CRF is trained here, at first use in a process, on lines made by a seeded generator (`training_lines`): no corpus
row is read for it, so it is the same on every table. Features depend on a token alone, so emissions are found once per
distinct token; where outside beats the other tags by more than all transitions could return, the tag is outside for
certain, and Viterbi runs on the runs between such tokens, with the result of a run over the whole text.

Defined results: null text is empty and has no spans; spans are in code points, end exclusive, ordered by start, then
kind as in KINDS; spans of one pattern never overlap; of a CRF span that touches base spans its parts outside them
stay, but for what precedes an assignment in its own token (that is part of its name); invalid UTF-8 counts as U+FFFD;
repeated rows get the same spans; very long texts are scanned whole, in a batch of their own; an empty table gives no rows; a kept column named like an output gets `_in` appended to its name
(redaction returns every column under its own name).
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import claim, kept, kept_names, ship, slices, texts

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
_HEX = re.compile(r"[0-9a-f]+", re.ASCII)
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: Tokens that can hold part of a base match; neither keywords, access keys nor hex runs span white space.
_MAYBE = re.compile(rb"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{14}|[0-9a-f]{16}")
_PLAIN = re.compile(rb"[\"'(]?[A-Za-z\x80-\xff]{1,20}[.,;:!?)\"']{0,2}")
_KEYWORD = re.compile(rb"(?i)pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private[_-]?key|signature")
_STRIP = "\"'`,;()[]{}<>#*|"
TAGS = ("O", "B", "I")
#: Words whose identity is a feature, of a token and its neighbours: what names secrets, and what names harmless codes.
CUES = frozenset(
    b"password passwd passphrase pwd secret token key keys bearer basic authorization auth login credential credentials private signing webhook backup recovery license pin code otp "
    b"commit revision sha md5 checksum digest hash uuid guid id order invoice tracking serial isbn doi build version release session model part number ref sku case batch article user file path url email phone".split()
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches that pass their length rules."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out)


def _bucket(x: float, edges: tuple) -> int:
    return sum(x >= e for e in edges)


def shape(token: bytes) -> tuple[str, ...]:
    """The token's features."""
    word = token.strip(b"\"'`,;()[]{}<>#*|.!?:=").lower()
    cue = (f"w={word.decode()}",) if word in CUES else ()
    if _PLAIN.fullmatch(token) and not _KEYWORD.search(token):
        return ("plain", f"plainlen{_bucket(len(token), (4, 10, 16))}", *(("colon",) if token.endswith(b":") else ()), *cue)
    core = token.strip(b"\"'`,;()[]{}<>#*|.!?")
    name, sep, value = (core.partition(b"=") if b"=" in core[:-1] else core.partition(b":")) if re.match(rb"[A-Za-z_][A-Za-z0-9_.-]{1,30}[=:][^/=]", core) else (b"", b"", core)
    value = value.strip(b"\"'") or core
    n = max(1, len(value))
    digits = sum(48 <= c <= 57 for c in value)
    upper, lower = sum(65 <= c <= 90 for c in value), sum(97 <= c <= 122 for c in value)
    other = n - digits - upper - lower
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if value else 0.0
    turns = sum((48 <= a <= 57) != (48 <= b <= 57) for a, b in zip(value, value[1:], strict=False)) / n
    vowels = sum(c in b"aeiouAEIOU" for c in value) / max(1, upper + lower)
    out = [f"len{_bucket(n, (4, 8, 12, 16, 20, 28, 40, 80))}", f"entropy{_bucket(entropy, (2, 2.6, 3.1, 3.5, 3.9, 4.3))}", f"digits{_bucket(digits / n, (0.01, 0.1, 0.25, 0.5, 0.99))}", f"turns{_bucket(turns, (0.01, 0.1, 0.25))}", f"vowels{_bucket(vowels, (0.1, 0.22, 0.35))}"]
    if upper and lower and re.search(rb"[a-z][A-Z]", value):
        out.append("mixedcase")
    if digits and upper + lower and n >= 12:
        out.append("alnum_long")
    if other / n > 0.3:
        out.append("signs")
    if re.fullmatch(rb"[0-9 .:/-]+", value):
        out.append("numeric")
    if re.fullmatch(rb"[0-9a-fA-F]{8,}", value) and digits:
        out.append("hex")
    if re.fullmatch(rb"[A-Za-z0-9_]{2,8}[_-][A-Za-z0-9_-]{16,}", value) and digits:
        out.append("prefixed")
    if re.fullmatch(rb"[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}", value):
        out.append("three_parts")
    if b"@" in core or b"://" in core or core.startswith((b"www.", b"/")):
        out.append("address")
    if value.isalpha():
        out.append("letters")
    if any(c >= 128 for c in value):
        out.append("wide")
    if sep:
        out.append("named")
        if _KEYWORD.search(name):
            out.append("keynamed")
    elif _KEYWORD.search(core):
        out.append("keyword")
    if core in (b"", b"=", b":", b":=", b"is"):
        out.append("joint")
    if token.endswith((b":", b"=")):
        out.append("opens")
    return (*out, *cue)


def _syllables(r: random.Random, pool: list[str]) -> str:
    return "".join(r.choice(pool) for _ in range(r.randint(1, 4)))


def training_lines(n: int = 1200, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Lines of tokens with tags: prose, numbers, addresses and code without secrets, and secrets in many settings."""
    r = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pools = [[a + b for a in "bcdfglmnprstv" for b in ("a", "e", "i", "o", "u")], ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ti", "hi", "st", "ing"], ["sch", "ein", "ung", "ver", "ge", "ß", "ä", "ö", "ich", "keit"], ["é", "eau", "tion", "ou", "è", "ç", "ment", "ai"]]
    rand = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))

    def prose(k: int) -> list[str]:
        pool = r.choice(pools)
        words = [_syllables(r, pool) for _ in range(k)]
        return [w.capitalize() if r.random() < 0.1 else w + r.choice(["", "", "", ",", ".", ":", "!", "..."]) for w in words]

    def secret() -> str:
        return r.choice([
            lambda: rand(low + up + dig, 16, 44), lambda: rand(low + up + dig + "+/", 24, 60) + r.choice(["", "=", "=="]), lambda: rand("0123456789abcdef", 32, 64),
            lambda: r.choice(["ghp", "sk_live", "xoxb", "glpat", "pat", "key"]) + r.choice(["_", "-"]) + rand(low + up + dig, 20, 40), lambda: "AKIA" + rand(up + dig, 16, 16),
            lambda: ".".join(rand(low + up + dig + "-_", 16, 40) for _ in range(3)), lambda: rand(low + up + dig + "!@#$%^&*", 12, 24),
        ])()

    def groups() -> list[str]:
        chars, k = r.choice([up + dig, low + dig, "0123456789abcdef"]), r.choice([4, 5, 6, 8])
        return [r.choice(dig) + rand(chars, k - 2, k - 2) + r.choice(chars[:6]) for _ in range(r.randint(3, 6))]

    def harmless() -> list[str]:
        return r.choice([
            lambda: [rand(dig, 1, 16)], lambda: [".".join(str(r.randint(0, 255)) for _ in range(4))], lambda: [f"{rand(low, 3, 10)}{r.choice(['.', '_', ''])}{r.choice([str(r.randint(1, 99)), _syllables(r, pools[1])])}@{_syllables(r, pools[0])}{r.choice(['', str(r.randint(0, 9))])}{r.choice(['', '.example'])}.com{r.choice(['', ',', '.', '###', '&&&'])}"],
            lambda: [f"https://www.{_syllables(r, pools[0])}.org/{_syllables(r, pools[1])}/{r.randint(1, 9999)}?id={r.randint(1, 99999)}"], lambda: [f"+{r.randint(1, 99)}", f"{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}"],
            lambda: [f"20{r.randint(10, 30)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:00Z"], lambda: [f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}"], lambda: ["|", _syllables(r, pools[1]), "|"],
            lambda: [r.choice("#$%&*=-") * r.randint(2, 12)], lambda: ["<div", f'class="{_syllables(r, pools[0])}-{r.randint(1, 9)}">'], lambda: ["the", r.choice(["token", "secret", "password", "key"]), "of", *prose(2)],
            lambda: [_syllables(r, pools[1]) + r.choice(["###", "$$$", "&&&", "%%%"])], lambda: [f"{_syllables(r, pools[0])}_{_syllables(r, pools[1])}({_syllables(r, pools[1])})"], lambda: [" ".join("4" + rand(dig, 15, 15) for _ in range(1))],
            lambda: ["".join(_syllables(r, pools[1]) for _ in range(r.randint(4, 9)))], lambda: ["Copyright", "(c)", str(r.randint(1990, 2030)), *prose(2)], lambda: [f"{rand(low, 4, 9)}={rand(low, 3, 10)};"], lambda: [f"password:", r.choice(["none", "required", "unchanged"])],
            lambda: [r.choice(["C:\\", "/", "src='/", "~/"]) + r.choice(["\\", "/", "/"]).join(_syllables(r, pools[1]) + r.choice(["", "", f"_v{r.randint(1, 9)}"]) for _ in range(r.randint(2, 5))) + r.choice([".txt", ".png'", ".docx", ""])],
            lambda: ["-".join([_syllables(r, pools[1]) + r.choice(["", rand(dig, 1, 2), "_64"]) for _ in range(r.randint(2, 4))])],
            lambda: [f"#{rand('0123456789abcdef', 6, 6)}"], lambda: [f"{rand(up, 2, 4)}-{rand(dig, 3, 6)}"],
            named, named, named, named,
            lambda: [f"{rand(low, 2, 4)}.{rand(dig, 1, 3)}@{_syllables(r, pools[0])}{rand(dig, 0, 2)}.{r.choice(['example', 'test'])}.{r.choice(['com', 'org'])}{r.choice(['', '&&&', '###', '$$$', '%%%'])}"],
        ])()

    def named() -> list[str]:
        """A code that its word says is none of the secret ones."""
        code = r.choice([
            lambda: rand("0123456789abcdef", 7, 15), lambda: "-".join(rand("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)), lambda: rand(up + dig, 8, 18), lambda: f"{rand(up, 2, 3)}{rand(dig, 6, 14)}",
            lambda: f"{rand(up, 1, 3)}-{rand(dig, 2, 6)}-{rand(up + dig, 2, 8)}", lambda: f"10.{rand(dig, 4, 4)}/{rand(low + dig, 5, 14)}", lambda: rand(low + dig, 6, 12),
        ])()
        cue = r.choice(["commit", "revision", "sha", "md5", "checksum", "digest", "hash", "uuid", "guid", "id", "order", "invoice", "tracking", "serial", "isbn", "doi", "build", "version", "release", "model", "part", "ref", "sku", "case", "batch", "article"])
        return [*prose(r.randint(0, 2)), r.choice([cue, cue.capitalize()]) + r.choice(["", ":", "", "="]), *([r.choice(["number", "no.", "is"])] if r.random() < 0.2 else []), code + r.choice(["", "", ".", ","])]

    def planted() -> tuple[list[str], list[int]]:
        q, s = r.choice(["", '"', "'"]), secret()
        name = r.choice(["password", "passwd", "pwd", "secret", "client_secret", "token", "access_token", "api_key", "apikey", "API-KEY", "auth", "private_key", "aws_secret_access_key", "DB_PASSWORD"])
        return r.choice([
            lambda: ([name, r.choice(["=", ":", ":=", "is"]), f"{q}{s}{q}"], [0, 0, 1]), lambda: ([f"{name}:", f"{q}{s}{q}"], [0, 1]), lambda: ([f"{name}={q}{s}{q}"], [1]), lambda: (["Authorization:", "Bearer", s], [0, 0, 1]),
            lambda: ([f"{q}{s}{q}"], [1]), lambda: ([r.choice(["login", "credentials:", "pin", "otp", "signing", "webhook"]), *([r.choice(["key", "code", "secret", "is"])] if r.random() < 0.5 else []), f"{q}{s}{q}"], None), lambda: ([r.choice(["backup", "recovery", "app"]), f"{name}:", *(g := groups())], [0, 0, 1] + [2] * (len(g) - 1)),
        ])()

    out = []
    for _ in range(n):
        tokens, tags = [], []
        for _ in range(r.randint(1, 3)):
            tokens += (p := prose(r.choice([0, 1, 2, 5, 8, 16])))
            tags += [0] * len(p)
            if r.random() < 0.45:
                a, b = planted()
                b = b or [0] * (len(a) - 1) + [1]
            else:
                a = harmless()
                b = [0] * len(a)
            tokens += a
            tags += b
        tokens += (p := prose(r.randint(0, 3)))
        out.append((tokens, tags + [0] * len(p)))
    return [x for x in out if x[0]]


class Crf:
    """Weights of a linear-chain CRF over O, B, I with transitions, and the decoder."""

    def __init__(self, names: dict[str, int], w: np.ndarray, trans: np.ndarray):
        self.names, self.w, self.trans = names, w, trans  # w: (own, previous, next, file) x features x tags
        self.margin = 2 * float(trans.max() - trans.min())

    def parts(self, token: bytes) -> np.ndarray:
        """What the token adds to its own, its successor's and its predecessor's emissions: 3 x 3."""
        idx = [self.names[f] for f in shape(token) if f in self.names]
        return self.w[:3, idx].sum(axis=1)

    def viterbi(self, e: np.ndarray) -> list[int]:
        """Best tags of one run whose neighbours are O (or the text's ends)."""
        score, back = e[0] + self.trans[0], []
        for row in e[1:]:
            via = score[:, None] + self.trans
            back.append(via.argmax(axis=0))
            score = via.max(axis=0) + row
        best = int((score + self.trans[:, 0]).argmax())
        out = [best]
        for b in reversed(back):
            out.append(best := int(b[best]))
        return out[::-1]


def file_features(keywords: int, odd: int, n: int) -> list[str]:
    """Features of a whole text: whether it names secrets, and its share of tokens that are no plain words."""
    return [f"file_key{min(keywords, 2)}", f"file_odd{_bucket(odd / max(1, n), (0.05, 0.2, 0.5))}"]


@lru_cache(maxsize=2)
def trained(n: int = 1200, seed: int = 7, rounds: int = 120) -> Crf:
    """The CRF of the generated lines: full-batch Adam on the penalised likelihood by forward-backward."""
    lines = training_lines(n, seed)
    names: dict[str, int] = {}
    for tokens, _ in lines:
        for t in tokens:
            for f in shape(t.encode()):
                names.setdefault(f, len(names))
    for k in range(3):
        names.setdefault(f"file_key{k}", len(names))
    for k in range(4):
        names.setdefault(f"file_odd{k}", len(names))
    f, m, length = len(names), len(lines), max(len(t) for t, _ in lines)
    kinds: dict[tuple, int] = {}  # distinct shapes
    sid, y = np.zeros((m, length), np.int64), np.zeros((m, length), np.int64)
    mask, file = np.zeros((m, length), bool), np.zeros((m, f))
    for i, (tokens, tags) in enumerate(lines):
        shapes = [shape(t.encode()) for t in tokens]
        sid[i, : len(tags)] = [kinds.setdefault(s, len(kinds)) for s in shapes]
        y[i, : len(tags)], mask[i, : len(tags)] = tags, True
        file[i, [names[k] for k in file_features(sum("keyword" in s or "keynamed" in s for s in shapes), sum("plain" not in s for s in shapes), len(tokens))]] = 1
    has = np.zeros((len(kinds), f))
    for s, k in kinds.items():
        has[k, [names[x] for x in s]] = 1
    ends = mask.sum(axis=1) - 1
    at, after, before = mask, mask[:, 1:], mask[:, 1:]  # a token, one with a predecessor, one with a successor
    sources = ((at, sid[at]), (after, sid[:, :-1][after]), (before, sid[:, 1:][before]))
    gold_t = np.zeros((3, 3))
    for _, tags in lines:
        for a, b in zip([0, *tags], [*tags, 0], strict=True):
            gold_t[a, b] += 1
    gold = np.eye(3)[y] * mask[:, :, None]
    per_kind = lambda ids, v: np.stack([np.bincount(ids, v[:, t], len(kinds)) for t in range(3)], axis=1)
    w, trans = np.zeros((4 * f, 3)), np.zeros((3, 3))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    rows = np.arange(m)
    for step in range(1, rounds + 1):
        parts = [has @ v for v in w.reshape(4, f, 3)[:3]]
        e = np.repeat((file @ w.reshape(4, f, 3)[3])[:, None, :], length, axis=1)
        for target, (here, ids), part in zip((e, e[:, 1:], e[:, :-1]), sources, parts, strict=True):
            target[here] += part[ids]
        # forward and backward on probabilities, rescaled at each step; posteriors are rescaled to 1 in the end
        step_to, here = np.exp(trans), np.exp(e - e.max(axis=2, keepdims=True))
        alpha, beta = np.empty((m, length, 3)), np.ones((m, length, 3))
        alpha[:, 0] = here[:, 0] * step_to[0]
        for t in range(1, length):
            alpha[:, t] = (alpha[:, t - 1] / alpha[:, t - 1].sum(axis=1, keepdims=True)) @ step_to * here[:, t]
        for t in range(length - 1, -1, -1):
            if t + 1 < length:
                beta[:, t] = (here[:, t + 1] * beta[:, t + 1]) @ step_to.T
                beta[:, t] /= beta[:, t].sum(axis=1, keepdims=True)
            beta[ends == t, t] = step_to[:, 0]
        p = alpha * beta
        p *= mask[:, :, None] / p.sum(axis=2, keepdims=True)
        pair = alpha[:, :-1, :, None] * step_to * (here[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair *= mask[:, 1:, None, None] / pair.sum(axis=(2, 3), keepdims=True)
        gt = pair.sum(axis=(0, 1)) - gold_t
        gt[0] += p[:, 0].sum(axis=0)
        gt[:, 0] += p[rows, ends].sum(axis=0)
        off = p - gold
        gw = np.concatenate([has.T @ per_kind(ids, v[here]) for (here, ids), v in zip(sources, (off, off[:, 1:], off[:, :-1]), strict=True)] + [file.T @ off.sum(axis=1)])
        for k, (v, g) in enumerate(((w, gw + 0.3 * w), (trans, gt + 3.0 * trans))):
            a, b = state[2 * k], state[2 * k + 1]
            a[...] = 0.9 * a + 0.1 * g
            b[...] = 0.99 * b + 0.01 * g * g
            v -= 0.12 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Crf(names, w.reshape(4, f, 3), trans)


class Scanner:
    """The CRF with a bounded cache of distinct tokens' emissions."""

    def __init__(self, crf: Crf, max_tokens: int = 200_000, max_bytes: int = 64 << 20):
        self.crf, self.max_tokens, self.max_bytes = crf, max_tokens, max_bytes
        self.clear()

    def clear(self) -> None:
        self.codes: dict = _Numbered()
        self.rows = np.zeros((1 << 12, 9))
        self.flags = np.zeros(1 << 12, np.uint8)  # 1: may hold a base match, 2: names a secret, 4: no plain word
        self.like: dict[tuple, int] = {}
        self.kind = np.zeros(1 << 12, np.int32)
        self.kinds = self.held = 0

    def _learn(self, new: list[bytes], first: int) -> None:
        while first + len(new) > len(self.kind):
            self.kind, self.flags = (np.concatenate((x, np.zeros_like(x))) for x in (self.kind, self.flags))
        self.held += sum(map(len, new))
        for k, token in enumerate(new, first):
            s = shape(token)
            if s not in self.like:
                self.like[s] = self.kinds
                if self.kinds == len(self.rows):
                    self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
                self.rows[self.kinds] = self.crf.parts(token).ravel()
                self.kinds += 1
            self.kind[k] = self.like[s]
            self.flags[k] = bool(_MAYBE.search(token)) | 2 * ("keyword" in s or "keynamed" in s) | 4 * (s[0] != "plain")

    def scan(self, batch: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Each text's spans: (start, kind number, end), ordered."""
        if len(self.codes) > self.max_tokens or self.held > self.max_bytes:
            self.clear()
        split = [x.split() for x in batch]
        known = len(self.codes)
        n = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        if len(self.codes) > known:
            self._learn([*self.codes][known:] if not known else _last(self.codes, len(self.codes) - known), known)
        out: list[list[tuple[int, int, int]]] = [[] for _ in batch]
        if not len(codes):
            return out
        owner = np.repeat(np.arange(len(batch)), n)
        flags, rows = self.flags[codes], self.rows[self.kind[codes]].reshape(-1, 3, 3)
        c = self.crf
        emit = rows[:, 0].copy()
        same = owner[1:] == owner[:-1]
        emit[1:] += rows[:-1, 1] * same[:, None]
        emit[:-1] += rows[1:, 2] * same[:, None]
        keys = np.bincount(owner, (flags & 2) > 0, len(batch))
        odd = np.bincount(owner, (flags & 4) > 0, len(batch))
        of_file = np.array([c.w[3, [c.names[f] for f in file_features(int(a), int(b), int(k))]].sum(axis=0) for a, b, k in zip(keys, odd, n, strict=True)])
        emit += of_file[owner]
        open_ = np.flatnonzero(emit[:, 0] - emit[:, 1:].max(axis=1) <= c.margin)
        base = np.bincount(owner, flags & 1, len(batch)) > 0
        first = np.cumsum(n) - n
        tagged: dict[int, list[tuple[int, int]]] = {}
        if len(open_):
            breaks = np.flatnonzero((np.diff(open_) > 1) | (np.diff(owner[open_]) > 0)) + 1
            for run in np.split(open_, breaks):
                a, own = int(run[0]), int(owner[run[0]])
                begin = None
                for k, tag in enumerate([*c.viterbi(emit[run]), 0]):
                    if tag != 2 and begin is not None:
                        tagged.setdefault(own, []).append((begin - int(first[own]), a + k - int(first[own])))
                        begin = None
                    if tag == 1 or tag == 2 and begin is None:
                        begin = a + k
        for k in sorted({*np.flatnonzero(base).tolist(), *tagged}):
            text = batch[k].decode("utf-8", "replace")
            spans = base_spans(text) if base[k] else []
            if k in tagged:
                at = [m.span() for m in _TOKEN.finditer(text)]
                base_here = spans[:]
                for a, b in tagged[k]:
                    spans += [(lo, 3, hi) for lo, hi in _outside(text, at[a][0], at[b - 1][1], base_here)]
            out[k] = sorted(spans)
        return out


def _outside(text: str, lo: int, hi: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of text[lo:hi] that no base span covers, without the signs around them."""
    out, at = [], lo
    for x, kind, y in [*((x, k, y) for x, k, y in base if x < hi and lo < y), (hi, -1, hi)]:
        a, z = at, min(x, hi)
        if kind == 0:  # what comes before an assignment in the same token belongs to its name
            while a < z and not text[z - 1].isspace():
                z -= 1
        while a < z and (text[a] in _STRIP or text[a].isspace()):
            a += 1
        while z > a and (text[z - 1] in _STRIP or text[z - 1].isspace()):
            z -= 1
        if a < z:
            out.append((a, z))
        at = max(at, y)
    return out


class _Numbered(dict):
    def __missing__(self, key):
        v = self[key] = len(self)
        return v


def _last(d: dict, n: int) -> list:
    from itertools import islice

    return [*islice(reversed(d), n)][::-1]


_SCANNERS: dict[tuple, Scanner] = {}


def _scanner(key: tuple, crf: Crf) -> Scanner:
    """One per worker process; the key names the training, so that the cache fits the weights."""
    claim("secrets", _SCANNERS.clear)
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(crf)
    return _SCANNERS[key]


def _map(df: DataFrame, text: str, keep: tuple[str, ...], redact: str | None) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    key = (1200, 7, 120)
    crf = trained(*key)
    weights = (crf.names, crf.w, crf.trans)  # a few kB
    cols_in, kept_as, ddl = kept(df, keep, ("spans", "__clean"))
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _scanner(key, Crf(*weights))
        for b in slices(batches, "__text", 1 << 20):
            col = b.column(b.schema.get_field_index("__text"))
            raw = texts(b, "__text")
            found = s.scan(raw)
            cols = [b.column(b.schema.get_field_index(k)) for k in kept_as]
            names = list(kept_as)
            if redact is None:
                cols.append(pa.array([[{"kind": KINDS[k], "start": a, "end": z} for a, k, z in x] for x in found], span_type))
                names.append("spans")
            else:
                clean = [(_redacted(t.decode("utf-8", "replace"), x, redact) if x else t.decode("utf-8", "replace")) if v else None for t, x, v in zip(raw, found, col.is_valid().to_pylist(), strict=True)]
                cols.append(pa.array(clean, pa.string()))
                names.append("__clean")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    more = "spans array<struct<kind:string,start:int,end:int>>" if redact is None else "__clean string"
    return df.select(*cols_in, F.col(f"`{text}`").alias("__text")).mapInArrow(run, f"{ddl}{more}")


def _redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for a, _, z in spans:
        if a >= at:
            out += [text[at:a], mark]
            at = z
        else:
            at = max(at, z)
    return "".join([*out, text[at:]])


def find_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep and spans, an array of (kind, start, end); one row per input row; map-only."""
    return _map(df, text, keep, None)


def redact_secrets(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The table with every span of its texts replaced by mark; n_chars follows where there is one."""
    keep = tuple(c for c in df.columns if c != text)
    out = _map(df, text, keep, mark)
    back = dict(zip(keep, kept_names(keep, ("spans", "__clean")), strict=True)) | {text: "__clean"}
    out = out.select(*[F.col(f"`{back[c]}`").alias(c) for c in df.columns])
    if "n_chars" in keep:
        out = out.withColumn("n_chars", F.length(F.col(f"`{text}`")).cast(df.schema["n_chars"].dataType))
    return out
