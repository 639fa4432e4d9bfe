"""Personal information inside free text: a linear-chain CRF over word-shape features.

Tokens are runs of word characters joined by single connectors, so that an address of mail or
a number is one token with a telling shape. A token's score for a label is the sum of weights of
its own features, those of its two neighbours on either side, and those of its rough kind together with
theirs; labels follow each other in a chain (begin/inside of five kinds, and outside). Words are known
by themselves only if a public tokenizer's vocabulary has them in small letters; names and places are
known by form alone. The weights are fitted once a process from the labelled table in pii_table, which
is general knowledge; texts are tagged by Viterbi in numpy batches of similar length.

Every neighbourhood score is computed once per distinct token and batch, and a text is decoded only
if some token's best score could lift a label over "outside" (a bound on the path score, so the
result is the one full decoding gives).

Defined results: null and blank texts have no findings and stay as they are; soft hyphens, zero
width spaces and byte order marks inside texts are dropped before tagging; a name needs a
given name or initial with a family name, an address a number, an address of mail an at sign or a
disguised one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engramlake.llm import pii_table
from engramlake.llm.pii_table import DOCUMENTS, GERMAN, GIVEN, KINDS, ROMANCE, STREETS
from engramlake.llm.vocabulary import WORD_LISTS, word_classes

TOKEN = re.compile(r"\w+(?:[.@+\-/:'’‑]\w+)*|[^\w\s]")
INVISIBLE = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
LABELS = ["O", *(f"{b}-{k}" for k in KINDS for b in "BI")]
N = len(LABELS)
OFFSETS = (-2, -1, 0, 1, 2)
WIDTH = 12
#: Features in fewer rows of the table are left out.
LEAST = 4
_RUNS = re.compile(r"([Aa])\1+")
_GIVEN = frozenset(n.lower() for n in GIVEN)
_ROAD = frozenset(s.split()[0].strip(".").lower() for s in (*STREETS, *ROMANCE, *GERMAN))
_ROAD_ENDS = tuple(s.strip(".") for s in GERMAN if len(s) > 3) + ("str",)
_PAPER = frozenset(w.strip(".:").lower() for d in DOCUMENTS for w in d.split() if len(w) > 3)
#: What a finding is given over "outside" in the end, as a missed finding costs more than a masked word; names, least sure, least.
LEAN = {"email": 0.7, "phone": 0.7, "id_number": 0.7, "address": 0.7, "name": 0.35}


def role(low: str) -> str:
    """road: a word for a street, or one that ends in it; paper: a word of identity papers."""
    return "road" if low in _ROAD or (len(low) > 6 and low.endswith(_ROAD_ENDS)) else "paper" if low in _PAPER else ""


def features(token: str, classes: dict[str, str], given: frozenset[str] = _GIVEN) -> list[str]:
    """What is seen of one token. Words are known by themselves only if a dictionary has them; names and places by their form."""
    low = token.lower()
    if token.isalpha():
        if token == low:
            shape = "a"
        elif token.isupper():
            shape = "A"
        else:
            shape = "Aa" if token[1:] == low[1:] else "AaA"
        known = classes.get(low, "0")
        out = [f"s={shape}", f"x={known}", f"s={shape},x={known}", f"l={min(len(token), 12)}"]
        if low in given:
            out.append("given")
        elif what := role(low):
            out.append(what)
        if known[0] != "0":
            out.append("w=" + low)
        elif len(low) > 2:
            out += ["e2=" + low[-2:], "e3=" + low[-3:], "e4=" + low[-4:], "e5=" + low[-5:], "p3=" + low[:3]]
        return out[:WIDTH]
    shape = re.sub(r"[A-ZÀ-Þ]", "A", re.sub(r"\d", "0", token))
    shape = re.sub(r"[^\W\dA_]", "a", shape)
    short = _RUNS.sub(r"\1", shape)
    digits = shape.count("0")
    out = ["s=" + (shape if digits else short)[:16], "c=" + short[:10], f"d={min(digits, 12)}", f"l={min(len(token), 12)}"]
    if "@" in token:
        out.append("at")
    elif digits or len(token) == 1:
        out.append("w=" + re.sub(r"\d", "0", low)[:16])
    elif len(low) > 2:
        first, last = low.split("-", 1)[0], low.rsplit("-", 1)[-1]
        out += ["e3=" + low[-3:], "e4=" + low[-4:], f"h={classes.get(first, '0')}", f"t={classes.get(last, '0')}"]
        if first in given:
            out.append("given")
    if "." in token:
        out.append("dot")
    return out[:WIDTH]


_SHAPES, _STANDS, _SIGNS = ("a", "A", "Aa", "AaA"), ("0", "0c", "1", "2", "3", "given", "road", "paper"), ".,:;()-/&'\"@#"
EDGE = 63


def signature(token: str, classes: dict[str, str], given: frozenset[str]) -> int:
    """A token's rough kind, below EDGE: shape and standing of a word, which sign, or what a number or mixture looks like."""
    low = token.lower()
    if token.isalpha():
        shape = 0 if token == low else 1 if token.isupper() else 2 if token[1:] == low[1:] else 3
        known = classes.get(low, "0")
        stand = _STANDS.index("given" if low in given else role(low) or ("0c" if known == "0c" else known[0]))
        return shape * len(_STANDS) + stand
    base = len(_SHAPES) * len(_STANDS)
    if len(token) == 1 and not token.isalnum():
        return base + (_SIGNS.index(token) if token in _SIGNS else len(_SIGNS))
    base += len(_SIGNS) + 1
    if token.isdigit():
        return base + min(len(token), 6) - 1
    if "@" in token:
        return base + 6
    digits = any(c.isdigit() for c in token)
    return base + 7 + 4 * digits + 2 * token[:1].isupper() + ("." in token)


def patterns(sig: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each token the codes of (before, itself), (itself, after) and all three kinds."""
    before, after = np.full(len(sig), EDGE), np.full(len(sig), EDGE)
    same = doc[1:] == doc[:-1]
    before[1:][same] = sig[:-1][same]
    after[:-1][same] = sig[1:][same]
    return np.stack([before * 64 + sig, (64 + sig) * 64 + after, ((2 + before) * 64 + sig) * 64 + after], 1)


class Tagger:
    """Weights, and the decoding that uses them. Feature 0 is 'unknown' and weighs nothing."""

    given = _GIVEN

    def __init__(self, index: dict[str, int], weights: np.ndarray, step: np.ndarray, start: np.ndarray, classes: dict[str, str], codes: np.ndarray, joint: np.ndarray) -> None:
        self.index, self.weights, self.step, self.start, self.classes, self.codes, self.joint = index, weights, step, start, classes, codes, joint
        self._rows: dict[str, list[int]] = {}

    def rows(self, vocab: list[str]) -> np.ndarray:
        out = np.zeros((len(vocab), WIDTH), np.int32)
        kept = self._rows
        if len(kept) > 200_000:
            kept.clear()
        for k, w in enumerate(vocab):
            r = kept.get(w)
            if r is None:
                r = kept[w] = [i for f in features(w, self.classes, self.given) if (i := self.index.get(f))]
            out[k, : len(r)] = r
        return out

    def places(self, ids: np.ndarray, doc: np.ndarray, vocab: list[str]) -> np.ndarray:
        """Rows of joint for each token's patterns; row 0 is 'unknown'."""
        sig = np.fromiter((signature(w, self.classes, self.given) for w in vocab), np.int64, len(vocab))[ids]
        want = patterns(sig, doc)
        at = np.minimum(np.searchsorted(self.codes, want), len(self.codes) - 1)
        return np.where(self.codes[at] == want, at + 1, 0)

    def emissions(self, ids: np.ndarray, doc: np.ndarray, rows: np.ndarray, places: np.ndarray, seen: dict[int, np.ndarray] | None = None) -> np.ndarray:
        """Scores (token, label); ids index rows (the features of the distinct tokens), doc says where texts begin and end, seen which offsets count."""
        n = len(ids)
        out = self.joint[places].sum(1)
        for k, o in enumerate(OFFSETS):
            part = self.weights[k][rows].sum(1)
            if o == 0:
                out += part[ids]
            elif o > 0 and n > o:
                same = doc[o:] == doc[:-o] if seen is None else (doc[o:] == doc[:-o]) & seen[o][:-o]
                out[:-o] += part[ids[o:]] * same[:, None]
            elif o < 0 and n > -o:
                same = doc[-o:] == doc[:o] if seen is None else (doc[-o:] == doc[:o]) & seen[o][-o:]
                out[-o:] += part[ids[:o]] * same[:, None]
        return out

    def decode(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int]], np.ndarray]]:
        """(text number, token spans, labels) of the texts that may hold something."""
        pieces = [TOKEN.findall(t) for t in texts]
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if not lens.sum():
            return []
        coded = pa.array(list(chain.from_iterable(pieces)), pa.string()).dictionary_encode()
        doc = np.repeat(np.arange(len(texts)), lens)
        vocab, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        e = self.emissions(ids, doc, self.rows(vocab), self.places(ids, doc, vocab))
        calm = self.step[0, 0]
        gain = (e[:, 1:].max(1) - e[:, 0]) + max(float((self.step[:, 1:] - calm).max()), float((self.start[1:] - self.start[0]).max())) + max(0.0, float((self.step[1:, 0] - calm).max()))
        may = np.unique(doc[gain > 0])
        first = np.concatenate([[0], np.cumsum(lens)])
        out = []
        may = may[np.argsort(lens[may], kind="stable")]
        for at in range(0, len(may), 256):
            group = may[at : at + 256]
            size = lens[group]
            m = int(size[-1])
            padded = np.zeros((m, len(group), N), np.float32)
            for k, g in enumerate(group):
                padded[: size[k], k] = e[first[g] : first[g + 1]]
            back = np.zeros((m, len(group), N), np.int8)
            score = padded[0] + self.start
            ends = np.zeros((len(group), N), np.float32)
            ends[size == 1] = score[size == 1]
            for t in range(1, m):
                move = score[:, :, None] + self.step
                back[t] = best = move.argmax(1)
                score = np.take_along_axis(move, best[:, None, :], 1)[:, 0] + padded[t]
                if (done := size == t + 1).any():
                    ends[done] = score[done]
            path = np.zeros((m, len(group)), np.int8)
            now = ends.argmax(1)
            every = np.arange(len(group))
            for t in range(m - 1, -1, -1):
                inside = t < size
                path[t, inside] = now[inside]
                follow = inside & (t > 0)
                now[follow] = back[t, every[follow], now[follow]]
            out += [(int(g), [m.span() for m in TOKEN.finditer(texts[g])], path[: size[k], k]) for k, g in enumerate(group) if path[: size[k], k].any()]
        return out

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Per text the (start, end, kind) of each finding, in order."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for g, spans, path in self.decode(texts):
            text, t = texts[g], 0
            while t < len(path):
                if (label := int(path[t])) == 0:
                    t += 1
                    continue
                kind, z = (label - 1) // 2, t + 1
                while z < len(path) and path[z] == 2 * kind + 2:
                    z += 1
                a, b = spans[t][0], spans[z - 1][1]
                if sound(KINDS[kind], text[a:b]):
                    out[g].append((a, b, KINDS[kind]))
                t = z
        return out


_LETTERS = re.compile(r"[^\W\d_]+")


def sound(kind: str, piece: str) -> bool:
    """An exact check of what the chain found."""
    digits = sum(c.isdigit() for c in piece)
    if kind == "name":
        return len(found := _LETTERS.findall(piece)) >= 2 and max(map(len, found)) > 1
    if kind == "email":
        return "@" in piece.strip("@") or bool(re.search(r"\bat\b", piece, re.I))
    if kind == "phone":
        return digits >= 7
    if kind == "id_number":
        return digits >= 6
    return digits >= 1 and any(len(w) > 2 for w in _LETTERS.findall(piece))


def _table(classes: dict[str, str]) -> tuple[list[list[str]], list[list[int]]]:
    tokens, labels = [], []
    for row in pii_table.labelled_rows(*lexicon(classes)):
        text, marks, at = "".join(p for p, _ in row), [], 0
        for piece, kind in row:
            if kind:
                marks.append((at, at + len(piece), kind))
            at += len(piece)
        t, y, before = [], [], None
        for m in TOKEN.finditer(text):
            mark = next((x for x in marks if x[0] < m.end() and m.start() < x[1]), None)
            t.append(m.group())
            y.append(0 if mark is None else 1 + 2 * KINDS.index(mark[2]) + (mark == before))
            before = mark
        if t:
            tokens.append(t), labels.append(y)
    return tokens, labels


def lexicon(classes: dict[str, str]) -> tuple[list[str], list[str]]:
    """Dictionary words of four letters or more, for the labelled table: in small letters, and only with a capital."""
    return [w for w, c in classes.items() if c[0] != "0" and len(w) > 3], [w for w, c in classes.items() if c[0] == "0" and len(w) > 3]


@lru_cache(maxsize=2)
def trained(vocabulary: tuple[str, ...] = WORD_LISTS, steps: int = 60, rate: float = 0.07, decay: float = 2e-4, keep: float = 0.8) -> Tagger:
    """Fits the chain by gradient steps on the conditional likelihood (once a process, on the driver; the README has the time).

    In each step every neighbour of a text's tokens is seen only with chance keep, so that what a token
    itself shows is learnt too where its surroundings would have told the label.
    """
    classes = word_classes(vocabulary)
    chance = np.random.default_rng(1)
    tokens, labels = _table(classes)
    vocab = sorted({w for t in tokens for w in t})
    number = {w: k for k, w in enumerate(vocab)}
    index: dict[str, int] = {}
    often: dict[str, int] = {}
    for t in tokens:
        for w in set(t):
            for f in features(w, classes):
                often[f] = often.get(f, 0) + 1
    for f in sorted(f for f, n in often.items() if n >= LEAST):
        index[f] = len(index) + 1
    listed = frozenset(n.lower() for k, n in enumerate(GIVEN) if k % 3)  # a third is learnt as names no list has
    tagger = Tagger(index, np.zeros((len(OFFSETS), len(index) + 1, N), np.float32), np.zeros((N, N), np.float32), np.zeros(N, np.float32), classes, np.zeros(1, np.int64), np.zeros((1, N), np.float32))
    tagger.given = listed
    rows = tagger.rows(vocab)
    words_of, at = np.nonzero(rows)
    cells = rows[words_of, at]
    order = sorted(range(len(tokens)), key=lambda k: -len(tokens[k]))
    lens = np.array([len(tokens[k]) for k in order])
    ids = np.concatenate([[number[w] for w in tokens[k]] for k in order]).astype(np.int64)
    gold = np.concatenate([labels[k] for k in order])
    doc = np.repeat(np.arange(len(order)), lens)
    sig = np.fromiter((signature(w, classes, listed) for w in vocab), np.int64, len(vocab))[ids]
    code, often_code = np.unique(patterns(sig, doc), return_counts=True)
    tagger.codes = code[often_code >= LEAST]
    tagger.joint = np.zeros((len(tagger.codes) + 1, N), np.float32)
    places = tagger.places(ids, doc, vocab)
    first, m, d = np.concatenate([[0], np.cumsum(lens)[:-1]]), int(lens[0]), len(order)
    alive = [int((lens > t).sum()) for t in range(m)]  # texts are sorted, longest first
    pair_gold = np.zeros((N, N), np.float32)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    np.add.at(pair_gold, (gold[inner], gold[inner + 1]), 1)
    start_gold = np.bincount(gold[first], minlength=N)
    params = [tagger.weights, tagger.step, tagger.start, tagger.joint]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for it in range(1, steps + 1):
        seen = {o: (chance.random(d) < keep if o else np.ones(d, bool))[doc] for o in OFFSETS}
        e = tagger.emissions(ids, doc, rows, places, seen)
        top = e.max(1, keepdims=True)
        x = np.exp(e - top)
        move = np.exp(tagger.step)
        a = np.zeros((m, d, N), np.float32)
        b = np.zeros((m, d, N), np.float32)
        a[0] = x[first] * np.exp(tagger.start)
        a[0] /= a[0].sum(1, keepdims=True)
        for t in range(1, m):
            k = alive[t]
            v = (a[t - 1, :k] @ move) * x[first[:k] + t]
            a[t, :k] = v / v.sum(1, keepdims=True)
        pair = np.zeros((N, N), np.float32)
        for t in range(m - 1, -1, -1):
            k, nxt = alive[t], alive[t + 1] if t + 1 < m else 0
            b[t, :k] = 1
            if nxt:
                y = x[first[:nxt] + t + 1] * b[t + 1, :nxt]
                v = y @ move.T
                b[t, :nxt] = v / v.sum(1, keepdims=True)
                whole = a[t, :nxt] @ move
                pair += move * ((a[t, :nxt] / (whole * y).sum(1, keepdims=True)).T @ y)
        p = (a * b)[np.arange(len(ids)) - first[doc], doc]
        p /= p.sum(1, keepdims=True)
        start_p = p[first].sum(0)
        p[np.arange(len(ids)), gold] -= 1
        grad_w = np.zeros_like(tagger.weights)
        for k, o in enumerate(OFFSETS):
            here = ids[o:] if o > 0 else ids[: len(ids) + o]
            of = p[: len(ids) - o] if o > 0 else p[-o:]
            same = doc[o:] == doc[: len(doc) - o] if o > 0 else doc[-o:] == doc[: len(doc) + o]
            same = same & (seen[o][: len(ids) - o] if o > 0 else seen[o][-o:])
            for c in range(N):
                by_word = np.bincount(here, of[:, c] * same, len(vocab))
                grad_w[k, :, c] = np.bincount(cells, by_word[words_of], len(index) + 1)
        grad_j = np.zeros_like(tagger.joint)
        for c in range(N):
            grad_j[:, c] = np.bincount(places.ravel(), np.repeat(p[:, c], 3), len(grad_j))
        grads = [grad_w / d, (pair - pair_gold) / d, (start_p - start_gold).astype(np.float32) / d, grad_j / d]
        for q, g, (m1, m2) in zip(params, grads, moment):
            g = g + decay * q
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            q -= rate * (m1 / (1 - 0.9**it)) / (np.sqrt(m2 / (1 - 0.99**it)) + 1e-6)
        tagger.weights[:, 0] = tagger.joint[0] = 0
    for k, o in enumerate(OFFSETS):
        if o:
            tagger.weights[k] *= keep
    tagger.given = _GIVEN
    tagger.joint[:, 1:] += np.repeat([LEAN[k] for k in KINDS], 2).astype(np.float32) / 3  # each token has three patterns
    tagger._rows.clear()
    return tagger


def clean(text: str | None) -> str:
    return INVISIBLE.sub("", text) if isinstance(text, str) else ""


def found(texts: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    """key columns, kind, nth: one row for each finding, numbered per text and kind."""
    tagger = trained()
    keys = ", ".join(f"{n} {t}" for n, t in texts.select(*key_cols).dtypes)
    shared = texts.sparkSession.sparkContext.broadcast((tagger.index, tagger.weights, tagger.step, tagger.start, tagger.classes, tagger.codes, tagger.joint))

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Tagger(*shared.value)
        for b in batches:
            for at in range(0, len(b), 4000):
                part = b.iloc[at : at + 4000]
                hit, kinds, nths = [], [], []
                for k, spans in enumerate(own.find([clean(t) for t in part[text_col]])):
                    seen: dict[str, int] = {}
                    for _, _, kind in spans:
                        seen[kind] = seen.get(kind, 0) + 1
                        hit.append(k), kinds.append(kind), nths.append(seen[kind])
                if hit:
                    yield pd.DataFrame({c: part[c].to_numpy(dtype=object)[hit] for c in key_cols} | {"kind": kinds, "nth": nths})

    return texts.select(*key_cols, text_col).where(F.col(text_col).isNotNull()).mapInPandas(tag, f"{keys}, kind string, nth bigint")


def redacted(texts: DataFrame, text_col: str, out_col: str = "redacted") -> DataFrame:
    """All rows and columns, with each finding in text_col replaced by [KIND] in out_col."""
    tagger = trained()
    shared = texts.sparkSession.sparkContext.broadcast((tagger.index, tagger.weights, tagger.step, tagger.start, tagger.classes, tagger.codes, tagger.joint))
    cache: list[Tagger] = []

    @F.pandas_udf("string")
    def mask(column: pd.Series) -> pd.Series:
        if not cache:
            cache.append(Tagger(*shared.value))
        plain = [clean(t) for t in column]
        out = []
        for raw, text, spans in zip(column, plain, cache[0].find(plain)):
            for a, b, kind in reversed(spans):
                text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
            out.append(text if spans else raw)
        return pd.Series(out, dtype=object)

    return texts.withColumn(out_col, mask(F.col(text_col)))
