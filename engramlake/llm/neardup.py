"""Near-duplicate records with small edits: ProbMinHash, banding, verification.

Each distinct text is a bag of words; a word weighs its count times its length (between 1
and 8, short words less), which keeps apart texts that share only short common words. Every word sends exponential arrivals (a
Poisson process at the rate of its weight) to random registers; a register keeps the word
that arrives first, and a word stops once its next arrival is later than the latest register.
Two texts agree in a register with their probability Jaccard similarity. ``rows`` registers
make a band; texts that agree in a whole band are candidates. A band that many texts share is cut
into blocks of ``HEAVY`` texts, and every two of its blocks meet in a group of their own, so that no task has
to pair up a whole band. A 128-bit word bitmap drops candidates that cannot reach the threshold, and the
rest are verified word by word.

Similarity is common words over all words, repeats counted. Copies are collapsed before
sketching (same letters in the same order and same words; a class is the 128 bits of both hashes) and
expanded only at the end.

Defined results: null texts and texts under ``min_words`` words are in no pair; pairs with the
same letters and digits in the same order are none; rows that repeat an id count once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engramlake.llm.text import words
from engramlake.runtime import cut, tasks_for

MIN_WORDS, THRESHOLD = 15, 0.7
ROWS, BANDS = 6, 32
_BLOCK = 8
#: A word that so many of a batch's texts have, as often as ``_COUNTS`` at most, is worked out for all registers and kept; 2 ** ``_ROW`` are kept at once.
OFTEN, _COUNTS, _ROW = 4, 4, 12
#: Texts of one band that are paired up in one place.
HEAVY = 256
#: A class is two numbers.
CLASS = ("c1", "c2")
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _coded(found: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts given as words: how many words each has, the number of each word in the vocabulary, the vocabulary, its hashes."""
    lens = np.fromiter(map(len, found), np.int64, len(found))
    coded = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
    vocab = coded.dictionary.to_pandas().to_numpy()
    return lens, coded.indices.to_numpy(), vocab, pd.util.hash_array(vocab, categorize=False).astype(np.uint64)


class Arrivals:
    """First arrivals in each register of words that many texts have, by word and count: times as integers (the bits of the
    floats) whose last ``_ROW`` bits are the row, so that the least of a register also tells whose it is."""

    def __init__(self, registers: int):
        self.registers = registers
        self.row: dict[tuple[int, int], int] = {}
        self.first, self.by = np.empty((0, registers), np.int64), np.zeros(0, np.uint64)

    def rows(self, seed: np.ndarray, count: np.ndarray, weight: np.ndarray, often: np.ndarray) -> np.ndarray:
        """The row of each word and count, -1 if it has none; what is met often gets one while there is room."""
        names = list(zip(seed.tolist(), count.tolist()))
        row = np.fromiter((self.row.get(x, -1) for x in names), np.int64, len(names))
        new = np.flatnonzero(often & (row < 0))
        if len(self.row) + len(new) > 1 << _ROW and (row >= 0).sum() < min(often.sum(), 1 << _ROW) // 2:  # other texts than before
            self.__init__(self.registers)
            row[:], new = -1, np.flatnonzero(often)
        new = new[: (1 << _ROW) - len(self.row)]
        if len(new):
            row[new] = len(self.row) + np.arange(len(new))
            self.row |= {names[k]: int(row[k]) for k in new}
            once, at = np.unique(seed[new], return_inverse=True)
            reached = np.concatenate([self._reached(once[k : k + 512]) for k in range(0, len(once), 512)])
            when = (reached[at] / weight[new, None]).view(np.int64)
            self.first = np.concatenate([self.first, when >> _ROW << _ROW | row[new, None]])
            self.by = np.concatenate([self.by, seed[new]])
        return row

    def _reached(self, x: np.ndarray) -> np.ndarray:
        first, clock, on = np.full((len(x), self.registers), np.inf), np.zeros(len(x)), np.arange(len(x))
        while len(on):
            x, t, reg = _next(x, clock, self.registers, 512)
            cells = reg + (on * self.registers)[:, None]
            fresh = np.isinf(first.reshape(-1)[cells])
            first.reshape(-1)[cells[fresh][::-1]] = t[fresh][::-1]  # of several arrivals the first stays
            more = np.isinf(first[on]).any(1)
            x, clock, on = x[more], t[more, -1], on[more]
        return first


#: Kept from batch to batch and from task to task.
arrivals = cache(Arrivals)


def _next(x: np.ndarray, clock: np.ndarray, registers: int, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's next arrivals: its state after them, their times at rate 1, their registers."""
    steps = np.arange(1, many + 1).astype(np.uint64) * _STEP
    y = _mix(x[:, None] + steps)
    t = -np.log1p(-(y >> np.uint64(11)).astype(np.float64) * 2.0**-53)
    t[:, 0] += clock
    return x + steps[-1], np.cumsum(t, axis=1, out=t), (_mix(y) % np.uint64(registers)).astype(np.int64)


def sketch(texts: list[str], registers: int) -> np.ndarray:
    """ProbMinHash of each text: the hash of the winning word in each register (0: none, for a text without words)."""
    n = len(texts)
    lens, code, vocab, seed = _coded([words(t) for t in texts])
    best, sig = np.full((n, registers), np.inf), np.zeros((n, registers), np.uint64)
    if not len(code):
        return sig
    long = np.fromiter((min(8, max(1, len(w) - 2)) for w in vocab), np.float64, len(vocab))
    cell, count = np.unique(np.repeat(np.arange(n), lens) * len(vocab) + code, return_counts=True)
    doc, word = np.divmod(cell, len(vocab))
    weight = count * long[word]
    # Words that many texts have: what their arrivals are is known.
    known, few = arrivals(registers), np.minimum(count, _COUNTS) - 1
    met = np.bincount(word * _COUNTS + few, minlength=len(vocab) * _COUNTS)
    met[np.unique((word * _COUNTS + few)[count > _COUNTS])] = 0
    item = np.flatnonzero(met)
    of, times = item // _COUNTS, item % _COUNTS + 1
    rows = np.full(len(met), -1)
    rows[item] = known.rows(seed[of], times, times * long[of], met[item] >= OFTEN)
    row = rows[word * _COUNTS + few]
    shared = row >= 0
    row, ends = row[shared], np.searchsorted(doc[shared], np.arange(n + 1))
    room, least = np.empty((max(1, int(np.diff(ends).max())), registers), np.int64), np.empty(registers, np.int64)
    for k, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        if s < e:
            np.minimum.reduce(known.first.take(row[s:e], 0, room[: e - s], "clip"), 0, out=least)
            best[k] = (least >> _ROW << _ROW).view(np.float64)
            sig[k] = known.by[least & (1 << _ROW) - 1]
    # The others send arrivals until they are too late for the text.
    doc, word, weight = doc[~shared], word[~shared], weight[~shared]
    best, sig = best.reshape(-1), sig.reshape(-1)
    clock, arrival = np.zeros(len(vocab)), seed.copy()
    while len(doc):
        used, local = np.unique(word, return_inverse=True)
        arrival[used], t, reg = _next(arrival[used], clock[used], registers, _BLOCK)
        clock[used] = t[:, -1]
        when = t[local] / weight[:, None]
        cells = (reg[local] + (doc * registers)[:, None]).ravel()
        last, when = when[:, -1], when.ravel()
        early = np.flatnonzero(when < best[cells])
        cells, when, by = cells[early], when[early], word[early // _BLOCK]
        np.minimum.at(best, cells, when)
        wins = best[cells] == when
        sig[cells[wins]] = seed[by[wins]]
        latest = best.reshape(n, registers).max(1)
        on = last < latest[doc]
        doc, word, weight = doc[on], word[on], weight[on]
    return sig.reshape(n, registers)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    n, m = sig.shape
    parts = sig.reshape(n, m // rows, rows)
    key = np.broadcast_to(_mix(np.arange(1, m // rows + 1).astype(np.uint64) * _STEP), (n, m // rows))
    for k in range(rows):
        key = _mix(key ^ parts[:, :, k]) + _STEP
    return key.view(np.int64)


def similar(a: str, b: str) -> float:
    """Common words over all words, repeats counted."""
    ca, cb = Counter(words(a)), Counter(words(b))
    common = sum((ca & cb).values())
    return common / max(1, ca.total() + cb.total() - common)


def _hashed(batches: Iterator[pa.RecordBatch], min_words: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Rows of enough words with c1 and c2; whole: also with content, n (words) and the bitmap m1, m2 in place of the id."""
    for b in batches:
        found = [words(t) if t is not None else None for t in b["content"].to_pylist()]
        kept = np.fromiter((ws is not None and len(ws) >= min_words for ws in found), bool, len(found))
        found = [ws for ws, ok in zip(found, kept) if ok]
        lens, code, _, seed = _coded(found)
        some = lens > 0
        starts = (np.cumsum(lens) - lens)[some]

        def over(f: np.ufunc, each: np.ndarray) -> np.ndarray:
            all_ = np.zeros(len(lens), np.uint64)
            if len(starts):
                all_[some] = f.reduceat(each[code], starts)
            return all_.view(np.int64)

        letters = np.fromiter(map("".join, found), object, len(found))
        made = {"c1": pd.util.hash_array(letters, categorize=False).view(np.int64), "c2": over(np.add, _mix(seed))}
        rows = b.filter(pa.array(kept))
        if whole:
            bit, half = np.uint64(1) << (seed & np.uint64(63)), seed >> np.uint64(7) & np.uint64(1)
            made |= {"content": rows["content"], "n": lens, "m1": over(np.bitwise_or, bit * (np.uint64(1) - half)), "m2": over(np.bitwise_or, bit * half)}
        else:
            made["id"] = rows["id"]
        yield pa.RecordBatch.from_pydict(made)


def _classes(records: DataFrame, id_col: str, content_col: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(members: c1, c2, id), (classes: c1, c2, content of one member, n, m1, m2); c1 is the hash of the letters, c2 of the bag of words."""
    kept = records.where(F.col(id_col).isNotNull() & F.col(content_col).isNotNull())
    members = kept.select(F.col(id_col).cast("string").alias("id"), F.col(content_col).alias("content")).mapInArrow(
        lambda batches: _hashed(batches, min_words, False), "c1 bigint, c2 bigint, id string"
    )
    texts = kept.select(F.col(content_col).alias("content")).mapInArrow(
        lambda batches: _hashed(batches, min_words, True), "c1 bigint, c2 bigint, content string, n bigint, m1 bigint, m2 bigint"
    )
    # By class alone, so that every later join on a class finds its side partitioned already, and as one
    # struct, so that all readers of the classes share one exchange whatever columns they need.
    classes = texts.groupBy(*CLASS).agg(F.min(F.struct("content", "n", "m1", "m2")).alias("c")).select(*CLASS, "c.*")
    return members, classes


def _meet(batches: Iterator[pd.DataFrame], heavy: int) -> Iterator[pd.DataFrame]:
    """Rows (key, c1, c2) sorted by key: the pairs of each key's classes; of keys with more than heavy rows each row instead, with its block."""
    held = np.zeros((3, 0), np.int64)
    over: tuple[int, int] | None = None  # the key that is known to be heavy, and its rows so far

    def out(a: np.ndarray, b: np.ndarray | None, key=None, block=None) -> pd.DataFrame:
        fill = lambda x: pd.arrays.IntegerArray(np.zeros(a.shape[1], np.int64) if x is None else x, np.full(a.shape[1], x is None))
        b1, b2 = (None, None) if b is None else b
        return pd.DataFrame({"a1": a[0], "a2": a[1], "b1": fill(b1), "b2": fill(b2), "key": fill(key), "block": fill(block)})

    def paired(rows: np.ndarray) -> Iterator[pd.DataFrame]:
        key, c1, _ = rows
        at, made = np.arange(len(key)), []
        for d in range(1, len(key)):
            at = at[: np.searchsorted(at, len(key) - d)]
            at = at[key[at] == key[at + d]]  # they have a row of their key d places on
            if not len(at):
                break
            ok = at[c1[at] != c1[at + d]]  # same letters are no pair
            made.append(np.where(c1[ok] < c1[ok + d], (ok, ok + d), (ok + d, ok)))
        if made and sum(m.shape[1] for m in made):
            x, y = np.concatenate(made, axis=1)
            yield out(rows[1:, x], rows[1:, y])

    def split(rows: np.ndarray, start: int) -> pd.DataFrame:
        return out(rows[1:], None, rows[0], (start + np.arange(rows.shape[1])) // heavy)

    for b in batches:
        rows = np.concatenate([held, [b[c].to_numpy() for c in ("key", *CLASS)]], axis=1)
        key = rows[0]
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([starts, [len(key)]]))
        big = size > heavy
        if over is not None and key[0] == over[0]:
            big[0] = True
        for s, n in zip(starts[big], size[big]):
            done = over[1] if over is not None and over[0] == key[s] else 0
            yield split(rows[:, s : s + n], done)
            over = (int(key[s]), done + int(n))
        light = np.repeat(~big & (size > 1), size)
        tail = int(starts[-1]) if not big[-1] else len(key)  # the last key may go on in the next batch
        yield from paired(rows[:, :tail][:, light[:tail]])
        held = rows[:, tail:]
        if not big[-1]:
            over = None
    yield from paired(held)


def _candidates(banded: DataFrame, heavy: int, tasks: int) -> DataFrame:
    """a1, a2, b1, b2: distinct pairs of classes (a < b) that share a band."""
    met = cut(
        banded.repartition(tasks, "key").sortWithinPartitions("key").mapInPandas(
            lambda batches: _meet(batches, heavy), "a1 bigint, a2 bigint, b1 bigint, b2 bigint, key bigint, block bigint"
        )
    )
    rows = met.where("key is not null")
    blocks = rows.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    spread = rows.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.struct(F.col("a1").alias("c1"), F.col("a2").alias("c2")).alias("c")
    )
    left, right = spread.where("block = lo").withColumnRenamed("c", "x"), spread.where("block = hi").withColumnRenamed("c", "y")
    crossed = (
        left.drop("block").join(right.drop("block"), ["key", "lo", "hi"])
        .where("(lo < hi or x < y) and x.c1 <> y.c1")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .select(F.col("a.c1").alias("a1"), F.col("a.c2").alias("a2"), F.col("b.c1").alias("b1"), F.col("b.c2").alias("b2"))
    )
    return met.where("key is null").select("a1", "a2", "b1", "b2").unionByName(crossed).distinct()


def similar_classes(classes: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, bands: int = BANDS, heavy: int = HEAVY, tasks: int | None = None) -> DataFrame:
    """a1, a2, b1, b2: pairs of classes (a < b) at or above the threshold (runs one job)."""

    def bands_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                keys = band_keys(sketch(list(part["content"]), rows * bands), rows)
                yield pd.DataFrame({"key": keys.ravel(), "c1": np.repeat(part["c1"].to_numpy(), bands), "c2": np.repeat(part["c2"].to_numpy(), bands)})

    banded = classes.select(*CLASS, "content").mapInPandas(bands_of, "key bigint, c1 bigint, c2 bigint")
    pairs = _candidates(banded, heavy, tasks or tasks_for(classes))
    side = lambda s: classes.select(F.col("c1").alias(f"{s}1"), F.col("c2").alias(f"{s}2"), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "m1", "m2")))
    apart = F.bit_count(F.col("m1_a").bitwiseXOR(F.col("m1_b"))) + F.bit_count(F.col("m2_a").bitwiseXOR(F.col("m2_b")))
    possible = (
        pairs.join(side("a"), ["a1", "a2"])
        .join(side("b"), ["b1", "b2"])
        .where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
        # each bit that differs stands for at least one word that the texts do not share
        .where(apart <= (1 - 2 * threshold / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) + 1e-9)
        .select("a1", "a2", "b1", "b2")
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [similar(x, y) >= threshold - 1e-12 for x, y in zip(b["text_a"], b["text_b"])]
            yield b.loc[ok, ["a1", "a2", "b1", "b2"]]

    text = lambda s: classes.select(F.col("c1").alias(f"{s}1"), F.col("c2").alias(f"{s}2"), F.col("content").alias(f"text_{s}"))
    return (
        possible.join(text("a"), ["a1", "a2"]).join(text("b"), ["b1", "b2"]).select("a1", "a2", "b1", "b2", "text_a", "text_b")
        .mapInPandas(verify, "a1 bigint, a2 bigint, b1 bigint, b2 bigint")
    )


def similar_pairs(records: DataFrame, id_col: str = "id", content_col: str = "content", min_words: int = MIN_WORDS, threshold: float = THRESHOLD, rows: int = ROWS, bands: int = BANDS, heavy: int = HEAVY) -> DataFrame:
    """id_a, id_b (id_a < id_b): all pairs of records at or above the threshold."""
    members, classes = _classes(records, id_col, content_col, min_words)
    found = similar_classes(classes, threshold, rows, bands, heavy, tasks_for(records))
    side = lambda s: members.select(F.col("c1").alias(f"{s}1"), F.col("c2").alias(f"{s}2"), F.col("id").alias(f"id_{s}")).distinct()
    return found.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"]).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def membership(records: DataFrame, id_col: str = "id", content_col: str = "content", min_words: int = MIN_WORDS, threshold: float = THRESHOLD, rows: int = ROWS, bands: int = BANDS, heavy: int = HEAVY) -> DataFrame:
    """id, class_id, links: every record of enough words, the class of its copies and how many other classes are similar to it."""
    members, classes = _classes(records, id_col, content_col, min_words)
    found = similar_classes(classes, threshold, rows, bands, heavy, tasks_for(records))
    ends = F.explode(F.array(F.struct(F.col("a1").alias("c1"), F.col("a2").alias("c2")), F.struct(F.col("b1").alias("c1"), F.col("b2").alias("c2"))))
    links = found.select(ends.alias("c")).groupBy(F.col("c.c1").alias("c1"), F.col("c.c2").alias("c2")).agg(F.count("*").alias("links"))
    name = F.lower(F.concat(F.lpad(F.hex("c1"), 16, "0"), F.lpad(F.hex("c2"), 16, "0")))
    return members.distinct().join(links, list(CLASS), "left").select("id", name.alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
