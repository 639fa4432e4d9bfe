"""Evaluation texts leaking into training text, by greedy string tiling.

Seeds are shared windows of ``least`` words (Karp-Rabin hashes), found by a join:

1. every window hash of the items sets a bit in a filter of fixed size (8 MB, whatever the items); the
   filter goes to the tasks, and each document is read once and keeps the windows that may be in an item;
2. documents that keep any are written with those windows, and the windows joined with the items' windows
   on the hash; no document or item is ever gathered in one place;
3. each pair of document and item that shares a window is tiled: the longest common runs of words that do
   not overlap are marked again and again until none of ``least`` words is left, so that passages in
   another order count too. Matches are compared word by word, never by hash alone.

A document's ``coverage`` of an item is the share of the item's words in tiles; ``min_coverage`` is the threshold.

Defined results: null texts and texts under ``least`` words leak nothing; case and everything but
letters and digits is ignored; items that repeat an id are tiled one by one and the best row
counts; documents that repeat an id give one row an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engramlake.llm.text import words
from engramlake.runtime import cut

LEAST = 12
#: Bits of the filter, in words of 64.
FILTER_WORDS = 1 << 20
_BASE = np.uint64(0x100000001B3)

REPORT = "item_id bigint, tiles bigint, longest bigint, covered bigint, item_words bigint, reordered boolean"


def word_hashes(vocab: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(vocab, dtype=object), categorize=False).astype(np.uint64) if vocab else np.zeros(0, np.uint64)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of every k neighbouring words."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + h[j : j + n]
    return out


def tiles(item: list[str], doc: list[str], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(item position, document position, length) of the tiles, longest first."""
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []
    starts: dict[tuple[str, ...], list[int]] = {}
    for p in range(len(item) - least + 1):
        starts.setdefault(tuple(item[p : p + least]), []).append(p)
    seeds = [(p, q) for q in range(len(doc) - least + 1) for p in starts.get(tuple(doc[q : q + least]), ())]
    while seeds:
        best, kept = 0, []
        runs: list[tuple[int, int, int]] = []
        reach: dict[int, int] = {}  # diagonal -> where its last run ends
        for p, q in seeds:
            if not all(free_i[p : p + least]) or not all(free_d[q : q + least]):
                continue
            kept.append((p, q))
            if reach.get(p - q, -1) > p:
                continue
            n = least
            while p + n < len(item) and q + n < len(doc) and free_i[p + n] and free_d[q + n] and item[p + n] == doc[q + n]:
                n += 1
            reach[p - q] = p + n
            runs.append((p, q, n))
            best = max(best, n)
        seeds = kept
        for p, q, n in runs:
            if n == best and all(free_i[p : p + n]) and all(free_d[q : q + n]):
                free_i[p : p + n], free_d[q : q + n] = [False] * n, [False] * n
                out.append((p, q, n))
        if not runs:
            break
    return out


def text_windows(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of every window of least words that lies within one text."""
    found = [words(t) for t in texts]
    lens = np.fromiter(map(len, found), np.int64, len(found))
    if lens.sum() < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    coded = pa.array([w for ws in found for w in ws], pa.string()).dictionary_encode()
    h = windows(word_hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy()], least)
    doc = np.repeat(np.arange(len(found)), lens)[: len(h)]
    inside = np.arange(len(h)) + least <= np.cumsum(lens)[doc]
    return doc[inside], h[inside]


def _filter(item_windows: DataFrame, size: int) -> np.ndarray:
    """The bits of all items' windows; at most size rows (words of 64 bits, a power of two) reach the driver."""
    place = F.col("h").bitwiseAND(64 * size - 1)
    bits = item_windows.select((F.shiftright(place, 6)).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(size, np.int64)
    out[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST, min_coverage: float = 0.0, filter_words: int = FILTER_WORDS) -> DataFrame:
    """doc_id, item_id, tiles, longest, covered, item_words, reordered, coverage of every pair with a tile.

    reordered: whether the document has the item's passages in another order. Runs two small jobs over the
    items and one over the documents.
    """
    key_type = dict(documents.dtypes)[doc_id]
    docs = documents.where(F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    given = cut(items.where(F.col(item_text).isNotNull()).select(F.monotonically_increasing_id().alias("item"), F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("item_text")))

    def windows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, h = text_windows(list(b["item_text"]), least)
            if len(h):
                yield pd.DataFrame({"item": b["item"].to_numpy()[at], "h": h.view(np.int64)}).drop_duplicates()

    item_windows = cut(given.mapInPandas(windows_of, "item bigint, h bigint"))
    shared = documents.sparkSession.sparkContext.broadcast(_filter(item_windows, filter_words))

    def may_leak(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for b in batches:
            for start in range(0, len(b), 500):
                part = b.iloc[start : start + 500]
                at, h = text_windows(list(part["text"]), least)
                place = h & np.uint64(64 * filter_words - 1)
                hit = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
                if hit.any():
                    kept = pd.Series(h[hit].view(np.int64)).groupby(at[hit]).unique()
                    yield part.iloc[kept.index.to_numpy()].assign(seeds=list(kept))

    near = cut(docs.mapInPandas(may_leak, f"doc_id {key_type}, text string, seeds array<bigint>").withColumn("doc", F.monotonically_increasing_id()))
    pairs = near.select("doc", F.explode("seeds").alias("h")).join(item_windows, "h").select("doc", "item").distinct()

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, item, item_text in zip(b["doc_id"], b["text"], b["item_id"], b["item_text"]):
                w = words(item_text)
                if t := tiles(w, words(text), least):
                    order = [q for _, q, _ in sorted(t)]
                    rows.append((doc, item, len(t), t[0][2], sum(n for _, _, n in t), len(w), order != sorted(order)))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "tiles", "longest", "covered", "item_words", "reordered"])

    out = pairs.join(near.select("doc", "doc_id", "text"), "doc").join(given, "item").select("doc_id", "text", "item_id", "item_text").mapInPandas(tile, f"doc_id {key_type}, {REPORT}")
    return (
        out.groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("covered", "longest", "tiles", "item_words", "reordered")).alias("b"))
        .select("doc_id", "item_id", "b.tiles", "b.longest", "b.covered", "b.item_words", "b.reordered", F.round(F.col("b.covered") / F.col("b.item_words"), 6).alias("coverage"))
        .where(F.col("coverage") >= min_coverage)
    )
