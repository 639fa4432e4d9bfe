"""Filling fixed-capacity containers with texts by sum-of-squares packing.

Texts are measured in tokens of a public tokenizer. A text over the capacity is split into full
containers and a rest; everything else is placed whole. Each text goes where the sum over gaps of
squared counts of open containers becomes smallest: into the container with that gap, or a new one.

Every task packs its own stream of texts; its state is one count per gap and the numbers of open
containers, whatever the input's size. Texts are dealt to tasks by a hash of their id, so a hot
session or source spreads evenly. Containers that are still open at a task's end are merged in a
second pass of the same rule, with whole containers as items, in one task per ``merge_group`` parts.

Defined results: a null text or one without tokens has no container (null) and 0 tokens; equal
texts under several ids are packed each; of rows that repeat an id each is packed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from engramlake.llm.vocabulary import TOKENIZER, content, encoder
from engramlake.runtime import cut

CAPACITY = 2048
#: Texts a task packs, so that few containers stay half empty; the number of tasks follows the number of texts.
TEXTS_PER_TASK = 5_000


def token_counts(documents: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """documents with a column tokens (0 for null); the driver reads the tokenizer's file and sends it along."""
    ranks_file = documents.sparkSession.sparkContext.broadcast(content(tokenizer))

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        e = encoder(ranks_file.value)
        return pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return documents.withColumn("tokens", count(F.col(text_col)))


class Bins:
    """Open containers by gap, and the rule that chooses among them."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # by gap; gap 0 is closed and never counted
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> int:
        """The number of the container that takes an item of this size."""
        c, n = self.capacity, self.count
        # Change of the sum of squares when a container with gap g takes the item, up to a constant:
        # n[g] goes down by one, n[g - size] up by one; a new container only adds one at c - size.
        after = n[: c - size + 1].copy()
        after[0] = -1  # a full container is not counted
        gain = np.where(n[size:] > 0, 2 * (after - n[size:]) + 2, np.iinfo(np.int64).max)
        gain[0] = 1 - 2 * n[size] if n[size] else gain[0]
        best = int(gain.argmin()) + size
        new = 2 * n[c - size] + 1 if size < c else 0
        if gain[best - size] <= new:
            at = self.open[best].pop()
            n[best] -= 1
            left = best - size
        else:
            at, left = self.made, c - size
            self.made += 1
        if left:
            self.open[left].append(at)
            n[left] += 1
        return at


def pack_task(pdf_iter: Iterator[pd.DataFrame], capacity: int, part: int) -> Iterator[pd.DataFrame]:
    bins = Bins(capacity)
    for pdf in pdf_iter:
        rows: list[tuple] = []
        for doc, tokens in zip(pdf["doc_id"], pdf["tokens"]):
            if tokens == 0:
                rows.append((doc, 0, 0, 0, None, None))
                continue
            piece, at = 0, 0
            while at < tokens:
                size = min(capacity, tokens - at)
                rows.append((doc, piece, at, size, part, bins.place(size)))
                piece, at = piece + 1, at + size
        yield pd.DataFrame(rows, columns=["doc_id", "piece", "first_token", "tokens", "part", "bin"]).astype({"part": "Int64", "bin": "Int64"})


def packed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, texts_per_task: int = TEXTS_PER_TASK, merge_group: int = 64) -> DataFrame:
    """doc_id, piece, first_token, tokens, container: one row a text, more only for texts over the capacity."""
    sized = cut(token_counts(documents.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col), text_col, tokenizer).select("doc_id", "tokens"))
    tasks = max(1, -(-sized.count() // texts_per_task))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        yield from pack_task(batches, capacity, TaskContext.get().partitionId())

    first = cut(
        sized.repartition(tasks, F.xxhash64("doc_id")).sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)), "doc_id").mapInPandas(
            pack, "doc_id bigint, piece bigint, first_token bigint, tokens bigint, part bigint, bin bigint"
        )
    )
    fills = first.where("bin is not null").groupBy("part", "bin").agg(F.sum("tokens").alias("fill"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        bins = Bins(capacity)
        return pdf.assign(into=[bins.place(int(f)) for f in pdf["fill"]])[["part", "bin", "into"]]

    # Containers under half full: at most a few a task. Larger ones could take only each other's like.
    light = fills.where(F.col("fill") <= capacity // 2)
    merged = light.groupBy(F.expr(f"part div {merge_group}").alias("g")).applyInPandas(
        lambda key, pdf: merge(pdf.sort_values(["fill", "part", "bin"], ascending=[False, True, True])).assign(g=key[0])[["g", "part", "bin", "into"]],
        "g bigint, part bigint, bin bigint, into bigint",
    )
    name = F.when(F.col("into").isNotNull(), F.concat_ws("-", F.lit("m"), F.col("g").cast("string"), F.col("into").cast("string"))).when(
        F.col("bin").isNotNull(), F.concat_ws("-", F.lit("c"), F.col("part").cast("string"), F.col("bin").cast("string"))
    )
    return first.join(merged, ["part", "bin"], "left").select("doc_id", "piece", "first_token", "tokens", name.alias("container"))
