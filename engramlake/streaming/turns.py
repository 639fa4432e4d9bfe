"""Streams: turns to batches, access notes to the journal, proposals to confirmations.

Event sources are any streaming DataFrame. State is kept per session or proposal by Spark's state store, so
a lost executor resumes from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engramlake.config import Config
from engramlake.functions.text import str_blank

BATCH = "session string, batch bigint, reason string, turns bigint, first_seq bigint, last_seq bigint, transcript string, dropped bigint"


def accepted(turns: DataFrame) -> DataFrame:
    """Turns of user or assistant with a text, once each within a day of the stream's time."""
    good = turns.where(F.col("role").isin("user", "assistant") & ~str_blank(F.col("text")) & F.col("session").isNotNull())
    return good.withColumn("event_time", F.timestamp_seconds(F.coalesce("at", F.lit(0)))).withWatermark("event_time", "1 day").dropDuplicatesWithinWatermark(["session", "seq"])


def batches(turns: DataFrame, cfg: Config, idle: bool = True) -> DataFrame:
    """A row for each batch of a session: as soon as it has turn_batch turns ('count'), or when nothing came
    for idle_flush seconds of processing time ('idle'). A queue over event_queue_max drops its oldest turns.
    """
    size, cap, wait = cfg.turn_batch, cfg.event_queue_max, cfg.idle_flush * 1000

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, roles, texts, done, dropped = state.get if state.exists else ([], [], [], 0, 0)
        queue = list(zip(seqs, roles, texts))
        out = []

        def emit(n: int, reason: str) -> None:
            nonlocal queue, done, dropped
            part, queue = queue[:n], queue[n:]
            lines = [("USER: " if r == "user" else "ASSISTANT: ") + t for _, r, t in part]
            out.append((key[0], done, reason, len(part), part[0][0], part[-1][0], "\n".join(lines), dropped))
            done, dropped = done + 1, 0

        if state.hasTimedOut:
            if queue:
                emit(len(queue), "idle")
        else:
            came = sorted((int(s), r, t) for pdf in pdfs for s, r, t in zip(pdf["seq"], pdf["role"], pdf["text"]))
            for turn in came:
                queue.append(turn)
                if len(queue) >= size:
                    emit(size, "count")
            if len(queue) > cap:
                dropped += len(queue) - cap
                queue = queue[-cap:]
        state.update(([q[0] for q in queue], [q[1] for q in queue], [q[2] for q in queue], done, dropped))
        if idle and queue:
            state.setTimeoutDuration(wait)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BATCH.split(", ")])

    return (
        turns.select("session", "seq", "role", "text")
        .groupBy("session")
        .applyInPandasWithState(
            step, BATCH, "seqs array<bigint>, roles array<string>, texts array<string>, done bigint, dropped bigint", "append",
            GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout,
        )
    )


def access_journal(notes: DataFrame, append: Callable[[DataFrame, int], None], now: Callable[[], int], checkpoint: str) -> StreamingQuery:
    """Notes (id) of each micro-batch become access ops; append gets the batch's number, to write it once only."""

    def flush(batch: DataFrame, number: int) -> None:
        counted = batch.where("id is not null").groupBy(F.lower("id").alias("id")).agg(F.count("*").alias("n"))
        ops = counted.select(F.lit("access").alias("kind"), F.lit(now()).cast("bigint").alias("at"), F.array_repeat("id", F.col("n").cast("int")).alias("ids"))
        append(ops, number)

    return notes.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def confirmations(proposals: DataFrame, window: int) -> DataFrame:
    """id, kind, hash, at of proposals that an equal one, no older than window seconds, was waiting for."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = state.get[0] if state.exists else None
        out = []
        for at in sorted({int(a) for pdf in pdfs for a in pdf["at"]}):
            if waiting is not None and at - waiting <= window:
                out.append((*key, at))
                waiting = None
            else:
                waiting = at
        if waiting is None:
            state.remove()
        else:
            state.update((waiting,))
        if out:
            yield pd.DataFrame(out, columns=["id", "kind", "hash", "at"])

    return proposals.select("id", "kind", "hash", "at").groupBy("id", "kind", "hash").applyInPandasWithState(
        step, "id string, kind string, hash string, at bigint", "waiting bigint", "append", GroupStateTimeout.NoTimeout
    )
