"""Curation: what a reply may change, prompts of a cycle, review and recall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from engramlake.config import Config
from engramlake.functions import scoring
from engramlake.functions.text import label, str_blank
from engramlake.operators import inject
from engramlake.operators.retrieval import nearest
from engramlake.operators.running import running


def guarded(ops: DataFrame, cfg: Config, active_project: Column | None = None) -> DataFrame:
    """Parsed ops, joined to the records their handles mean, with the first reason against each (null: none).

    Expects kind, section, text, and of the record (null for inserts): r_locked, r_section.
    """
    project = F.lit(None).cast("string") if active_project is None else active_project
    k = F.col("kind")
    writes = k.isin("INSERT", "UPDATE")
    reason = (
        F.when(k.isin("UPDATE", "DEPRECATE") & F.coalesce("r_locked", F.lit(False)), "locked")
        .when(k.isin("UPDATE", "DEPRECATE") & F.col("r_section").isNull(), "not_found")
        .when(writes & str_blank(F.col("text")), "blank")
        .when(writes & ~F.coalesce(F.is_valid_utf8("text"), F.lit(False)), "utf8")
        .when(writes & (F.char_length("text") > cfg.content_max_chars), "too_long")
        .when((k == "INSERT") & (F.col("section") == "project") & project.isNull(), "no_project")
    )
    return ops.withColumn("reason", reason).withColumn("needs_quorum", k.isin("UPDATE", "DEPRECATE") & (F.coalesce("r_section", F.lit("")) == "identity") & reason.isNull())


def duplicates(inserts: DataFrame, index: DataFrame, cfg: Config) -> DataFrame:
    """query_id, id, cos: the record an insert repeats (same section and project, best cosine only).

    Both sides have vec and scope; such an insert becomes an access of that record.
    """
    return nearest(index, inserts, 1, floor=cfg.dup_threshold, scope="scope").drop("rank")


def scope(section: Column, project: Column) -> Column:
    return F.concat_ws("/", section, F.when(section == "project", project))


def quorum(proposals: DataFrame, window: int, slices: int | None = None) -> DataFrame:
    """proposals with confirmed: whether an equal one (id, kind, hash) waited, no older than the window.

    A confirmed proposal uses the waiting one up, so within a stretch of neighbours no further apart than
    the window every second one is confirmed. Expects id, kind, hash, at; equal rows are one proposal.
    """
    keys = ["id", "kind", "hash"]
    once = proposals.select(*keys, "at").distinct()
    gaps = running(once, keys, ["at"], "at", previous={"before": F.col("at")}, slices=slices, keep_slices=True)
    parted = running(gaps.withColumn("opens", F.coalesce(F.col("at") - F.col("before") > window, F.lit(True)).cast("int")), keys, ["at"], "at", total={"stretch": F.col("opens")}, slices=slices, keep_slices=True)
    placed = running(parted, [*keys, "stretch"], ["at"], "at", total={"place": F.lit(1)}, slices=slices)
    return placed.select(*keys, "at", (F.col("place") % 2 == 0).alias("confirmed"))


def first_in_cycle(proposals: DataFrame, cycle: str, line: str) -> DataFrame:
    """Each proposal once a cycle, so that a reply can't confirm itself."""
    return proposals.groupBy(cycle, "id", "kind", "hash").agg(F.min(line).alias(line))


def reviewed(records: DataFrame, verdicts: DataFrame, at: int) -> DataFrame:
    """Records after KEEP and DEPRECATE verdicts (id, kind), the first of each id counting; locked ones stay."""
    v = verdicts.groupBy("id").agg(F.first("kind").alias("verdict"))
    free = ~F.col("locked")
    keep, drop = free & (F.col("verdict") == "KEEP"), free & (F.col("verdict") == "DEPRECATE")
    keep, drop = F.coalesce(keep, F.lit(False)), F.coalesce(drop, F.lit(False))
    return records.join(v, "id", "left").select(
        *(c for c in records.columns if c not in ("deprecated", "deprecated_at", "last_access", "relevance")),
        F.when(keep, False).when(drop, True).otherwise(F.col("deprecated")).alias("deprecated"),
        F.when(keep, F.lit(0)).when(drop & ~F.col("deprecated"), F.lit(at)).otherwise(F.col("deprecated_at")).cast("bigint").alias("deprecated_at"),
        F.when(keep, F.lit(at)).otherwise(F.col("last_access")).cast("bigint").alias("last_access"),
        F.when(keep, scoring.boosted(F.col("relevance"), F.lit(1))).otherwise(F.col("relevance")).alias("relevance"),
    )


def touched(records: DataFrame, notes: DataFrame, at: int) -> DataFrame:
    """Records after access notes (id, n): counted, boosted n times, accessed now."""
    hit = F.col("n").isNotNull()
    return records.join(notes.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").select(
        *(c for c in records.columns if c not in ("access_count", "relevance", "last_access")),
        scoring.clamp_count(F.col("access_count") + F.coalesce("n", F.lit(0))).alias("access_count"),
        F.when(hit, scoring.boosted(F.col("relevance"), F.col("n"))).otherwise(F.col("relevance")).alias("relevance"),
        F.when(hit, F.lit(at)).otherwise(F.col("last_access")).cast("bigint").alias("last_access"),
    )


def memory_lines(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """handle, line of numbered records, with their keys."""
    return found.select(*keys, "handle", F.concat(F.lit("[M"), F.col("handle").cast("string"), F.lit("] "), label(F.col("section"), F.col("project")), F.lit(" "), F.col("content")).alias("line"))


def _list(lines: DataFrame, head: str, empty: str) -> DataFrame:
    block = inject.joined(lines, "handle", "line")
    return block.select(F.when(F.coalesce(F.col("block"), F.lit("")) == "", F.lit(empty)).otherwise(F.concat(F.lit(head), F.col("block"), F.lit("\n"))).alias("block"))


def cycle_prompts(turns: DataFrame, related: DataFrame, cfg: Config) -> DataFrame:
    """session, prompt: the numbered memories and the newest turns that fit; related has handle, section, project, content.

    If related has session, each session is shown its own memories, else all are shown the same.
    """
    talk = inject.joined(inject.transcript_tail(turns, cfg.transcript_tokens), "seq", "line", ["session"], "talk")
    head, empty = "Existing memories:\n", "Existing memories: (none)\n"
    if "session" in related.columns:
        own = inject.joined(memory_lines(related, ["session"]), "handle", "line", ["session"])
        shown = F.when(F.col("block").isNull(), F.lit(empty)).otherwise(F.concat(F.lit(head), F.col("block"), F.lit("\n")))
        return talk.join(own, "session", "left").select("session", F.concat(shown, F.lit("\nConversation:\n"), "talk", F.lit("\n")).alias("prompt"))
    memories = _list(memory_lines(related), head, empty)
    return talk.crossJoin(F.broadcast(memories)).select("session", F.concat("block", F.lit("\nConversation:\n"), "talk", F.lit("\n")).alias("prompt"))  # one row


def recall_prompt(question: str, found: DataFrame) -> DataFrame:
    lines = _list(memory_lines(found), "Memories:\n", "Memories: (none)\n")
    return lines.select(F.concat(F.lit(f"Question: {question}\n\n"), "block").alias("prompt"))


def review_prompt(lines: DataFrame) -> DataFrame:
    return _list(lines, "Candidate memories:\n", "Candidate memories: (none)\n").select(F.col("block").alias("prompt"))


def turns_accepted(turns: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Turns of user or assistant with a text; a turn delivered twice is one turn. also: columns that follow from session and seq."""
    return turns.where(F.col("role").isin("user", "assistant") & ~str_blank(F.col("text"))).dropDuplicates(["session", "seq", *also])


def turn_batches(turns: DataFrame, cfg: Config, slices: int | None = None) -> DataFrame:
    """session, seq, batch: batches of turn_batch in order of seq."""
    numbered = running(turns, ["session"], ["seq"], "seq", total={"place": F.lit(1)}, slices=slices)
    return numbered.select("session", "seq", F.floor((F.col("place") - 1) / cfg.turn_batch).cast("bigint").alias("batch"))


def idle_gaps(turns: DataFrame, cfg: Config, slices: int | None = None) -> DataFrame:
    """session, seq, gap: turns that came at least idle_flush seconds after the one before."""
    timed = running(turns.where("at is not null"), ["session"], ["seq"], "seq", previous={"before": F.col("at")}, slices=slices)
    return timed.select("session", "seq", (F.col("at") - F.col("before")).alias("gap")).where(F.col("gap") >= cfg.idle_flush)


def queued(turns: DataFrame, cfg: Config) -> DataFrame:
    """The newest event_queue_max turns of each session: what a queue that drops its oldest still holds."""
    by = W.partitionBy("session").orderBy(F.desc("seq"))
    return turns.withColumn("from_end", F.row_number().over(by)).where(F.col("from_end") <= cfg.event_queue_max)
