"""Replay of the journal in the order of delivery, as a set operation.

Per id, over the ops after the record began (its base row or its first valid insert):
last lock wins; the status is that of the last deprecate or keep, deprecated_at the first deprecate
after the last keep; an update counts if the status before it is active; boosts add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from engramlake.functions import scoring
from engramlake.operators import records as R
from engramlake.operators.changefeed import seconds
from engramlake.operators.running import running

KINDS = ("insert", "update", "deprecate", "keep", "set_locked", "access", "project_create")


def op_problem():
    """Why an op can't be read, null if it can."""
    kind = F.col("kind")
    return (
        F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "kind")
        .when(F.col("at").isNull(), "at")
        .when((kind == "insert") & (F.col("record").isNull() | R.problem("record.").isNotNull()), "record")
        .when(kind.isin("update", "deprecate", "keep", "set_locked") & ~R.uuid_valid(F.col("id")), "id")
        .when((kind == "update") & R.str_blank(F.col("content")), "content")
        .when((kind == "set_locked") & F.col("value").isNull(), "value")
        .when((kind == "access") & F.col("ids").isNull(), "ids")
        .when((kind == "project_create") & ~R.slug_valid(F.col("project")), "project")
    )


def readable(ops: DataFrame) -> DataFrame:
    return ops.where(op_problem().isNull()).withColumn("at", seconds(F.col("at")))


def malformed(ops: DataFrame) -> DataFrame:
    return ops.select("seq", "kind", op_problem().alias("reason")).where("reason is not null")


def journal_ends_torn(ops: DataFrame) -> DataFrame:
    """One row: bad rows, and whether they are only the tail (then the journal is cut there; else it is corrupt)."""
    return ops.agg(
        F.count_if(op_problem().isNotNull()).alias("bad"),
        F.coalesce(F.min(F.when(op_problem().isNotNull(), F.col("seq"))) > F.max(F.when(op_problem().isNull(), F.col("seq"))), F.lit(True)).alias("only_tail"),
    )


def access_counts(ops: DataFrame) -> DataFrame:
    """id, n: how often each id was noted, with multiplicity, over all access ops."""
    return readable(ops).where("kind = 'access'").select(F.explode("ids").alias("id")).groupBy(F.lower("id").alias("id")).agg(F.count("*").alias("n"))


def replay(base: DataFrame, ops: DataFrame, now: int, slices: int | None = None) -> DataFrame:
    """The records after the journal (one small job for the slices)."""
    good = readable(ops)
    fields = [f.name for f in ops.schema["record"].dataType.fields]
    inserted = good.where("kind = 'insert'").select(F.lower("record.id").alias("id"), "seq", *(F.col(f"record.{f}").alias(f"r_{f}") for f in fields))
    first = inserted.groupBy("id").agg(F.min_by(F.struct("*"), "seq").alias("i")).select("i.*")
    fresh = R.read(first.select(*(F.col(f"r_{f}").alias(f) for f in fields)), now).join(first.select("id", F.col("seq").alias("born")), "id")
    start = R.read(base, now).withColumn("born", F.lit(-1).cast("bigint"))
    start = start.unionByName(fresh.join(start.select("id"), "id", "left_anti"))
    target = lambda k: good.where(F.col("kind").isin(*k)).select(F.lower("id").alias("id"), "seq", "kind", "at", "content", "value", F.lit(1).alias("n"))
    touched = good.where("kind = 'access'").select(F.explode("ids").alias("one"), "seq", "at").groupBy(F.lower("one").alias("id"), "seq", "at").agg(F.count("*").cast("int").alias("n"))
    noted = touched.select("id", "seq", F.lit("access").alias("kind"), "at", F.lit(None).cast("string").alias("content"), F.lit(None).cast("boolean").alias("value"), "n")
    began = start.select("id", F.col("born").alias("seq"), F.lit("start").alias("kind"), F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("string").alias("content"), (~F.col("deprecated")).alias("value"), F.lit(0).alias("n"))
    events = target(["update", "deprecate", "keep", "set_locked"]).unionByName(noted).unionByName(began)
    kind = F.col("kind")
    seen = running(
        events, ["id"], ["seq"], "seq",
        last={
            "alive": F.when(kind == "start", True),
            "active": F.when(kind == "start", F.col("value")).when(kind == "keep", True).when(kind == "deprecate", False),
            "kept_at_seq": F.when(kind.isin("start", "keep"), F.col("seq")),
        },
        slices=slices,
    ).where("alive and kind <> 'start'")
    when = lambda k, c="at": F.when(kind.isin(*k), F.col(c))
    live_update = (kind == "update") & F.col("active")
    changes = seen.groupBy("id").agg(
        F.max_by("content", F.when(live_update, F.col("seq"))).alias("n_content"),
        F.max_by("at", F.when(live_update, F.col("seq"))).alias("n_updated"),
        F.max_by("value", when(["set_locked"], "seq")).alias("n_locked"),
        F.max_by("at", when(["keep", "access"], "seq")).alias("n_access"),
        F.coalesce(F.sum(when(["access"], "n")), F.lit(0)).alias("n_touch"),
        F.coalesce(F.sum(when(["access", "keep"], "n")), F.lit(0)).alias("n_boost"),
        F.max_by(kind == "keep", when(["keep", "deprecate"], "seq")).alias("n_active"),
        # the first deprecate of the last active stretch
        F.max_by("at", F.when(kind == "deprecate", F.struct("kept_at_seq", -F.col("seq")))).alias("n_gone"),
        F.max(F.when(kind == "deprecate", F.col("kept_at_seq"))).alias("gone_stretch"),
    )
    gone = F.col("n_active").isNotNull() & ~F.col("n_active")
    was = F.col("deprecated")
    never_kept = F.col("gone_stretch") == F.col("born")
    return start.join(changes, "id", "left").select(
        "id", "section", "project", F.coalesce("n_content", "content").alias("content"), "source", "created_at",
        F.coalesce("n_updated", "updated_at").alias("updated_at"), F.coalesce("n_access", "last_access").alias("last_access"),
        (F.col("access_count") + F.coalesce("n_touch", F.lit(0))).cast("bigint").alias("access_count"),
        scoring.boosted(F.col("relevance"), F.coalesce("n_boost", F.lit(0))).alias("relevance"),
        F.coalesce("n_locked", "locked").alias("locked"),
        F.when(F.col("n_active").isNull(), was).otherwise(gone).alias("deprecated"),
        F.when(F.col("n_active").isNull() | (gone & was & never_kept), F.col("deprecated_at")).when(gone, F.col("n_gone")).otherwise(F.lit(0)).cast("bigint").alias("deprecated_at"),
        "supersedes", "tags",
    )


def op_outcomes(base: DataFrame, ops: DataFrame, now: int, max_chars: int = 500, slices: int | None = None) -> DataFrame:
    """seq, kind, outcome of host ops on records: ok, invalid, not_found or locked, each against the state before it.

    Existence and locks come first; whether a deprecate was accepted depends on the lock before it,
    and whether an update meets a deprecated record on the accepted ones.
    """
    good = readable(ops).where(F.col("kind").isin("insert", "update", "deprecate", "keep", "set_locked"))
    events = good.select(F.lower(F.coalesce("record.id", "id")).alias("id"), "seq", "kind", F.coalesce("record.content", "content").alias("content"), "value", F.lit(False).alias("off")).unionByName(
        R.read(base, now).select("id", F.lit(-1).cast("bigint").alias("seq"), F.lit("start").alias("kind"), F.lit(None).cast("string").alias("content"), F.col("locked").alias("value"), F.col("deprecated").alias("off"))
    )
    kind = F.col("kind")
    begins = kind.isin("start", "insert")
    one = running(
        events, ["id"], ["seq"], "seq",
        total={"begun": F.when(begins & (F.length(F.coalesce("content", F.lit(""))) <= max_chars), 1).otherwise(0)},
        last={"lock": F.when(kind.isin("start", "set_locked"), F.col("value"))}, slices=slices, keep_slices=True,
    )
    exists = (F.col("begun") > 0) & ~((F.col("kind") == "insert") & (F.col("begun") == 1))
    locked = F.coalesce("lock", F.lit(False))
    two = running(
        one.withColumn("exists", exists).withColumn("locked", locked), ["id"], ["seq"], "seq",
        last={"active": F.when(kind == "start", ~F.col("off")).when(F.col("exists") & (kind == "keep"), True).when(F.col("exists") & (kind == "deprecate") & ~F.col("locked"), False)},
        slices=slices,
    )
    too_long = F.length(F.coalesce("content", F.lit(""))) > max_chars
    outcome = (
        F.when(kind.isin("insert", "update") & too_long, "invalid")
        .when((kind == "insert") & F.col("exists"), "invalid")
        .when(kind == "insert", "ok")
        .when(~F.col("exists"), "not_found")
        .when(kind.isin("update", "deprecate") & F.col("locked"), "locked")
        .when((kind == "update") & ~F.coalesce("active", F.lit(True)), "invalid")
        .otherwise("ok")
    )
    return two.where("kind <> 'start'").select("seq", "kind", outcome.alias("outcome"))
