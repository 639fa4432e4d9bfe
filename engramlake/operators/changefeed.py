"""Applying a stream of inserts, updates and deletes with equality-delete files.

The journal is written as two append-only sets: data rows (key, sequence, op) and
equality deletes (key, sequence). A delete removes the rows of its key with a lower
sequence; readers anti-join rows against later delete keys. A sequence is the pair
(at in seconds, seq), so the order of delivery does not matter.

* an effective insert appends a data row; an effective update appends a delete and a
  data row; a deprecation that still stands after the journal appends a delete with a
  sequence above every row;
* whether an op takes effect depends on the ops before it. A key may own a large share
  of all ops, so its ops are split by time into ``slices`` ranges with about the same number of
  ops each; a slice is sorted alone, and what one slice leaves to the next is one row.
* both sets are written to the shared folder, each to files of its own, and read from there.

Defined results: ops with null ``at``, unknown kind, no id or no payload (insert
without record or its content, update without content) have no effect; an op repeated
in all but ``seq`` and the case of ``id`` counts once, with its smallest seq; milliseconds
(above 10^11) become seconds; ids come out in lower case; of base rows that repeat an
id one counts, active before deprecated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from engramlake.operators.running import sliced
from engramlake.runtime import cut

MILLIS_ABOVE = 100_000_000_000
FIRST, LAST = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class ChangeFiles:
    """data: id, at, seq (null: the base's content). deletes: id, at, seq."""

    data: DataFrame
    deletes: DataFrame


def seconds(at: Column) -> Column:
    return F.when(at > MILLIS_ABOVE, F.expr("at div 1000")).otherwise(at)


def valid_ops(ops: DataFrame) -> DataFrame:
    """The ops that can touch content or status: id, kind, at_s, seq, raw at, digest of the payload."""
    payload = F.to_json(F.struct("record", "content", "reason", "value", "ids", "project"))
    key = F.lower(F.when(F.col("kind") == "insert", F.col("record.id")).otherwise(F.col("id")))
    has_payload = (
        F.when(F.col("kind") == "insert", F.col("record.content").isNotNull())
        .when(F.col("kind") == "update", F.col("content").isNotNull())
        .otherwise(F.lit(True))
    )
    return ops.where(F.col("kind").isin("insert", "update", "deprecate", "keep") & F.col("at").isNotNull() & has_payload).select(
        key.alias("id"), "kind", seconds(F.col("at")).alias("at_s"), "at", "seq",
        F.xxhash64(payload).alias("digest"), F.hash(payload).alias("digest2"),
        F.coalesce(F.col("record.deprecated"), F.lit(False)).alias("starts_deprecated"),
    ).where("id is not null and id <> ''")


def change_files(base: DataFrame, ops: DataFrame, slices: int | None = None) -> ChangeFiles:
    """Writes the journal as data rows and equality deletes (one job for the slices, one for the files)."""
    valid = sliced(valid_ops(ops), "at_s", slices, "slice")
    # A key exists from its base row, else from its first insert; later inserts do nothing.
    base_rows = base.where("id is not null and id <> ''").select(
        F.lower("id").alias("id"), F.lit(FIRST).alias("at_s"), F.lit(FIRST).alias("seq"), F.coalesce("deprecated", F.lit(False)).alias("off"), F.lit(-1).alias("slice")
    )
    inserts = valid.where("kind = 'insert'").select("id", "at_s", "seq", F.col("starts_deprecated").alias("off"), "slice")
    starts = (
        base_rows.unionByName(inserts)
        .groupBy("id")
        .agg(F.min(F.struct("at_s", "seq", "off", "slice")).alias("s"))
        .select("id", F.lit("start").alias("kind"), "s.at_s", F.col("s.at_s").alias("at"), "s.seq", F.lit(0).cast("bigint").alias("digest"), F.lit(0).alias("digest2"), F.col("s.off").alias("starts_deprecated"), "s.slice")
    )
    per_slice = ["id", "slice"]
    events = (
        valid.where("kind <> 'insert'")
        .unionByName(starts)
        .repartition(*per_slice)
        .groupBy(*per_slice, "kind", "at_s", "at", "digest", "digest2", "starts_deprecated")
        .agg(F.min("seq").alias("seq"))
    )
    so_far = W.partitionBy(*per_slice).orderBy("at_s", "seq").rowsBetween(W.unboundedPreceding, 0)
    status = F.when(F.col("kind") == "start", ~F.col("starts_deprecated")).when(F.col("kind") == "keep", True).when(F.col("kind") == "deprecate", False)
    events = events.select("id", "slice", "kind", "at_s", "seq", status.alias("status")).select(
        "*", F.last("status", ignorenulls=True).over(so_far).alias("status_here"), F.max(F.col("kind") == "start").over(so_far).alias("started_here")
    )
    slice_ends = events.groupBy(*per_slice).agg(
        F.max("started_here").alias("started"), F.max_by("status", F.when(F.col("status").isNotNull(), F.struct("at_s", "seq"))).alias("status_end")
    )
    earlier = W.partitionBy("id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        slice_ends.withColumn("existed", F.coalesce(F.max("started").over(earlier), F.lit(False)))
        .withColumn("status_end", F.when(F.col("existed") | F.col("started"), F.col("status_end")))
        .withColumn("was_active", F.last("status_end", ignorenulls=True).over(earlier))
    )
    active = F.when(F.col("started_here"), F.col("status_here")).when(F.col("existed"), F.coalesce("status_here", "was_active")).otherwise(False)
    effective = (
        events.where("kind in ('start', 'update')")
        .join(carried.select(*per_slice, "existed", "was_active"), per_slice)
        .where((F.col("kind") == "start") | active)
        # of one slice only the newest row can outlive the slice's own deletes
        .groupBy(*per_slice)
        .agg(F.max(F.struct("at_s", "seq", "kind")).alias("e"))
        .select("id", "e.at_s", "e.seq", "e.kind")
    )
    standing = carried.groupBy("id").agg(F.max_by("status_end", F.when(F.col("status_end").isNotNull(), F.col("slice"))).alias("up")).where("not up")
    row = lambda file, seq: F.struct(F.lit(file).alias("file"), "id", "at_s", seq.alias("seq"))
    appended = effective.select(
        F.explode(F.array_compact(F.array(row("data", F.when(F.col("at_s") != FIRST, F.col("seq"))), F.when(F.col("kind") == "update", row("delete", F.col("seq")))))).alias("r")
    ).select("r.*")
    files = cut(appended.unionByName(standing.select(F.lit("delete").alias("file"), "id", F.lit(LAST).alias("at_s"), F.lit(LAST).alias("seq"))), partition_by=["file"])
    return ChangeFiles(files.where("file = 'data'").drop("file"), files.where("file = 'delete'").drop("file"))


def read_live(files: ChangeFiles) -> DataFrame:
    """Rows of the data files that no later delete key removes: id, at_s, seq."""
    newest = files.deletes.groupBy("id").agg(F.max(F.struct("at_s", "seq")).alias("gone"))
    sequence = F.struct("d.at_s", F.coalesce("d.seq", F.lit(FIRST)).alias("seq"))
    return files.data.alias("d").join(newest.alias("x"), (F.col("d.id") == F.col("x.id")) & (F.col("x.gone") > sequence), "left_anti")


def current_state(base: DataFrame, ops: DataFrame, slices: int | None = None) -> DataFrame:
    """Live records after the journal: id, content, updated_at, seq (null where the base's content stands)."""
    live = read_live(change_files(base, ops, slices))
    texts = ops.where("kind in ('insert', 'update')").select("seq", F.coalesce("content", "record.content").alias("content"))
    old = base.groupBy(F.lower("id").alias("id")).agg(F.min(F.struct(F.coalesce("deprecated", F.lit(False)), "content", "updated_at")).alias("b"))
    changed = live.where("seq is not null").join(texts, "seq").select("id", "content", F.col("at_s").alias("updated_at"), "seq")
    kept = live.where("seq is null").join(old, "id").select("id", "b.content", "b.updated_at", "seq")
    return changed.unionByName(kept)


def found(base: DataFrame, ops: DataFrame, slices: int | None = None) -> DataFrame:
    """id, seq of each live record whose content came from an op."""
    return read_live(change_files(base, ops, slices)).where("seq is not null").select("id", "seq")
