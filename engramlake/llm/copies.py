"""Duplicates hidden by formatting differences, by external sort and a scan of adjacent runs.

Canonical records (letters and digits of content, set of tags) are range-partitioned and
sorted by (key, id), so a key with very many copies simply spans several partitions. Each
partition is scanned once in Arrow batches, comparing full neighbouring keys. The first and
last run of every partition, at most two rows a partition, are then joined up across
partitions.

Defined results: null content equals nothing, not even another null; a content without
letters or digits equals others like it; null tags are no tags; of rows that repeat an id
each counts as a copy, though an id is never listed as its own copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from engramlake.llm.text import letters, tag_set
from engramlake.runtime import cut, shuffle_partitions

_RUNS = "part int, run bigint, id string, rep string, copies bigint, key string"


def canonical(records: DataFrame, id_col: str = "id", content_col: str = "content", tags_col: str | None = "tags") -> DataFrame:
    """id and key: the full canonical record, content first."""
    tags = tag_set(F.col(tags_col)) if tags_col else F.lit("")
    return records.select(F.col(id_col).cast("string").alias("id"), F.concat(letters(F.col(content_col)), F.lit("\n"), tags).alias("key"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Member rows (id, rep) and, when a run ends, its row (rep, copies); the outer runs keep their key."""
    from pyspark import TaskContext

    part, run, first = TaskContext.get().partitionId(), 0, True
    key = rep = None
    count = 0

    def out(ids, reps, copies, keys, runs) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, np.int32)), pa.array(runs, pa.int64()), pa.array(ids, pa.string()), pa.array(reps, pa.string()), pa.array(copies, pa.int64()), pa.array(keys, pa.string())],
            names=["part", "run", "id", "rep", "copies", "key"],
        )

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        keys, ids = b.column(0), b.column(1)
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
        new[0] = first or key is None or keys[0].as_py() != key
        at = np.flatnonzero(new)
        m_ids, m_reps, m_runs = [], [], []
        e_reps, e_copies, e_keys, e_runs = [], [], [], []
        stop = int(at[0]) if len(at) else n
        count += stop
        if stop:  # these rows go on with the run of the batch before
            m_ids += ids.slice(0, stop).to_pylist()
            m_reps += [rep] * stop
            m_runs += [run] * stop
        for k, a in enumerate(at.tolist()):
            if not first:
                e_reps.append(rep), e_copies.append(count), e_keys.append(key if run == 0 else None), e_runs.append(run)
                run += 1
            z = int(at[k + 1]) if k + 1 < len(at) else n
            first, rep, count = False, ids[a].as_py(), z - a
            if z - a > 1:
                m_ids += ids.slice(a + 1, z - a - 1).to_pylist()
                m_reps += [rep] * (z - a - 1)
                m_runs += [run] * (z - a - 1)
            if run == 0 or k + 1 == len(at):
                key = keys[a].as_py()
        if m_ids:
            yield out(m_ids, m_reps, [None] * len(m_ids), [None] * len(m_ids), m_runs)
        if e_reps:
            yield out([None] * len(e_reps), e_reps, e_copies, e_keys, e_runs)
    if not first:
        yield out([None], [rep], [count], [key], [run])


def runs(keyed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Scanned rows with their final representative: id (null in a run's own row), rep, copies, own (the run's first id)."""
    n = partitions or shuffle_partitions(keyed.sparkSession)
    scanned = cut(keyed.select("key", "id").repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id").mapInArrow(_scan, _RUNS))
    in_order = W.orderBy("part", "run")  # at most two rows a partition
    outer = (
        scanned.where("key is not null")
        .select("part", "run", "rep", F.coalesce(F.col("key") != F.lag("key").over(in_order), F.lit(True)).cast("int").alias("new"))
        .withColumn("chain", F.sum("new").over(in_order))
        .select("part", "run", F.first("rep").over(W.partitionBy("chain").orderBy("part", "run")).alias("joined"))
    )
    return scanned.join(F.broadcast(outer), ["part", "run"], "left").select(
        "id", F.coalesce("joined", "rep").alias("rep"), F.col("rep").alias("own"), "copies"
    )


def copy_groups(records: DataFrame, id_col: str = "id", content_col: str = "content", tags_col: str | None = "tags", partitions: int | None = None) -> DataFrame:
    """kept_id, copies: one row for each distinct canonical record."""
    found = runs(canonical(records, id_col, content_col, tags_col), partitions)
    return found.where("copies is not null").groupBy(F.col("rep").alias("kept_id")).agg(F.sum("copies").alias("copies"))


def copy_members(records: DataFrame, id_col: str = "id", content_col: str = "content", tags_col: str | None = "tags", partitions: int | None = None) -> DataFrame:
    """kept_id, id: every copy but the kept one."""
    found = runs(canonical(records, id_col, content_col, tags_col), partitions)
    return (
        found.select(F.col("rep").alias("kept_id"), F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("own")).alias("id"))
        .where("id <> kept_id")
        .distinct()
    )
