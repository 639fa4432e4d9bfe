"""Running values along a key's rows, where one key may own a large share of all rows.

A plain window sends all rows of a key to one task. Here rows are dealt to ranges of the order column
(slices with about as many rows each, so that no slice of a key is large), each slice runs alone, and
what earlier slices leave behind is joined on: one row for each key and slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from engramlake.runtime import cut, shuffle_partitions


def sliced(rows: DataFrame, by: str, slices: int | None = None, name: str = "_slice") -> DataFrame:
    """rows with the number of their slice of column by; equal values share a slice, nulls are in the first.

    The rows go through one range exchange and are written once to the shared folder, as ranges may be drawn
    otherwise when computed again; so pass only the columns that are needed.
    """
    n = slices or max(16, 2 * shuffle_partitions(rows.sparkSession))
    return cut(rows.repartitionByRange(n, by).withColumn(name, F.spark_partition_id()))


def running(rows: DataFrame, keys: list[str], order: list[str], slice_by: str, last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, previous: dict[str, Column] | None = None, slices: int | None = None, keep_slices: bool = False) -> DataFrame:
    """rows with, for each name: the last non-null value so far (last), the sum so far (total), both with the
    row itself, or the value of the row before (previous). slice_by is the first of the order columns.

    rows are written once to the shared folder (see sliced). With keep_slices the result has column _slice, and
    a further call on it uses the same slices.
    """
    last, total, previous = last or {}, total or {}, previous or {}
    part = [*keys, "_slice"]
    data = cut(rows) if "_slice" in rows.columns else sliced(rows, slice_by, slices)
    names = [c for c in rows.columns if c != "_slice"] + ["_slice"] * keep_slices
    for k, c in (last | total | previous).items():
        data = data.withColumn(f"_{k}", c)
    here = W.partitionBy(*part).orderBy(*order)
    upto = here.rowsBetween(W.unboundedPreceding, 0)
    inside = data.select(
        "*",
        *(F.last(f"_{k}", ignorenulls=True).over(upto).alias(f"{k}_in") for k in last),
        *(F.sum(f"_{k}").over(upto).alias(f"{k}_in") for k in total),
        *(F.lag(f"_{k}").over(here).alias(f"{k}_in") for k in previous),
        F.row_number().over(here).alias("_rn"),
    )
    place = F.struct(*order)
    ends = data.groupBy(*part).agg(
        F.max(place).alias("_end"),
        *(F.max_by(f"_{k}", F.when(F.col(f"_{k}").isNotNull(), place)).alias(f"{k}_end") for k in last),
        *(F.sum(f"_{k}").alias(f"{k}_end") for k in total),
        *(F.max_by(F.struct(f"_{k}"), place).alias(f"{k}_end") for k in previous),
    )
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        *part,
        *(F.last(f"{k}_end", ignorenulls=True).over(earlier).alias(f"{k}_before") for k in last),
        *(F.sum(f"{k}_end").over(earlier).alias(f"{k}_before") for k in total),
        *(F.last(f"{k}_end").over(earlier).getField(f"_{k}").alias(f"{k}_before") for k in previous),
    )
    out = inside.join(carried, part, "left")
    results = (
        [F.coalesce(f"{k}_in", f"{k}_before").alias(k) for k in last]
        + [F.coalesce(F.coalesce(f"{k}_in", F.lit(0)) + F.coalesce(f"{k}_before", F.lit(0)), F.lit(0)).alias(k) for k in total]
        + [F.when(F.col("_rn") == 1, F.col(f"{k}_before")).otherwise(F.col(f"{k}_in")).alias(k) for k in previous]
    )
    return out.select(*names, *results)


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 1, in an order over all rows.

    Ranges of the order columns go to the tasks; each numbers its own rows from where the ranges before it end.
    rows are written once to the shared folder, as ranges may be drawn otherwise when computed again.
    """
    ranges = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order)
    ranges = cut(ranges.withColumn("_range", F.spark_partition_id()))
    ends = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = ends.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row a range
    here = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_rn", here).join(F.broadcast(starts), "_range").select(*rows.columns, (F.col("_start") + F.col("_rn")).cast("bigint").alias(name))
