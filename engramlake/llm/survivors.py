"""Best representative of each duplicate group, field by field.

The fields of all members become long rows (group, field, value); each row votes for its
normalised value with source trust times recency decay; votes are summed per value, winners
chosen with max_by and pivoted back to one row a group. All steps aggregate before they
shuffle, so a group of any size costs a few rows per task.

A field may put an order of preference before the votes: the query p4_found prefers the
latest, highest or most trusted value, and votes decide only between equal preferences.

Defined results: invalid values (out of range, unknown source, null, NaN) do not vote; a
field without a valid value has no winner; ties go to the greater value, then the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from engramlake.llm.copies import copy_members

EXPORT_AT = 1_785_319_920
MAX_COUNT = 4_294_967_295
FIELDS = ("updated_at", "relevance", "source", "access_count")
#: Trust in a source, also its order of preference.
TRUST = {"seed": 1.0, "manual": 0.8, "curator": 0.6}
OTHER_TRUST = 0.3
HALF_LIFE_DAYS = 90.0


def members_of_groups(records: DataFrame) -> DataFrame:
    """Records that have copies, with group_id; kept ids belong to their own group."""
    pairs = copy_members(records)
    of_group = pairs.select(F.explode(F.array(F.struct(F.col("kept_id").alias("g"), F.col("kept_id").alias("id")), F.struct(F.col("kept_id").alias("g"), "id"))).alias("m"))
    return of_group.select(F.col("m.g").alias("group_id"), F.col("m.id").alias("id")).distinct().join(
        records.select("id", "created_at", *FIELDS), "id"
    )


def _trust():
    out = F
    for name, t in TRUST.items():
        out = out.when(F.col("source") == name, t)
    return out.otherwise(OTHER_TRUST)


def long_rows(members: DataFrame, now: int = EXPORT_AT) -> DataFrame:
    """group_id, id, field, value (text), number (for order), weight; valid values only."""
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.coalesce("updated_at", F.lit(0))) / 86400.0)
    weight = _trust() * F.pow(F.lit(0.5), age / HALF_LIFE_DAYS)
    number = lambda c: F.col(c).cast("double")
    checked = {
        "updated_at": (F.col("updated_at").between(F.col("created_at"), F.lit(now)), number("updated_at")),
        "relevance": (F.col("relevance").between(0.0, 1.0) & ~F.isnan("relevance"), number("relevance")),
        "source": (F.col("source").isin(*TRUST), _trust()),
        "access_count": (F.col("access_count").between(0, MAX_COUNT), number("access_count")),
    }
    cells = F.array(*(F.struct(F.lit(f).alias("field"), ok.alias("ok"), F.col(f).cast("string").alias("value"), n.alias("number")) for f, (ok, n) in checked.items()))
    return members.select("group_id", "id", weight.alias("weight"), F.explode(cells).alias("c")).where("c.ok").select(
        "group_id", "id", "c.field", "c.value", "c.number", "weight"
    )


def winners(long: DataFrame, prefer: bool) -> DataFrame:
    """group_id, field, value, id, votes: the winning value and the smallest id that has it."""
    by_value = long.groupBy("group_id", "field", "number", "value").agg(F.round(F.sum("weight"), 9).alias("votes"), F.min("id").alias("id"))
    order = F.struct("number", "votes", "value") if prefer else F.struct("votes", "number", "value")
    return by_value.groupBy("group_id", "field").agg(F.max_by(F.struct("value", "id", "votes"), order).alias("w")).select("group_id", "field", "w.*")


def survivors(records: DataFrame, prefer: bool = False, now: int = EXPORT_AT) -> DataFrame:
    """One row a group: group_id and the winning value of each field (typed as in records)."""
    won = winners(long_rows(members_of_groups(records), now), prefer)
    types = dict(records.dtypes)
    return won.groupBy("group_id").agg(
        *(F.max(F.when(F.col("field") == f, F.col("value"))).cast(types[f]).alias(f) for f in FIELDS),
        F.round(F.sum("votes"), 6).alias("votes"),
    )


def found(records: DataFrame) -> DataFrame:
    return winners(long_rows(members_of_groups(records)), prefer=True).select("group_id", "field", "id")
