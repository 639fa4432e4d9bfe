"""Times are unix seconds in bigint; these functions read and write their text forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RFC3339 = r"\A(\d{4})-(\d{2})-(\d{2})[Tt](\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(?:[Zz]|([+-])(\d{2}):(\d{2}))\z"
DURATION = r"\AP(?:(\d{1,12})W|(?:(\d{1,12})D)?(?:T(?=\d)(?:(\d{1,12})H)?(?:(\d{1,12})M)?(?:(\d{1,12})S)?)?)\z"


def parse_rfc3339(c: Column) -> Column:
    """Seconds, or null where the text is no valid time; a 60th second counts on, fractions are dropped."""
    part = lambda k: F.regexp_extract(c, RFC3339, k)
    number = lambda k: F.coalesce(F.expr("try_cast(null as bigint)"), F.nullif(part(k), F.lit("")).cast("bigint"))
    day = F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd")
    shift = F.coalesce(number(8), F.lit(0)) * 3600 + F.coalesce(number(9), F.lit(0)) * 60
    ok = c.rlike(RFC3339) & (number(4) <= 23) & (number(5) <= 59) & (number(6) <= 60) & (F.coalesce(number(8), F.lit(0)) <= 23) & (F.coalesce(number(9), F.lit(0)) <= 59)
    seconds = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + number(4) * 3600 + number(5) * 60 + number(6)
    return F.when(ok & day.isNotNull(), seconds - F.when(part(7) == "-", -shift).otherwise(shift))


def format_rfc3339(c: Column) -> Column:
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_duration(c: Column) -> Column:
    """Seconds of weeks, or of days, hours, minutes and seconds; null for anything else."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(c, DURATION, k), F.lit("")).cast("bigint"), F.lit(0))
    return F.when(c.rlike(DURATION) & (F.length(c) > 2), part(1) * 604800 + part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5))
