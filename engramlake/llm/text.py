"""Text forms the operators of this subpackage share."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: A word is a longest run of letters or digits.
WORD = re.compile(r"[^\W_]+")
#: Of ASCII: letters small, blanks for what is in no word.
_APART = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def folded(c: Column) -> Column:
    """Without regard to case; ß and SS are one."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def letters(c: Column) -> Column:
    """Only the letters and digits, case folded."""
    return F.regexp_replace(folded(c), r"[^\p{L}\p{N}]+", "")


def tag_set(c: Column) -> Column:
    """The set of tags as one string; null and tags without letters or digits count as none."""
    clean = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), letters), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(clean)), " ")


def words(text: str) -> list[str]:
    """The words of a text, folded as above."""
    if text.isascii():  # the same, faster
        return text.encode().translate(_APART).decode().split()
    return WORD.findall(text.lower().replace("ß", "ss"))
