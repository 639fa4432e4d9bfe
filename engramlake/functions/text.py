"""Text functions as Column expressions; nothing here leaves the JVM but esc_decode."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The characters that count as white space, and the shape of a project slug.
SPACE = " \t\n\r\u000b\f"
SLUG = r"\A[a-z0-9][a-z0-9-]{0,63}\z"
UUID = r"\A[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\z"


def str_trim(c: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(c, F.lit(SPACE))


def str_blank(c: Column) -> Column:
    """Null, empty or only ASCII white space."""
    return F.coalesce(str_trim(c) == "", F.lit(True))


def utf8_count(c: Column) -> Column:
    """Code points of valid UTF-8, null for anything else."""
    return F.when(F.is_valid_utf8(c), F.char_length(c).cast("bigint"))


def slug_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(SLUG), F.lit(False))


def uuid_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID), F.lit(False))


def token_heuristic(c: Column) -> Column:
    """0 for nothing, else a token for every four bytes, at least one."""
    n = F.octet_length(c)
    return F.when(c.isNull() | (n == 0), F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("bigint")


def fold_controls(c: Column) -> Column:
    """Each control character or Unicode line break becomes one space."""
    return F.regexp_replace(c, "[\\x00-\\x1F\\x7F\\x{85}\\x{2028}\\x{2029}]", " ")


def data_line(content: Column) -> Column:
    return F.concat(F.lit("- "), fold_controls(content))


def esc_encode(c: Column) -> Column:
    """Backslash, line feed, carriage return and tab escaped, if there is a backslash at all."""
    out = c
    for raw, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.when(F.contains(c, F.lit("\\")), out).otherwise(c)


_ESCAPE = re.compile(r'\\(?:u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(["\\/nrtbf]))')
_SIMPLE = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", '"': '"', "\\": "\\", "/": "/"}


def decode_escapes(text: str) -> str:
    """Escapes resolved; malformed ones (and lone surrogates, and NUL) stay as written."""

    def one(m: re.Match) -> str:
        high, low, unit, simple = m.groups()
        if simple:
            return _SIMPLE[simple]
        if high:
            return chr(0x10000 + ((int(high, 16) - 0xD800) << 10) + int(low, 16) - 0xDC00)
        code = int(unit, 16)
        return m.group() if 0xD800 <= code <= 0xDFFF or code == 0 else chr(code)

    return _ESCAPE.sub(one, text)


@F.pandas_udf(T.StringType())
def _decode(texts: pd.Series) -> pd.Series:
    return texts.map(decode_escapes, na_action="ignore")


def esc_decode(c: Column) -> Column:
    """Only values with a backslash go to Python; those with a raw control character stay as they are."""
    return F.when(F.contains(c, F.lit("\\")) & ~c.rlike(r"[\x00-\x1F]"), _decode(c)).otherwise(c)


def label(section: Column, project: Column) -> Column:
    """(identity), (context) or (project:slug)."""
    return F.concat(F.lit("("), F.when(section == "project", F.concat(F.lit("project:"), F.coalesce(project, F.lit("")))).otherwise(section), F.lit(")"))


def log_line(level: Column, module: Column, message: Column) -> Column:
    """Level and module padded to columns; line breaks in the message become spaces."""
    return F.concat_ws(" ", F.rpad(F.upper(level), 5, " "), F.rpad(module, 8, " "), F.translate(message, "\n\r", "  "))
