"""Hashes, encodings and identifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Offset basis and prime of 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a64_many(values: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings at once: one vector step for each byte position."""
    order = sorted(range(len(values)), key=lambda k: -len(values[k]))
    h = np.full(len(values), FNV_OFFSET, np.uint64)
    if values:
        lens = np.array([len(values[k]) for k in order])
        joined = np.frombuffer(b"".join(values[k] for k in order), np.uint8)
        first = np.concatenate([[0], np.cumsum(lens)[:-1]])
        alive = len(values)
        for at in range(int(lens[0])):
            while alive and lens[alive - 1] <= at:
                alive -= 1
            h[:alive] = (h[:alive] ^ joined[first[:alive] + at]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


@F.pandas_udf(T.LongType())
def _fnv(texts: pd.Series) -> pd.Series:
    return pd.Series(fnv1a64_many([(t or "").encode() for t in texts]).view(np.int64))


def fnv1a64(c: Column) -> Column:
    """Of the UTF-8 bytes, null counting as empty, as decimal(20,0)."""
    h = _fnv(c).cast("decimal(20,0)")
    return F.when(h < 0, h + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(h).cast("decimal(20,0)")


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def base64_encode(c: Column) -> Column:
    """One line, however long."""
    return F.regexp_replace(F.base64(c.cast("binary")), "[\r\n]", "")


def base64_decode(c: Column) -> Column:
    """Strict: null unless the text is exactly what encoding its value gives."""
    raw = F.try_to_binary(c, F.lit("base64"))
    return F.when(base64_encode(raw) == c, raw)


def uuid_to_bytes(c: Column) -> Column:
    return F.unhex(F.replace(F.lower(c), F.lit("-"), F.lit("")))


def bytes_to_uuid(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(c)), r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5")
