"""Embeddings kept beside the records, keyed by id and hash of the content."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from engramlake.functions import vectors
from engramlake.functions.hashing import fnv1a64
from engramlake.runtime import cut


def embedder(model: Callable[[list[str]], list] | None = None, prefix: str = "") -> Callable[[Column], Column]:
    """A column function from an ordinary callable on a list of texts; without one, hashed bags of words."""
    if model is None:
        return lambda c: vectors.bow_vector(F.concat(F.lit(prefix), c))

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in model([prefix + (t or "") for t in texts])])

    return lambda c: vectors.normalized(embed(c))


def embed(records: DataFrame, model: Callable | None = None, prefix: str = "") -> DataFrame:
    """id, content_hash, vec of active records."""
    return records.where("not deprecated").select("id", fnv1a64(F.col("content")).alias("content_hash"), embedder(model, prefix)(F.col("content")).alias("vec"))


def fresh(cache: DataFrame, records: DataFrame) -> DataFrame:
    """Cached vectors of active records whose content is still the one embedded."""
    live = records.where("not deprecated").select("id", fnv1a64(F.col("content")).alias("content_hash"))
    return cache.join(live, ["id", "content_hash"], "left_semi")


def stale(cache: DataFrame, records: DataFrame) -> DataFrame:
    """Active records without a fresh vector: id, content_hash."""
    live = records.where("not deprecated").select("id", fnv1a64(F.col("content")).alias("content_hash"))
    return live.join(cache.select("id", "content_hash"), ["id", "content_hash"], "left_anti")


def refreshed(cache: DataFrame, records: DataFrame, model: Callable | None = None, prefix: str = "") -> DataFrame:
    """The cache after maintenance: fresh vectors kept, only stale records embedded (one job looks which is which)."""
    live = records.where("not deprecated").select("id", "content", fnv1a64(F.col("content")).alias("content_hash"))
    met = cut(live.join(cache.select("id", "content_hash", "vec"), ["id", "content_hash"], "left"))
    made = met.where("vec is null").select("id", "content_hash", embedder(model, prefix)(F.col("content")).alias("vec"))
    return met.where("vec is not null").select("id", "content_hash", "vec").unionByName(made)


def put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """rows replace cached rows of the same id."""
    return cache.join(rows.select("id"), "id", "left_anti").unionByName(rows)


def remove(cache: DataFrame, ids: DataFrame) -> DataFrame:
    return cache.join(ids.select("id"), "id", "left_anti")
