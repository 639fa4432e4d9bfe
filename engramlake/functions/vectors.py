"""Vectors as array<float>, and the hashed bag-of-words embedder used where no model is given."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from engramlake.functions.hashing import fnv1a64_many

BOW_DIM = 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Unit length in float; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float"))


def bow(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed words (ASCII case folded, split at ASCII white space), unit length."""
    words = [[w for w in (t or "").translate(_FOLD).split(" ") if w] for t in texts]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(texts), BOW_DIM))
    if lens.sum():
        coded = pa.array([w for ws in words for w in ws], pa.string()).dictionary_encode()
        slot = (fnv1a64_many([w.encode()[:127] for w in coded.dictionary.to_pylist()]) % np.uint64(BOW_DIM)).astype(np.int64)
        cells = np.repeat(np.arange(len(texts)), lens) * BOW_DIM + slot[coded.indices.to_numpy()]
        out = np.bincount(cells, minlength=out.size).reshape(out.shape).astype(float)
    n = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, n, out=out, where=n > 0).astype(np.float32)


_FOLD = {ord(c): " " for c in "\t\n\r\x0b\x0c"} | {c: c + 32 for c in range(65, 91)}


@F.pandas_udf(T.ArrayType(T.FloatType()))
def bow_vector(texts: pd.Series) -> pd.Series:
    return pd.Series(list(bow(list(texts))))
