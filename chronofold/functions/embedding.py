"""Embeddings: a deterministic hashed one, any other as a pluggable batch function, and a self-check."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSION = 128
_WORDS = re.compile("[a-z0-9]+|[一-鿿]+")


def _tokens(text: str) -> list[str]:
    out = []
    for run in _WORDS.findall((text or "").lower()):
        if run[0] < "一":
            out.append(run)
        else:
            out += [*run, *map("".join, zip(run, run[1:], strict=False))]
    return out


def hashed(text: str | None, dimension: int = DIMENSION) -> list[float]:
    """Signed token hashing: SHA-256 picks place and sign, longer words weigh more, length one."""
    v = np.zeros(dimension)
    for token in _tokens(text or ""):
        d = hashlib.sha256(token.encode()).digest()
        v[int.from_bytes(d[:4], "big") % dimension] += (1 - 2 * (d[4] % 2)) * (1 + len(token) / 10)
    norm = math.sqrt(float(v @ v))
    return (v / norm if norm else v).tolist()


def embed(df: DataFrame, text: str, out: str = "embedding", batch: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Adds a vector column; ``batch`` embeds a list of texts (made once per worker), default the hashed one."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        rows = texts.fillna("").tolist()
        return pd.Series(batch(rows) if batch else [hashed(t) for t in rows])

    return df.withColumn(out, run(F.col(text)))


def self_check(batch: Callable[[list[str]], list[list[float]]], alike: tuple[str, str], unlike: tuple[str, str], least_gap: float = 0.05) -> bool:
    """A usable model puts a similar pair clearly nearer than a dissimilar one."""
    a, b, c, d = (np.asarray(v, float) for v in batch([*alike, *unlike]))
    near = lambda x, y: float(x @ y) / (float(np.linalg.norm(x) * np.linalg.norm(y)) or 1.0)
    return near(a, b) - near(c, d) > least_gap
