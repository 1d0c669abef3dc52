"""Text vectors. The encoder is any function of a batch of texts; the one here needs no model."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


def hashed(texts: Sequence[str], size: int = 64) -> np.ndarray:
    """Signed counts of hashed words, of length 1; the same in every process."""
    out = np.zeros((len(texts), size), np.float32)
    for row, t in enumerate(texts):
        for w in _WORD.findall((t or "").lower()):
            h = zlib.crc32(w.encode())
            out[row, h % size] += 1.0 if h & 0x40000000 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def embed(text: Column, encoder: Callable[[Sequence[str]], np.ndarray] = hashed) -> Column:
    """The vector of ``text``, encoded in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(encoder(s.fillna("").tolist())))

    return run(text)
