"""A hashing embedder of character n-grams, as an Arrow UDF over distinct texts."""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DIMENSIONS, GRAMS = 256, (3, 4, 5)


@lru_cache(100_000)
def cell(gram: str) -> int:
    """Three hex digits of the gram's MD5: two say which dimension, an odd third one that it counts down.

    SQL can do the same, so that results can be held against another engine.
    """
    return int(md5(gram.encode()).hexdigest()[:3], 16)


def grams(text: str | None) -> list[str]:
    padded = f" {text.strip().lower()} " if text and text.strip() else ""
    return [padded[i : i + n] for n in GRAMS for i in range(len(padded) - n + 1)]


def word_list(text: str | None) -> list[str]:
    return [w for w in (text or "").strip().lower().split(" ") if w]


def embed_text(text: str | None) -> np.ndarray:
    """Unit vector of the padded lower-case text's grams, counted up or down by cell(); 0 for blanks."""
    return _unit(grams(text))


def embed_words(text: str | None) -> np.ndarray:
    """The same of the words between blanks: texts are alike if they have whole words in common."""
    return _unit(word_list(text))


def _unit(grams: list[str]) -> np.ndarray:
    cells = np.array([cell(g) for g in grams], np.int64)
    v = np.bincount(cells >> 4, weights=np.where(cells & 1, -1.0, 1.0), minlength=DIMENSIONS)
    return v / max(float(np.sqrt(v @ v)), 1e-300)


def counts(texts: list[str], words: bool = False) -> np.ndarray:
    """What embed_text(), or embed_words(), counts before it is made a unit vector: whole numbers, a row for each text."""
    rows, cells = [], []
    for i, t in enumerate(texts):
        at = len(cells)
        cells += [cell(g) for g in (word_list(t) if words else grams(t))]
        rows += [i] * (len(cells) - at)
    c = np.array(cells, np.int64)
    flat = np.bincount(np.array(rows, np.int64) * DIMENSIONS + (c >> 4), weights=np.where(c & 1, -1.0, 1.0), minlength=len(texts) * DIMENSIONS)
    return flat.reshape(len(texts), DIMENSIONS).astype(np.float32)


def embed(texts: list[str | None]) -> np.ndarray:
    return np.stack([embed_text(t) for t in texts]) if len(texts) else np.zeros((0, DIMENSIONS))


@F.pandas_udf(ArrayType(DoubleType()))
def embedding(s: pd.Series) -> pd.Series:
    return s.map(embed_text)


@F.pandas_udf(ArrayType(DoubleType()))
def word_embedding(s: pd.Series) -> pd.Series:
    return s.map(embed_words)


def dot(a, b):
    """Dot product of two array columns, JVM-side."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
