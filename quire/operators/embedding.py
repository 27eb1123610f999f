"""Text to vectors. The model is a function to be passed in; the default hashes words.

An ``Embedder`` takes a list of texts and gives a matrix with a row for each, on the executors, batch by batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.chunking import slices

Embedder = Callable[[list[str]], np.ndarray]
DIMENSIONS = 64
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(1 << 18)
def _place(word: str) -> int:
    return hashlib.md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[0] % DIMENSIONS


def hashed(texts: list[str]) -> np.ndarray:
    """A deterministic stand-in for a model: how many words (between spaces and line feeds, A-Z in lower case) fall to each of
    64 places by the first byte of their MD5. A text without words has the zero vector."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, t in zip(out, texts):
        words = [w for w in t.translate(_LOWER).replace("\n", " ").split(" ") if w]
        if words:
            row += np.bincount([_place(w) for w in words], minlength=DIMENSIONS)
    return out


def embedded(df: DataFrame, text: str, embed: Embedder = hashed, out: str = "embedding") -> DataFrame:
    """``df`` with the vector of ``text`` in ``out``; a null text is an empty one. A column named ``out`` is replaced."""
    cols = [c for c in df.columns if c != out]
    schema = T.StructType([*df.select(*cols).schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    n, own = len(cols), "_text"
    while own.lower() in map(str.lower, cols):
        own += "_"

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, n)):
            m = np.ascontiguousarray(embed([t or "" for t in b.column(n).to_pylist()]), np.float32).reshape(b.num_rows, -1)
            at = pa.array(np.arange(0, m.size + 1, max(m.shape[1], 1), dtype=np.int32)[: b.num_rows + 1], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.ListArray.from_arrays(at, pa.array(m.ravel()))], names=[*cols, out])

    return df.select(*cols, F.col(text).alias(own)).mapInArrow(vectors, schema)
