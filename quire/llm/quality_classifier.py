"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A text is three streams of words: its words in lower case, their shapes (runs of letters, digits and
marks), and for each word whether its three-word window came up before. The n-grams of each stream are
hashed to 2 ** BITS features, valued by the logarithm of their count, to unit length. The score is
the logistic function of a sparse dot product.

The fit takes at most ``max_train`` labelled documents, with ``max_bytes`` of features, those first by a hash of their id; scoring
covers every whole text. The weights, of fixed size, go to the executors.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import shared

BITS = 18
#: The bounds of the sample that is fitted: documents, and bytes of their features.
MAX_TRAIN, MAX_BYTES = 8_000, 1 << 28
_MIX, _SEEDS = np.uint64(0x9E3779B97F4A7C15), [np.uint64(x) for x in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_REPEATED, _NEW = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
_SHAPES = ((re.compile(r"[A-Z]+"), "A"), (re.compile(r"[0-9]+"), "9"), (re.compile(r"[^\WA-Z0-9_]+"), "a"), (re.compile(r"(\W)\1+"), r"\1"))
_known: dict[bytes, int] = {}
_hashes: list[tuple[int, int]] = []


def shape(word: str) -> str:
    """Letters as A or a, digits as 9, runs as one; lower-case words look alike."""
    for pattern, to in _SHAPES:
        word = pattern.sub(to, word)
    return word


def _ids(words: list[bytes]) -> np.ndarray:
    """(word hash, shape hash) of each word; hashes are kept between texts."""
    if len(_known) > 400_000:
        _known.clear()
        _hashes.clear()
    for w in words:
        if w not in _known:
            _known[w] = len(_hashes)
            _hashes.append((xxhash.xxh3_64_intdigest(w.lower()), xxhash.xxh3_64_intdigest(shape(w.decode("utf-8", "replace")))))
    at = [_known[w] for w in words]
    return np.array([_hashes[i] for i in at], np.uint64) if len(at) < 64 else np.array(_hashes, np.uint64)[at] if len(_hashes) < 4 * len(at) else np.array([_hashes[i] for i in at], np.uint64)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values) of a whole text; none for an empty one."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    h = _ids(words)
    w, s = h[:, 0], h[:, 1]
    with np.errstate(over="ignore"):
        parts = [w * _SEEDS[0], s * _SEEDS[1]]
        if len(words) > 1:
            parts += [(w[:-1] * _MIX + w[1:]) * _SEEDS[2], (s[:-1] * _MIX + s[1:]) * _SEEDS[3]]
        if len(words) > 2:
            tri = (w[:-2] * _MIX + w[1:-1]) * _MIX + w[2:]
            new = np.zeros(len(tri), bool)
            new[np.unique(tri, return_index=True)[1]] = True
            parts.append(np.where(new, _NEW, _REPEATED) * _SEEDS[4])
        g = np.concatenate(parts)
        g ^= g >> np.uint64(29)
        g = g * _MIX
    idx, n = np.unique(g >> np.uint64(64 - BITS), return_counts=True)
    v = np.log1p(n).astype(np.float32)
    return idx.astype(np.int32), v / np.sqrt((v * v).sum())


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        idx, v = features(text)
        z = float(self.weights[idx] @ v) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """Per-coordinate FTRL-proximal over the rows in their order. Without rows every score is 0.5."""
    size = (1 << BITS) + 1  # the last is the bias
    z, n = np.zeros(size), np.zeros(size)
    one = np.array([size - 1], np.int32)
    rows = [(np.concatenate([i, one]), np.append(v, np.float32(1)).astype(np.float64), y) for i, v, y in rows]

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i, v, y in rows:
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y) * v
            g2 = g * g
            z[i] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g2
    w = weights(z, n)
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def fold(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, held_out: int = 2, key: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_bytes: int = MAX_BYTES) -> Model:
    """Fits on labelled rows outside the fold ``held_out``. Labels without an id or a value are left out; of
    several for one id the greatest counts, of several texts the least by a hash of its features. Of the sample, first by a hash of their id, as many
    documents are taken as have features of ``max_bytes`` together. Without any, all score 0.5. A document's features are at most 2 ** BITS, however long it is."""
    own = labels.filter(F.col(key).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(key)) != held_out)).groupBy(F.col(key).alias("_k")).agg(F.max(F.col(label_col)).cast("int").alias("_y"))
    chosen = own.orderBy(F.xxhash64(F.lit(11), "_k"), "_k").limit(max_train)  # the bound of the sample

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t.as_py()) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_y"), pa.array([i.tobytes() for i, _ in f], pa.binary()), pa.array([v.tobytes() for _, v in f], pa.binary())], names=["_k", "_y", "i", "v"])

    d = docs.select(F.col(key).alias("_k"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_k").select("_k", "_y", "_text")
    found = shared.written(d.mapInArrow(sparse, f"_k {docs.schema[key].dataType.simpleString()}, _y int, i binary, v binary"), "features")
    once = found.groupBy("_k").agg(F.min(F.struct(F.xxhash64("i", "v").alias("h"), "_y", "i", "v")).alias("r")).select("_k", "r._y", "r.i", "r.v", F.xxhash64(F.lit(11), "_k").alias("at"))
    # a hash and a length of each document of the sample first, then the features of those that fit
    sizes = sorted((r["at"], r["n"]) for r in once.select("at", (F.octet_length("i") + F.octet_length("v")).alias("n")).collect())
    upto = list(accumulate(n for _, n in sizes))
    fit = bisect_right(upto, max_bytes)
    rows = once.filter(F.col("at") <= sizes[fit - 1][0]).select("_k", "_y", "i", "v").collect() if fit else []
    rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r["_k"])), r["i"]))
    return ftrl([(np.frombuffer(r["i"], np.int32), np.frombuffer(r["v"], np.float32), r["_y"]) for r in rows])


def score(docs: DataFrame, model: Model, threshold: float = 0.7, held_out: int = 2, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. A null text is scored as an empty one."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(t.as_py()) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_h"), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=[key, "held_out", "score", "predicted"])

    d = docs.select(F.col(key).alias("_k"), (fold(F.col(key)) == held_out).alias("_h"), F.col(text_col).alias("_text"))
    return d.mapInArrow(scored, f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int")


def report(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = 0.7) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, by a model fitted on ``labels``. A null text scores as an empty one, a very
    long one whole, equal texts alike; a null id is in some fold; without labels all score 0.5; other columns are not looked at."""
    return score(docs, train(docs, labels, max_train), threshold)
