"""Calls of a model as a stage: grouped by size, some at a time, tried again, failing row by row, remembered by content.

A model is a function from a list of texts to a list of texts, on the executors. It may be slow and may fail.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import chunking
from quire.sources.store import Log

Model = Callable[[list[str]], list[str | None]]
CACHE = "key string, reply string"


def groups(texts: list[str], most_tokens: int) -> Iterator[list[int]]:
    """Numbers of texts that go into one call: up to ``most_tokens``, and one text at least."""
    own, size = [], 0
    for i, t in enumerate(texts):
        n = chunking.tokens(t)
        if own and size + n > most_tokens:
            yield own
            own, size = [], 0
        own.append(i)
        size += n
    if own:
        yield own


def _replies(model: Model, texts: list[str], tries: int, wait: float) -> list[tuple[str | None, str | None]]:
    """(reply, error) of each text. A group that fails is called again after ``wait`` seconds, then twice that, and at last text by text."""
    error = ""
    for n in range(tries):
        if n:
            time.sleep(wait * 2 ** (n - 1))
        try:
            got = list(model(texts))
            if len(got) == len(texts):
                return [(r, None) for r in got]
            error = f"{len(got)} replies to {len(texts)} texts"
        except Exception as e:  # a model's failure is a row's, not the job's
            error = f"{type(e).__name__}: {e}"
    if len(texts) == 1:
        return [(None, error)]
    return [r for t in texts for r in _replies(model, [t], 1, wait)]


def called(df: DataFrame, text: str, model: Model, out: str = "reply", most_tokens: int = 8000, at_once: int = 4, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """``df`` with ``out`` and ``error``: the model's reply to each row's ``text``, or why there is none. A null text has neither.

    A task makes ``at_once`` calls at a time, each of texts of ``most_tokens`` by estimate. Columns of these names are replaced."""
    cols = [c for c in df.columns if c not in (out, "error")]
    asked = cols.index(text)

    def replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                texts = b.column(asked).to_pylist()
                there = [i for i, t in enumerate(texts) if t is not None]
                parts = [[there[i] for i in g] for g in groups([texts[i] for i in there], most_tokens)]
                got: list[tuple] = [(None, None)] * len(texts)
                for part, rows in zip(parts, pool.map(lambda p: _replies(model, [texts[i] for i in p], tries, wait), parts)):
                    for i, r in zip(part, rows):
                        got[i] = r
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=[*cols, out, "error"])

    d = df.select(*cols)
    return d.mapInArrow(replies, T.StructType([*d.schema.fields, T.StructField(out, T.StringType()), T.StructField("error", T.StringType())]))


def remembered(df: DataFrame, text: str, model: Model, cache: Log, out: str = "reply", **how) -> DataFrame:
    """As ``called``, but each text is asked once: replies are kept in ``cache`` (a log of ``CACHE``) by the text's hash. What failed is asked again
    the next time."""
    key = F.sha2(text, 256)
    new = df.filter(F.col(text).isNotNull()).select(key.alias("key"), F.col(text).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    new = new.join(cache.rows().select("key"), "key", "left_anti")
    cache.insert(called(new, "text", model, "reply", **how).filter("reply IS NOT NULL").select("key", "reply"))
    known = cache.rows().groupBy("key").agg(F.first("reply").alias(out))
    kept = df.select(*[c for c in df.columns if c != out], key.alias("_key"))
    return kept.join(known.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
