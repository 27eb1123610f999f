"""Nearest vectors by cosine, with threshold and metadata filter."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import embedding
from quire.sources import shared

#: Queries in a block, and numbers of a task's vectors that meet a block at once.
QUERY_BLOCK, GROUP_NUMBERS = 1024, 1 << 23


def cosine(a: Column, b: Column) -> Column:
    """In double, rounded to 6 places so that any order of summing gives the same. Null where a vector is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.round(dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0)), 6)


def where_metadata(df: DataFrame, key: str, value: str) -> DataFrame:
    """The filter ``key == 'value'`` on metadata, below the similarity in the plan."""
    return df.filter(F.col("metadata")[key] == value)


_PART = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>-?[0-9]+(?:\.[0-9]+)?)|(?P<sign>==|!=|<=|>=|<|>|&&|\|\||!|[()\[\],])|(?P<word>[A-Za-z_][A-Za-z0-9_.]*))""")
_SAID = {"==": "=", "!=": "!=", "&&": "AND", "||": "OR", "!": "NOT", "[": "(", "]": ")", "and": "AND", "or": "OR", "not": "NOT", "in": "IN", "nin": "NOT IN", "true": "'true'", "false": "'false'"}


def metadata_filter(expression: str, columns: dict[str, str] | None = None) -> Column:
    """A filter such as ``userId == 'x' && chunkIndex in ['0', '1'] || !(pages >= 3)`` as a condition on the map ``metadata``.

    Comparisons are of a key with a text, or as numbers with a number, which a value that is none fails. A missing key fails all of them, ``!=`` and
    ``nin`` too. columns: keys that have a column of their own, which files can be left out by."""
    parts, at = [], 0
    expression = expression.rstrip()
    while at < len(expression):
        m = _PART.match(expression, at)
        if m is None:
            raise ValueError(f"not understood: {expression[at:]!r}")
        parts.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    said = []
    for i, (kind, x) in enumerate(parts):
        if kind == "text":
            said.append("'" + re.sub(r"\\(.)", r"\1", x[1:-1], flags=re.DOTALL).replace("\\", "\\\\").replace("'", "\\'") + "'")
        elif kind == "word" and x.lower() not in _SAID:
            value = columns[x] if columns and x in columns else f"metadata['{x}']"
            numeric = next((k == "number" for k, _ in parts[i + 1 :] if k in ("text", "number")), False)
            said.append(f"try_cast({value} AS double)" if numeric else value)
        else:
            said.append(_SAID.get(x.lower(), x))
    return F.coalesce(F.expr(" ".join(said)), F.lit(False))


def top_k(vectors: DataFrame, query: DataFrame, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """The k rows most similar to the one row of ``query`` (query_id, embedding), of at least ``threshold``.

    The query is one row, so it is broadcast; the k rows are kept per task first. Ties go by id. Null and zero vectors are no hits.
    """
    q = F.broadcast(query.limit(1).select("query_id", F.col("embedding").alias("_q")))
    scored = vectors.join(q, F.lit(True)).withColumn("score", cosine(F.col("embedding"), F.col("_q"))).drop("_q")
    return scored.filter(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(k)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.5, block: int = QUERY_BLOCK) -> DataFrame:
    """Rows (query_id, id, score, rank): for every row of ``queries`` the k most similar of all rows of ``vectors``.

    Queries are written once to the shared folder, in files of about ``block`` rows. A task takes its vectors in groups of
    bounded size and for each group goes through the files: a matrix product, of which k per query stay. So vectors are
    scanned once, however many queries there are, nothing is collected, and a task holds one group and one block.
    Null and zero vectors, and those of another length than the queries', are no hits. Ties go by id.
    """
    spark = vectors.sparkSession
    own = queries.filter("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    path = shared.new_path(spark, "queries")
    blocks = max(1, -(-own.count() // block))
    own.repartition(blocks, F.xxhash64("query_id")).write.parquet(path)
    q_type, id_type = own.schema["query_id"].dataType, vectors.schema["id"].dataType
    found = vectors.filter("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        lambda batches: _nearest(batches, path, k, threshold), T.StructType([T.StructField("query_id", q_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k_text(vectors: DataFrame, texts: DataFrame, embed: embedding.Embedder = embedding.hashed, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """As ``top_k_batch`` for queries (query_id, text), which ``embed`` turns into vectors."""
    return top_k_batch(vectors, embedding.embedded(texts.select("query_id", "text"), "text", embed).drop("text"), k, threshold)


def _matrix(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, their places in the column) of those with ``dims`` numbers (the first's if None), none of them null, and not zero."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    if not len(n):
        return np.empty((0, dims or 0)), np.empty(0, np.int64)
    dims = int(n[0]) if dims is None else dims
    at = np.flatnonzero(n == dims)
    flat = (column if len(at) == len(n) else column.take(pa.array(at))).flatten()
    m = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(at), dims)
    norm = np.linalg.norm(m, axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    return m[ok] / norm[ok, None], at[ok]


def _nearest(batches: Iterator[pa.RecordBatch], path: str, k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    fs, base = shared.file_system(path)
    from pyarrow.fs import FileSelector

    files = sorted(x.path for x in fs.get_file_info(FileSelector(base)) if x.base_name.endswith(".parquet"))

    def scored(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(group).combine_chunks()
        ids, column = t.column("id").chunk(0), t.column("embedding").chunk(0)
        by_dims: dict[int, tuple] = {}
        for file in files:
            with fs.open_input_file(file) as f:
                for q in pq.ParquetFile(f).iter_batches(QUERY_BLOCK):
                    if not q.num_rows:
                        continue
                    for dims in set(q.column("embedding").value_lengths().to_pylist()):
                        qs, of = _matrix(q.column("embedding"), dims)
                        if dims not in by_dims:
                            v, at = _matrix(column, dims)
                            order = np.argsort(np.argsort(ids.take(pa.array(at)).to_numpy(zero_copy_only=False), kind="stable"))  # ties go by id
                            by_dims[dims] = v, at, order
                        v, at, order = by_dims[dims]
                        if not len(qs) or not len(v):
                            continue
                        rows, cols, scores = [], [], []
                        for lo in range(0, len(qs), 64):
                            s = np.round(qs[lo : lo + 64] @ v.T, 6)
                            for j, line in enumerate(s, lo):
                                ok = np.flatnonzero(line >= threshold)
                                if len(ok) > k:
                                    least = np.partition(line[ok], len(ok) - k)[len(ok) - k]
                                    ok = ok[line[ok] >= least]
                                    ok = ok[np.lexsort((order[ok], -line[ok]))[:k]]
                                rows.append(np.full(len(ok), of[j]))
                                cols.append(at[ok])
                                scores.append(line[ok])
                        rows, cols = np.concatenate(rows), np.concatenate(cols)
                        yield pa.RecordBatch.from_arrays([q.column("query_id").take(pa.array(rows)), ids.take(pa.array(cols)), pa.array(np.concatenate(scores))], names=["query_id", "id", "score"])

    held, numbers = [], 0
    for b in batches:
        while b.num_rows:
            each = max(1, len(b.column("embedding").flatten()) // b.num_rows)
            take = max(1, min(b.num_rows, (GROUP_NUMBERS - numbers) // each))
            held.append(b.slice(0, take))
            numbers += take * each
            b = b.slice(take)
            if numbers + each > GROUP_NUMBERS:
                yield from scored(held)
                held, numbers = [], 0
    if held:
        yield from scored(held)
