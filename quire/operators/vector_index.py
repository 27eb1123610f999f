"""An index of vectors: inverted lists with product-quantised codes, for nearest vectors by cosine.

Unit vectors are dealt to the cells of trained centroids, and what a vector is off its centroid is written as one byte for each of a few subspaces; what
that leaves, as one byte a number, which only a search without ``probes`` reads. The codes, and the vectors themselves, are tables partitioned by cell. A search
reads codes, which are a small part of the vectors' bytes, and then only the cells of vectors that it has to compare exactly.

Each code comes with the error that its finer bytes leave, so that a vector's similarity is known to lie between two bounds, which are close enough to leave few
vectors open, and each cell with the widest angle to its centroid. ``search`` without ``probes`` leaves out only what these bounds exclude: its hits are those of ``search.top_k_batch``. With ``probes`` a query looks
at that many cells and compares the ``keep`` best by code exactly; ``tuned`` finds how many are needed for a recall, measured against
brute force over the training sample.

The model is fitted to at most ``MAX_TRAIN`` vectors or ``MAX_BYTES``, the first by a hash of their id; every vector is indexed. Null and zero vectors, and those with
a null, are no hits; vectors of another length than most are kept apart and compared exactly. Ties go by id. Ids that repeat are hits each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import search
from quire.sources import shared
from quire.sources.tables import MAX_IDS

#: Vectors, and their bytes, that the model is fitted to at most; cells at most.
MAX_TRAIN, MAX_BYTES, MAX_CELLS = 16_384, 64 << 20, 4096
#: Bounds are widened by this, for scores are rounded to six places.
SLACK = 2e-6
#: Numbers of a task's vectors that meet a block of queries at once.
GROUP_NUMBERS = 1 << 21


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, unit: bool = False, rounds: int = 12) -> np.ndarray:
    """k centres of the rows; of equal length if ``unit``. An empty centre takes a row."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = _closest(x, c)
        n = np.bincount(of, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        total[n == 0] = x[rng.integers(0, len(x), int((n == 0).sum()))]
        c = total / np.maximum(n, 1)[:, None]
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


class Model:
    """centroids: unit vectors of the cells; books: for each subspace up to 256 centres of what is left."""

    def __init__(self, centroids: np.ndarray, books: list[np.ndarray], widest: np.ndarray | None = None):
        self.centroids, self.books, self.widest = centroids, books, widest
        self.dims = centroids.shape[1]
        ends = np.cumsum([0] + [b.shape[1] for b in books])
        self.parts = list(zip(ends[:-1].tolist(), ends[1:].tolist()))

    @classmethod
    def fitted(cls, x: np.ndarray, cells: int, bytes_: int, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        centroids = _kmeans(x, min(cells, len(x)), rng, unit=True)
        left = x - centroids[_closest(x, centroids)]
        books = [_kmeans(left[:, cols], min(256, len(x)), rng) for cols in np.array_split(np.arange(x.shape[1]), min(bytes_, x.shape[1]))]
        return cls(centroids, books)

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes, errors of the codes, and angles to the centroids of unit vectors."""
        cell = _closest(x, self.centroids)
        left = x - self.centroids[cell]
        codes = np.stack([_closest(left[:, p:q], b) for (p, q), b in zip(self.parts, self.books)], 1).astype(np.uint8)
        error = np.linalg.norm(x - self.decoded(cell, codes), axis=1)
        return cell, codes, error, np.arccos(np.clip((x * self.centroids[cell]).sum(1), -1, 1))

    def decoded(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centroids[cell] + np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], 1)

    def finer(self, x: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the codes leave of unit vectors, as a byte a number and what one step of it is; and the errors of both."""
        left = x - self.decoded(cell, codes)
        step = np.maximum(np.abs(left).max(1, initial=0.0), 1e-12) / 127
        fine = np.rint(left / step[:, None]).astype(np.int8)
        return fine, step, np.linalg.norm(left - fine * step[:, None], axis=1)

    def most(self, q: np.ndarray) -> np.ndarray:
        """The greatest similarity that each query can have in each cell."""
        angle = np.arccos(np.clip(q @ self.centroids.T, -1, 1))
        return np.where(self.widest < 0, -2.0, np.cos(np.maximum(0.0, angle - self.widest)))


def _arrays(rows: dict[str, np.ndarray]) -> list[tuple]:
    return [(name, list(a.shape), a.astype(np.float64).tobytes()) for name, a in rows.items()]


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        found = {r["name"]: np.frombuffer(r["data"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/model").collect()}  # one row for each array of the model
        self.model = Model(found["centroids"], [found[f"book{j}"] for j in range(sum(n.startswith("book") for n in found))], found["widest"])
        self.sample, self.total = found["sample"], int(found["total"][0])

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, cells: int | None = None, bytes_: int = 16) -> VectorIndex:
        """Indexes ``vectors`` (id, embedding). cells: about the root of their number if None; bytes_: of each code."""
        spark = vectors.sparkSession
        path = path or shared.new_path(spark, "vector-index")
        v = vectors.filter("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        sizes = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        dims, total = (sizes[0]["n"], sizes[0]["count"]) if sizes else (1, 0)
        most = max(1, min(MAX_TRAIN, MAX_BYTES // (8 * max(dims, 1))))
        sample = v.filter(F.size("embedding") == dims).orderBy(F.xxhash64("id"), "id").limit(most).select("embedding").toArrow()
        x, _ = search._matrix(sample.column("embedding").combine_chunks()) if sample.num_rows else (np.empty((0, dims)), None)
        if not len(x):
            x = np.eye(1, dims)
        model = Model.fitted(x, cells or max(1, min(MAX_CELLS, round(total**0.5))), bytes_)
        id_type = v.schema["id"].dataType
        schema = T.StructType([T.StructField("id", id_type), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("fine", T.BinaryType()), T.StructField("step", T.DoubleType()), T.StructField("error", T.DoubleType()), T.StructField("angle", T.DoubleType())])

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                column = b.column("embedding")
                x, at = search._matrix(column, dims)
                cell, codes, _, angle = model.encoded(x)
                fine, step, error = model.finer(x, cell, codes)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column("id").take(rows), column.take(rows), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([c.tobytes() for c in fine], pa.binary()), pa.array(step), pa.array(error), pa.array(angle)], names=schema.names)

        made = shared.written(v.filter(F.size("embedding") == dims).mapInArrow(assigned, schema), "assigned")
        dealt = made.hint("rebalance", "cell")  # a cell that holds much is split
        dealt.select("id", "code", "fine", "step", "error", "cell").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{path}/codes")
        dealt.select("id", "embedding", "cell").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{path}/vectors")
        v.filter(F.size("embedding") != dims).write.parquet(f"{path}/others")
        widest = np.full(len(model.centroids), -1.0)
        for r in made.groupBy("cell").agg(F.max("angle").alias("a")).collect():  # a row for each cell
            widest[r["cell"]] = r["a"]
        arrays = {"centroids": model.centroids, "widest": widest, "sample": x[:2048], "total": np.array([max(total, 1)])} | {f"book{j}": b for j, b in enumerate(model.books)}
        spark.createDataFrame(_arrays(arrays), "name string, shape array<int>, data binary").coalesce(1).write.parquet(f"{path}/model")
        shared.drop(made)
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int = 5, threshold: float = 0.5, probes: int | None = None, keep: int = 64) -> DataFrame:
        """Rows (query_id, id, score, rank), as ``search.top_k_batch``; exactly its rows unless ``probes`` are given."""
        q = queries.filter("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        q = shared.written(q, "index-queries")
        codes = self.spark.read.parquet(f"{self.path}/codes") if len(self.model.widest[self.model.widest >= 0]) else None
        if codes is None:
            return search.top_k_batch(self.spark.read.parquet(f"{self.path}/others"), q, k, threshold)
        fields = [T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("id", codes.schema["id"].dataType), T.StructField("cell", T.IntegerType()), T.StructField("least", T.DoubleType()), T.StructField("most", T.DoubleType())]
        model, path = self.model, q._quire_path
        wanted = self._cells(q, threshold, probes)
        codes = codes.select("id", "cell", "code", *(("fine", "step", "error") if probes is None else ()))
        found = codes.filter(F.col("cell").isin(wanted)).mapInArrow(lambda batches: _bounded(batches, model, path, k, threshold, probes, keep), T.StructType(fields))
        found = shared.written(found, "index-bounds")
        by_query = Window.partitionBy("query_id")
        if probes is None:  # what can't be among the k best goes
            ranked = found.withColumn("r", F.row_number().over(by_query.orderBy(F.desc("least")))).filter(F.col("r") <= k)
            kth = ranked.groupBy("query_id").agg(F.min(F.when(F.col("r") == k, F.col("least"))).alias("kth"))
            found = found.join(kth, "query_id").filter(F.col("kth").isNull() | (F.col("most") >= F.col("kth") - SLACK))
        else:
            found = found.withColumn("r", F.row_number().over(by_query.orderBy(F.desc("most"), "id"))).filter(F.col("r") <= keep)
        left = shared.written(found.select("query_id", "id", "cell").distinct(), "index-candidates")
        n = left.count()
        cells = [r["cell"] for r in left.select("cell").distinct().collect()]  # at most as many as the model has
        exact = self.spark.read.parquet(f"{self.path}/vectors").filter(F.col("cell").isin(cells))
        hits = exact.join(F.broadcast(left) if n <= MAX_IDS else left, ["cell", "id"]).join(q.withColumnRenamed("embedding", "_q"), "query_id")
        hits = hits.select("query_id", "id", search.cosine(F.col("embedding"), F.col("_q")).alias("score")).filter(F.col("score") >= threshold)
        others = search.top_k_batch(self.spark.read.parquet(f"{self.path}/others"), q, k, threshold).drop("rank")
        rank = F.row_number().over(by_query.orderBy(F.desc("score"), "id"))
        return hits.unionByName(others).withColumn("rank", rank).filter(F.col("rank") <= k)

    def _cells(self, q: DataFrame, threshold: float, probes: int | None) -> list[int]:
        """The cells that any query looks at: found where the queries are, by their numbers."""
        model = self.model

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(len(model.centroids), bool)
            for b in batches:
                x, _ = search._matrix(b.column("embedding"), model.dims)
                seen |= _looked_at(model, x, threshold, probes).any(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int32())], names=["cell"])

        return [r["cell"] for r in q.mapInArrow(cells, "cell int").distinct().collect()]

    def tuned(self, recall: float = 0.9, k: int = 5, n_queries: int = 200) -> tuple[int, int]:
        """(probes, keep), the least powers of two with which that share of the k nearest is found, by the training sample searched for its
        first vectors. A sample's hits are fewer by codes than those of all vectors, so of ``keep`` only its share is taken there."""
        x, q = self.sample, self.sample[:n_queries]
        cell, codes, _, _ = self.model.encoded(x)
        by_code = q @ self.model.decoded(cell, codes).T
        best = np.argsort(-(q @ x.T), 1)[:, :k]
        place = np.argsort(np.argsort(-(q @ self.model.centroids.T), 1), 1)[:, cell]  # which probe of a query opens a vector's cell
        cells = len(self.model.centroids)
        keep = 4 * k
        while True:
            share = max(k, round(keep * len(x) / self.total))
            probes = 1
            while True:
                kept = np.argsort(-np.where(place < probes, by_code, -2), 1)[:, :share]
                if np.mean([np.isin(b, c).mean() for b, c in zip(best, kept)]) >= recall:
                    return probes, keep
                if probes >= cells:
                    break
                probes = min(2 * probes, cells)
            if share >= len(x):
                return cells, self.total
            keep *= 2


def _looked_at(model: Model, q: np.ndarray, threshold: float, probes: int | None) -> np.ndarray:
    if probes is None:
        return model.most(q) >= threshold - SLACK
    out = np.zeros((len(q), len(model.centroids)), bool)
    np.put_along_axis(out, np.argsort(-(q @ model.centroids.T), 1)[:, :probes], True, 1)
    return out & (model.widest >= 0)


def _bounded(batches: Iterator[pa.RecordBatch], model: Model, path: str, k: int, threshold: float, probes: int | None, keep: int) -> Iterator[pa.RecordBatch]:
    """Rows (query_id, id, cell, least, most) of the vectors of a task that may be hits: bounds of their similarity, or twice the
    similarity by code if probed. A task holds one group of codes and one block of queries."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    fs, base = shared.file_system(path)
    files = sorted(x.path for x in fs.get_file_info(FileSelector(base)) if x.base_name.endswith(".parquet"))
    bytes_of = lambda t, name, kind: np.frombuffer(b"".join(t.column(name).to_pylist()), kind).reshape(t.num_rows, -1)

    def bounded(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(group).combine_chunks()
        ids, cell_of = t.column("id").chunk(0), t.column("cell").chunk(0)
        cells = cell_of.to_numpy(zero_copy_only=False)
        x, error = model.decoded(cells, bytes_of(t, "code", np.uint8)), 0.0
        if probes is None:
            x += bytes_of(t, "fine", np.int8) * t.column("step").to_numpy()[:, None]
            error = t.column("error").to_numpy() + SLACK
        for file in files:
            with fs.open_input_file(file) as f:
                for block in pq.ParquetFile(f).iter_batches(search.QUERY_BLOCK):
                    q, of = search._matrix(block.column("embedding"), model.dims)
                    if not len(q):
                        continue
                    rows, cols, least, most = [], [], [], []
                    for lo in range(0, len(q), 64):
                        part = q[lo : lo + 64]
                        open_ = _looked_at(model, part, threshold, probes)[:, cells]
                        score = part @ x.T
                        for i in range(len(part)):
                            low, high = (score[i] - error, score[i] + error) if probes is None else (score[i], score[i])
                            n = k if probes is None else keep
                            ok = open_[i] & (high >= threshold) if probes is None else open_[i]
                            at = np.flatnonzero(ok)
                            if len(at) > n:
                                at = at[high[at] >= np.partition(low[at], len(at) - n)[len(at) - n]]
                            rows.append(np.full(len(at), of[lo + i]))
                            cols.append(at)
                            least.append(low[at])
                            most.append(high[at])
                    at = pa.array(np.concatenate(cols))
                    yield pa.RecordBatch.from_arrays([block.column("query_id").take(pa.array(np.concatenate(rows))), ids.take(at), cell_of.take(at), pa.array(np.concatenate(least)), pa.array(np.concatenate(most))], names=["query_id", "id", "cell", "least", "most"])

    held, rows = [], 0
    most_rows = max(1, GROUP_NUMBERS // max(model.dims, 1))
    for b in batches:
        while b.num_rows:
            held.append(b.slice(0, most_rows - rows))
            rows += held[-1].num_rows
            b = b.slice(held[-1].num_rows)
            if rows >= most_rows:
                yield from bounded(held)
                held, rows = [], 0
    if held:
        yield from bounded(held)
