"""The knowledge base's written tables: chunk rows, vectors and the status of each document.

A load draws a number that no other load gets, writes its tables under names of its own, and adds them to the store by one commit to the manifest
(see ``manifest``). So a load that fails half-way shows nothing, loads and streams at the same time lose nothing of each other, and a
reader sees the store as of one commit. Of several loads of a document the one with the last number counts, once it has ended, so
that re-processing replaces its chunks and vectors at once, and until then the old ones stay; a micro-batch that is run again is found in the manifest and left out.

Each document's outcome keeps the sums of its chunks, so statistics need no text. The status log is folded to the last rows of each
document every ``FOLD`` commits; ``compact`` rewrites chunks and vectors to what is current.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import chunking
from quire.functions import text as X
from quire.operators import embedding
from quire.sources import shared, tables
from quire.sources.manifest import Manifest

SUMS = "chunk_count int, n_tokens long, n_chars long"
STATUS = f"document_id long, load long, step int, status string, {SUMS}, error_message string"
CHUNKS = "document_id long, chunk_index int, chunk_title string, chunk_text string, token_count int, char_count int, batch int, user_id string, file_name string"
VECTORS = "id string, document_id long, user_id string, content string, metadata map<string,string>, embedding array<float>"
STEPS = ("PENDING", "PROCESSING", "COMPLETED", "FAILED", "DELETED")
#: Metadata that vectors have as columns too; their files say by Bloom filters which values they hold.
COLUMNS = {"documentId": "document_id", "userId": "user_id"}
BLOOM = {f"parquet.bloom.filter.enabled#{c}": "true" for c in COLUMNS.values()} | {f"parquet.bloom.filter.expected.ndv#{c}": "100000" for c in COLUMNS.values()}
#: Tables of the status log that a reader takes at most, about.
FOLD = 16


def current(log: DataFrame) -> DataFrame:
    """The last row of each document in a status log."""
    last = F.max_by(F.struct(*[c for c in log.columns if c != "document_id"]), F.struct("load", "step"))
    return log.groupBy("document_id").agg(last.alias("s")).select("document_id", "s.*")


class Store:
    def __init__(self, spark: SparkSession, path: str | None = None, embed: embedding.Embedder = embedding.hashed):
        self.spark, self.embed = spark, embed
        self.path = path or shared.new_path(spark, "store")
        # load: the last number drawn; status, data: names of tables; batches: the last micro-batch of each stream
        self.manifest = Manifest(spark, f"{self.path}/manifest", {"load": 0, "status": [], "data": [], "batches": {}})

    def _name(self, load: int) -> str:
        return f"{load}-{uuid.uuid4().hex}"

    def _draw(self) -> int:
        def next_load(state):
            state["load"] += 1
            return state["load"]

        return self.manifest.commit(next_load)

    def _written_status(self, rows: DataFrame, load: int, status: str | None = None) -> str:
        """Writes rows of the status log (document_id, and status if it isn't the same for all); the table's name."""
        name = self._name(load)
        have = rows.withColumn("load", F.lit(load))
        if status:
            have = have.withColumn("status", F.lit(status))
        have = have.withColumn("step", F.array_position(F.array(*map(F.lit, STEPS)), F.col("status")) - 1)
        cols = [c.split(" ") for c in STATUS.split(", ")]
        have.select(*[(F.col(n) if n in have.columns else F.lit(None)).cast(k).alias(n) for n, k in cols]).write.parquet(f"{self.path}/status/{name}")
        return name

    def _add(self, status: list[str], data: str | None = None, batch: tuple[str, int] | None = None) -> bool:
        """Adds tables to the store at once, unless the micro-batch they are of has been added."""

        def change(state):
            if batch and state["batches"].get(batch[0], -1) >= batch[1]:
                return False
            if batch:
                state["batches"][batch[0]] = batch[1]
            state["status"] += status
            state["data"] += [data] if data else []
            return True

        added = self.manifest.commit(change)
        self._fold()
        return added

    def _fold(self) -> None:
        """The status log in one table, if it has many: without what later rows of the same documents replace."""
        names = self.manifest.last()[1]["status"]
        if len(names) <= FOLD:
            return
        one = self._name(0)
        log = self._log(names)
        begun = F.col("step") < STEPS.index("COMPLETED")  # a document that is being processed keeps its last outcome too
        current(log.filter(begun)).unionByName(current(log.filter(~begun))).select(*[c.split(" ")[0] for c in STATUS.split(", ")]).write.parquet(f"{self.path}/status/{one}")

        def change(state):
            if set(names) <= set(state["status"]):  # else another writer has folded them
                state["status"] = [one, *(n for n in state["status"] if n not in set(names))]

        self.manifest.commit(change)

    def _log(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], STATUS)
        return self.spark.read.schema(STATUS).parquet(*[f"{self.path}/status/{n}" for n in names])

    def log(self) -> DataFrame:
        """The statuses that documents had, of older ones the last."""
        return self._log(self.manifest.last()[1]["status"])

    def status(self) -> DataFrame:
        """(document_id, load, status, chunk_count, error_message), the last of each document that isn't deleted."""
        return current(self.log()).filter("status != 'DELETED'").select("document_id", "load", "status", "chunk_count", "error_message")

    def stats(self) -> DataFrame:
        """(document_id, total_chunks, total_tokens, total_chars) of each document that isn't deleted, from the outcomes of loads alone."""
        done = F.col("status") == "COMPLETED"
        sums = {"total_chunks": "chunk_count", "total_tokens": "n_tokens", "total_chars": "n_chars"}
        s = current(self.log()).filter("status != 'DELETED'")
        return s.select("document_id", *[F.when(done, F.col(c)).otherwise(0).cast("long").alias(n) for n, c in sums.items()])

    def register(self, docs: DataFrame, key: str = "id") -> None:
        """Documents that wait for their load."""
        self._add([self._written_status(docs.select(F.col(key).alias("document_id"), F.lit(0).alias("chunk_count")).distinct(), self._draw(), "PENDING")])

    def begin(self, docs: DataFrame, key: str = "id") -> int:
        """Documents whose processing begins; the load's number."""
        load = self._draw()
        self._add([self._written_status(docs.select(F.col(key).alias("document_id"), F.lit(0).alias("chunk_count")).distinct(), load, "PROCESSING")])
        return load

    def load(self, docs: DataFrame, failed: DataFrame | None = None, batch: tuple[str, int] | None = None, unique: bool = False) -> int | None:
        """Cleans, chunks, embeds and writes catalog rows (id, user_id, file_name, text); gives the load's number.

        Each text is read and chunked once. A row whose document repeats in ``docs`` counts once; unique: none does. A null or blank text, or one too
        short, makes a FAILED document, not a failed job. failed: (document_id, error_message) of documents that could not be had at all.
        batch: (stream, number) of a micro-batch; if it has been loaded before, nothing is done.
        """
        if batch and self.manifest.last()[1]["batches"].get(batch[0], -1) >= batch[1]:
            return None
        repeated = not unique and docs.groupBy("id").count().filter("count > 1").limit(1).count()
        once = docs.groupBy("id").agg(F.max(F.struct("user_id", "file_name", "text")).alias("d")).select("id", "d.*") if repeated else docs
        load = self.begin(once)
        d = once.select(F.col("id").alias("document_id"), "user_id", "file_name", X.blank(F.col("text")).alias("blank"), X.reconstruct(F.col("text")).alias("clean"))
        rows = chunking.chunk_rows(d, carried=("user_id", "file_name", "blank"), outcome=True)
        name = self._name(load)
        rows.withColumn("batch", F.expr(f"cast(chunk_index div {tables.CHUNK_BATCH} as int)")).withColumn("load", F.lit(load).cast("long")).write.parquet(f"{self.path}/rows/{name}")
        own = self.spark.read.schema(f"{CHUNKS}, load long, blank boolean, n_units int, n_chunks int, n_tokens long, n_chars long").parquet(f"{self.path}/rows/{name}")
        self._vectors(own.filter("chunk_index IS NOT NULL")).write.options(**BLOOM).parquet(f"{self.path}/vectors/{name}")
        error = tables.error_of(F.col("blank"), F.col("n_units"), F.col("n_chunks"))
        outcome = own.filter("chunk_index IS NULL").select("document_id", F.when(error.isNull(), "COMPLETED").otherwise("FAILED").alias("status"), F.col("n_chunks").alias("chunk_count"), "n_tokens", "n_chars", error.alias("error_message"))
        status = [self._written_status(outcome, load)]
        if failed is not None:
            status.append(self._written_status(failed.withColumn("chunk_count", F.lit(0)), load, "FAILED"))
        return load if self._add(status, name, batch) else None

    def delete(self, ids: DataFrame) -> None:
        """Documents (document_id) whose chunks and vectors go."""
        self._add([self._written_status(ids.select("document_id").distinct(), self._draw(), "DELETED")])

    def _vectors(self, chunks: DataFrame) -> DataFrame:
        m = tables.metadata(F.col("document_id"), F.col("user_id"), F.col("file_name"), F.col("chunk_index"), F.col("chunk_title"), F.col("chunk_text"))
        own = chunks.select(F.concat_ws("-", "document_id", "chunk_index").alias("id"), "document_id", "user_id", "load", F.col("chunk_text").alias("content"), m.alias("metadata"))
        return embedding.embedded(own, "content", self.embed)

    def _read(self, kind: str, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{n}" for n in names])

    def _current(self, kind: str, schema: str, state: dict) -> DataFrame:
        """The rows of loads that count. What later loads and deletes have replaced is known by ids, and is usually little."""
        names = state["data"]
        outcomes = self._log(state["status"]).filter(F.col("step") >= STEPS.index("COMPLETED"))
        done = current(outcomes).filter("status = 'COMPLETED'").select("document_id", "load")
        had = self._read("rows", names, "document_id long, load long, chunk_index int").filter("chunk_index IS NULL").select("document_id", "load")
        dead = shared.written(had.join(done, ["document_id", "load"], "left_anti"), "dead")
        n = dead.count()
        rows = self._read(kind, names, schema)
        return rows.join(F.broadcast(dead) if n <= tables.MAX_IDS else dead, ["document_id", "load"], "left_anti") if n else rows

    def chunks(self) -> DataFrame:
        """The chunk rows of all documents that are loaded."""
        return self._current("rows", f"{CHUNKS}, load long", self.manifest.last()[1]).filter("chunk_index IS NOT NULL").drop("load")

    def vectors(self) -> DataFrame:
        """(id, document_id, user_id, content, metadata, embedding) of all documents that are loaded."""
        return self._current("vectors", f"{VECTORS}, load long", self.manifest.last()[1]).drop("load")

    def compact(self) -> Store:
        """Rewrites the tables of all loads so far as one, with only what is current. Loads that are added meanwhile stay beside it."""
        _, state = self.manifest.last()
        if len(state["data"]) < 2:
            return self
        one = self._name(0)
        self._current("rows", f"{CHUNKS}, load long, n_chunks int", state).write.parquet(f"{self.path}/rows/{one}")
        self._current("vectors", f"{VECTORS}, load long", state).write.options(**BLOOM).parquet(f"{self.path}/vectors/{one}")

        def change(now):
            if set(state["data"]) <= set(now["data"]):  # else another writer has compacted them
                now["data"] = [one, *(n for n in now["data"] if n not in set(state["data"]))]

        self.manifest.commit(change)
        return self


class Log:
    """An append-only table of rows, as messages and conversations are. Writers at the same time lose nothing of each other."""

    def __init__(self, spark: SparkSession, schema, path: str | None = None):
        self.spark, self.schema, self.path = spark, schema, path or shared.new_path(spark, "log")
        self.manifest = Manifest(spark, f"{self.path}/manifest", {"data": [], "batches": {}})

    def insert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Adds rows at once. batch: (stream, number) of a micro-batch, which is added once however often it is run."""
        done = lambda state: batch is not None and state["batches"].get(batch[0], -1) >= batch[1]
        if done(self.manifest.last()[1]):
            return False
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")

        def change(state):
            if done(state):
                return False
            if batch:
                state["batches"][batch[0]] = batch[1]
            state["data"].append(name)
            return True

        return self.manifest.commit(change)

    def rows(self) -> DataFrame:
        names = self.manifest.last()[1]["data"]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{n}" for n in names]) if names else self.spark.createDataFrame([], self.schema)

    def compact(self) -> None:
        """Rewrites what has been added so far as one table."""
        names, one = self.manifest.last()[1]["data"], uuid.uuid4().hex
        self.rows().write.parquet(f"{self.path}/data/{one}")

        def change(state):
            if names == state["data"][: len(names)]:  # else another writer has done so
                state["data"][: len(names)] = [one]

        self.manifest.commit(change)


def with_titles(conversations: DataFrame) -> DataFrame:
    """New conversations with the default title where they have none."""
    return conversations.withColumn("title", F.coalesce("title", F.lit("New Conversation")))


def next_ids(messages: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` messages (conversation_id, seq, ...) numbered on from each conversation's last."""
    last = messages.groupBy("conversation_id").agg(F.max("id").alias("_last"))
    n = F.row_number().over(Window.partitionBy("conversation_id").orderBy("seq"))
    return new.join(last, "conversation_id", "left").withColumn("id", F.coalesce("_last", F.lit(-1).cast("long")) + n).drop("_last", "seq")
