"""Upload events and token streams, as batches and as streams."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.sources import shared
from quire.sources.store import Log, Store
from quire.sources.tables import MAX_IDS, SYNC, UPLOAD

# What is taken from uploads.
SUPPORTED = (
    "application/pdf",
    "application/msword",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "text/plain",
    "text/markdown",
)


def payload(value: Column) -> Column:
    """An event's payload, with or without envelope; null for what isn't JSON."""
    return F.from_json(F.coalesce(F.get_json_object(value, "$.payload"), value), UPLOAD)


def documents_of(events: DataFrame) -> DataFrame:
    """Catalog rows of upload events ``value``: those with an address and a supported type, with defaults.

    Malformed events are left out, each by itself. Works on batches and streams alike.
    """
    e = events.select(payload(F.col("value")).alias("p")).select("p.*")
    e = e.filter(~X.blank(F.col("url")) & F.col("mimeType").isin(*SUPPORTED))
    return e.select(
        F.col("fileId").alias("file_id"), F.coalesce("userId", F.lit("system")).alias("user_id"), F.coalesce("originalName", F.lit("document")).alias("file_name"), F.lit(0).alias("file_size"),
        F.col("url").alias("file_url"), X.type_of_upload(F.col("mimeType"), F.col("originalName")).alias("document_type"), F.lit("PENDING").alias("status"), F.lit(0).alias("chunk_count"),
    )


def judged(events: DataFrame) -> DataFrame:
    """``events`` with ``reason``: why one is not taken, null if it is. Works on batches and streams alike."""
    p = payload(F.col("value"))
    reason = (
        F.when(F.col("value").isNull() | F.expr("try_parse_json(value)").isNull(), "not JSON")
        .when(X.blank(p["url"]), "no address")
        .when(p["mimeType"].isNull(), "no type")
        .when(~p["mimeType"].isin(*SUPPORTED), F.concat(F.lit("unsupported type: "), p["mimeType"]))
    )
    return events.withColumn("reason", reason)


def split(stream: DataFrame, log: Log, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Runs a stream of events (value, and where it is from) into ``log``, each once; gives catalog rows of the good ones, and the others with
    their ``reason`` as they came. One pass writes both."""
    Subscription(judged(stream), lambda rows, number: log.insert(rows, (checkpoint, number)), checkpoint).run()
    rows = log.rows()
    return documents_of(rows.filter("reason IS NULL")), rows.filter("reason IS NOT NULL")


def index_sync(payloads: DataFrame) -> DataFrame:
    """Vector store rows (id, content, metadata) of sync payloads ``value``: a chunk's own metadata wins."""
    p = payloads.select(F.from_json("value", SYNC).alias("p")).select("p.*", F.explode("p.chunks").alias("c"))
    base = {"documentId": F.col("documentId"), "fileName": F.col("title"), "collectionId": F.col("metadata.collectionId"), "classification": F.col("metadata.classification"), "uploadedBy": F.col("metadata.uploadedBy")}
    own = F.coalesce("c.metadata", F.expr("cast(map() as map<string,string>)"))
    outer = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in base.items()]))
    kept = F.map_filter(outer, lambda k, v: ~F.map_contains_key(own, k) & (v.isNotNull() | k.isin("documentId", "fileName")))
    return p.select(F.col("c.chunkId").alias("id"), F.col("c.content").alias("content"), F.map_concat(kept, own).alias("metadata"))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of every key in ``new`` replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


CATALOG = "file_id string, user_id string, file_name string, file_size int, file_url string, document_type string, status string, chunk_count int"


def ingest(events: DataFrame, path: str, checkpoint: str):
    """Starts the upload stream: catalog rows are appended under ``path``. What is there now, then ends."""
    return documents_of(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def arriving(rows: DataFrame, name: str, kind: str = "text", files: int | None = None) -> tuple[DataFrame, str]:
    """``rows`` as files of the shared folder, read as a stream, ``files`` of them a micro-batch; and the folder, for sinks and checkpoints."""
    spark = rows.sparkSession
    base = shared.new_path(spark, name)
    rows.write.format(kind).save(f"{base}/in")
    reader = spark.readStream.schema(rows.schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(f"{base}/in"), base


def ingest_stream(envelopes: DataFrame) -> DataFrame:
    """Writes events as text files in the shared folder, streams them in, and gives what arrived."""
    stream, base = arriving(envelopes.select("value"), "events")
    ingest(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return envelopes.sparkSession.read.schema(CATALOG).parquet(f"{base}/out")


def resolved(documents: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog rows of events with the raw texts (id, text) they point to: rows to load (id, user_id, file_name, text), and
    errors (document_id, error_message) for those whose document isn't there. Of several events of a document one counts."""
    d = documents.withColumn("id", F.expr("try_cast(file_id AS bigint)")).filter("id IS NOT NULL")
    j = d.select("id", "user_id", "file_name").dropDuplicates(["id"]).join(texts.select("id", F.struct("text").alias("t")), "id", "left")
    gone = j.filter("t IS NULL").select(F.col("id").alias("document_id"), F.concat(F.lit("Document not found: "), "id").alias("error_message"))
    return j.filter("t IS NOT NULL").select("id", "user_id", "file_name", "t.text"), gone


def etl(store: Store, texts: DataFrame, stream: str) -> Callable[[DataFrame, int], None]:
    """What a micro-batch of events sets off: their documents are looked up, cleaned, chunked, embedded and written.

    stream: a name that no other stream into this store has, and that stays when it is started again, as its checkpoint's. A micro-batch that
    is run again after it was loaded adds nothing. The events are read once, and the texts once: by the ids, which are sent
    to them if they are few."""

    def batch(events: DataFrame, number: int) -> None:
        e = documents_of(events).withColumn("id", F.expr("try_cast(file_id AS bigint)")).filter("id IS NOT NULL")
        asked = shared.written(e.select("id", "file_id", "user_id", "file_name").dropDuplicates(["id"]), "asked")
        n = asked.count()
        if n:
            ids = asked.select("id")
            known = shared.written(texts.select("id", "text").join(F.broadcast(ids) if n <= MAX_IDS else ids, "id", "left_semi"), "found")
            found, gone = resolved(asked, known)
            store.load(found, gone, (stream, number), unique=True)
            shared.drop(known)
        shared.drop(asked)

    return batch


class Subscription:
    """A stream's life: ``start`` begins it or goes on from its checkpoint, ``stop`` ends it for good. ``run`` starts it again where it fails: after
    ``waits`` seconds, of which the last holds on, ``most`` times in a row without any progress (None: for ever), and then raises."""

    def __init__(self, stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, most: int | None = 3, waits: tuple[float, ...] = (2.0, 5.0)):
        self.stream, self.each, self.checkpoint, self.available_now, self.most, self.waits, self.query = stream, each, checkpoint, available_now, most, waits, None
        self.ended = threading.Event()

    def start(self) -> Subscription:
        w = self.stream.writeStream.foreachBatch(self.each).option("checkpointLocation", self.checkpoint)
        self.query = (w.trigger(availableNow=True) if self.available_now else w).start()
        return self

    def stop(self) -> None:
        self.ended.set()
        if self.query is not None:
            self.query.stop()

    def run(self) -> None:
        failures = 0
        while not self.ended.is_set():
            try:
                return self.start().query.awaitTermination()
            except StreamingQueryException:
                failures = 1 if self.query.recentProgress else failures + 1
                if self.most is not None and failures > self.most:
                    raise
                self.ended.wait(self.waits[min(failures, len(self.waits)) - 1])


def etl_stream(envelopes: DataFrame, texts: DataFrame, store: Store) -> Store:
    """Streams events in and loads the documents they announce."""
    stream, base = arriving(envelopes.select("value"), "events")
    Subscription(stream, etl(store, texts, base), f"{base}/checkpoint").run()
    return store


def strip_prefix_live(tokens: DataFrame) -> DataFrame:
    """Tokens (stream_id, seq, token) through ``strip_prefix_stream``: written, streamed in, and what came out."""
    stream, base = arriving(tokens, "tokens", "parquet")
    out = strip_prefix_stream(stream)
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return tokens.sparkSession.read.schema(out.schema).parquet(f"{base}/out")


def strip_prefix_stream(tokens: DataFrame) -> DataFrame:
    """Of a stream (stream_id, seq, token): what comes from each stream's first "{" on, empty tokens left out.

    The state of a stream is one flag. Within a micro-batch tokens go by ``seq``; batches are taken in the
    order in which they arrive.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def each(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        begun = state.get[0] if state.exists else False
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, token in zip(rows["seq"], rows["token"]):
            if not token:
                continue
            if not begun:
                at = token.find("{")
                if at < 0:
                    continue
                begun, token = True, token[at:]
            out.append((key[0], seq, token))
        state.update((begun,))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "token"])  # of a stream that has not begun, no rows

    return tokens.groupBy("stream_id").applyInPandasWithState(each, tokens.select("stream_id", "seq", "token").schema, "begun boolean", "append", GroupStateTimeout.NoTimeout)
