"""Readers with explicit schemas, and the logical tables of a document knowledge base."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import chunking
from quire.functions import text as X
from quire.sources import shared

UPLOAD = T.StructType([T.StructField(n, T.StringType()) for n in ("fileId", "userId", "url", "mimeType", "originalName", "classification", "collectionId")])
SYNC = "documentId string, title string, content string, chunks array<struct<chunkId:string,content:string,metadata:map<string,string>>>, metadata struct<collectionId:string,classification:string,uploadedBy:string,acl:array<map<string,string>>>"
CHUNK_BATCH = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where its files give fewer tasks than that (a file of one row group is one task), for
    steps whose work on a row is large next to moving it; as it is where there are tasks enough."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if len(df._jdf.inputFiles()) >= n or df.select(F.spark_partition_id().alias("p")).distinct().count() >= n:
        return df
    return df.repartition(n)


def files(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """Rows (path, size, text) of whole files. Text files are read as they are; for other formats give
    ``extract``, a function from bytes to a list of text parts, of which the blank ones are left out."""
    listing, opened = shared.listed(spark, path)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, held, size = opened(), [], 0

        def given() -> pa.RecordBatch:
            paths, sizes, found = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary() if extract is None else pa.list_(pa.string()))], names=["path", "size", "found"])

        for b in batches:
            for p, n, root, at in zip(*(b.column(c).to_pylist() for c in ("path", "size", "root", "at"))):
                content = read(root, at)
                held.append((p, n, content if extract is None else extract(content)))
                size += len(content)
                if size > 1 << 22 or len(held) >= 1000:
                    yield given()
                    held, size = [], 0
        if held:
            yield given()

    found = listing.mapInArrow(whole, f"path string, size long, found {'binary' if extract is None else 'array<string>'}")
    return found.select("path", "size", (F.decode("found", "UTF-8") if extract is None else join_parts(F.col("found"))).alias("text"))


def join_parts(parts: Column, blank_line: bool = True) -> Column:
    """Extracted parts as one text: each not blank one with a blank line after it, or all without separator."""
    if not blank_line:
        return F.array_join(parts, "")
    return F.array_join(F.transform(F.filter(parts, lambda p: ~X.blank(p)), lambda p: F.concat(p, F.lit("\n\n"))), "")


def location(url: Column, path: Column) -> Column:
    """The address to read a document from."""
    return F.when(X.blank(url), path).otherwise(url)


def sync_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SYNC).json(path)


def minutes_after_start(n: Column) -> Column:
    return F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_interval(mins=n.cast("int"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog before processing, with the raw text."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("user_id"), F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")).alias("file_name"), F.col("n_chars").cast("int").alias("file_size"),
        F.lit("txt").alias("document_type"), minutes_after_start(F.col("doc_id")).alias("created_at"), "text",
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, file_name, user_id, raw, clean), the text reconstructed."""
    c = spread(catalog(spark, sf_dir))
    return c.select(F.col("id").alias("document_id"), "file_name", "user_id", F.col("text").alias("raw"), X.reconstruct(F.col("text")).alias("clean"))


def chunks(spark: SparkSession, sf_dir: str, where: str | Column = "true") -> DataFrame:
    """(document_id, chunk_index, chunk_title, chunk_text, token_count, char_count) of all processed documents, or of those with
    ``where`` on the catalog's id and user, which is tested before any text is cleaned."""
    c = spread(catalog(spark, sf_dir).filter(where))
    return chunking.chunk_rows(c.select(F.col("id").alias("document_id"), X.reconstruct(F.col("text")).alias("clean")))


def chunk_keys(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """(document_id, chunk_index), of the catalog rows ``docs`` or of all."""
    c = spread(catalog(spark, sf_dir) if docs is None else docs)
    return chunking.chunk_keys(c.select(F.col("id").alias("document_id"), X.reconstruct(F.col("text")).alias("clean")))


def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, n_units, n_chunks, n_tokens, n_chars) of all documents."""
    return chunking.chunk_sizes(cleaned(spark, sf_dir))


def error_of(raw_blank: Column, n_units: Column, n_chunks: Column) -> Column:
    """Why a document could not be processed, null if it was."""
    return (
        F.when(raw_blank, "Extracted text is empty")
        .when(n_units < chunking.SHORTEST, F.concat(F.lit("Text too short after cleaning: "), n_units, F.lit(" chars")))
        .when(n_chunks == 0, "No chunks produced after chunking")
    )


def with_status(docs: DataFrame, key: str = "id") -> DataFrame:
    """Catalog rows with a raw ``text``: without it, and with status, chunk_count and error_message; no document fails the job.

    One pass: each text is cleaned and chunked once, and only counts come back."""
    own = tuple(c for c in docs.columns if c not in (key, "text"))
    d = docs.select(key, *own, X.blank(F.col("text")).alias("_blank"), X.reconstruct(F.col("text")).alias("clean"))
    n = chunking.chunk_sizes(d, key, "clean", (*own, "_blank"))
    error = error_of(F.col("_blank"), F.col("n_units"), F.col("n_chunks"))
    return n.select(key, *own, F.when(error.isNull(), "COMPLETED").otherwise("FAILED").alias("status"), F.col("n_chunks").alias("chunk_count"), error.alias("error_message"))


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with status, chunk_count and error_message."""
    return with_status(spread(catalog(spark, sf_dir)))


def any_completed(spark: SparkSession, sf_dir: str, first: int = 64) -> DataFrame:
    """One processed document that is complete, or none. A few are processed first, the others only if none of them is complete."""
    c = catalog(spark, sf_dir)
    done = lambda docs: with_status(docs).filter("status = 'COMPLETED'").limit(1)
    found = done(c.filter(F.octet_length("text") >= chunking.SHORTEST).limit(first))
    return found if found.count() else done(spread(c))


def metadata(document_id: Column, user_id: Column, file_name: Column, index: Column, title: Column, text: Column) -> Column:
    """The vector store's metadata: seven strings."""
    return F.create_map(
        F.lit("documentId"), document_id.cast("string"), F.lit("userId"), user_id, F.lit("fileName"), file_name, F.lit("chunkIndex"), index.cast("string"),
        F.lit("chunkTitle"), title, F.lit("tokenCount"), X.tokens_by_ratio(text).cast("string"), F.lit("charCount"), X.utf16_length(text).cast("string"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding): what a search without a filter has to read."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _with_documents(v: DataFrame, d: DataFrame) -> DataFrame:
    title = F.when(F.col("label") % 2 == 0, F.array_join(F.slice(F.split("text", " "), 1, 3), " ")).otherwise("")
    name = F.concat(F.lit("doc_"), F.col("vec_id"), F.lit(".txt"))
    j = v.join(d, v["vec_id"] == d["doc_id"], "left")
    m = metadata(F.col("doc_id"), F.col("source"), F.when(F.col("doc_id").isNotNull(), name), F.lit(0), title, F.col("text"))
    return j.select(F.col("vec_id").alias("id"), F.col("text").alias("content"), m.alias("metadata"), *[c for c in v.columns if c == "embedding"])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content, metadata, embedding): each vector with the document of its number, if there is one."""
    return _with_documents(table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


#: Ids up to which a table of them is sent to all executors.
MAX_IDS = 100_000


def contents(spark: SparkSession, sf_dir: str, ids: DataFrame) -> DataFrame:
    """(id, content, metadata) of the vectors with ``ids`` (id), each once. Texts of other documents aren't moved: ids that are few
    are sent to where the documents are read, and of many only the rows found by them are joined."""
    few = ids.count() <= MAX_IDS
    of = F.broadcast(ids) if few else ids
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label").join(of.select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source").join(of.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return _with_documents(v, d)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conversation_id, id, role, content, created_at): the append-only log, in order of (created_at, id)."""
    m = table(spark, sf_dir, "conversations")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_interval(secs=F.col("turn").cast("decimal(18,6)"))
    return m.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"), at.alias("created_at"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, chat_id, title, created_at); a third have no chat, half no title of their own."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n_messages"))
    title = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Chat "), F.col("id")))
    return c.select("id", (F.col("id") % 50).cast("string").alias("user_id"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("chat-"), F.col("id"))).alias("chat_id"), F.coalesce(title, F.lit("New Conversation")).alias("title"), minutes_after_start(F.col("id")).alias("created_at"), "n_messages")


def upload_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload events as JSON strings ``value``, every seventh without its envelope."""
    e = table(spark, sf_dir, "events")
    mime = F.when(F.col("event_type") == "view", "application/pdf").when(F.col("event_type") == "click", "application/vnd.openxmlformats-officedocument.wordprocessingml.document").when(F.col("event_type") == "purchase", "text/plain").when(F.col("event_type") == "signup", "image/png")
    url = F.when(F.col("event_type") != "error", F.concat(F.lit("https://files.example/"), F.col("event_id")))
    name = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("file_"), F.col("event_id")))
    user = F.when(F.col("event_id") % 11 != 0, F.col("user_id").cast("string"))
    p = F.struct(F.col("event_id").cast("string").alias("fileId"), user.alias("userId"), url.alias("url"), mime.alias("mimeType"), name.alias("originalName"))
    value = F.when(F.col("event_id") % 7 == 0, F.to_json(p)).otherwise(F.to_json(F.struct(F.lit("file.document.uploaded").alias("subject"), p.alias("payload"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"))))
    return e.select("event_id", value.alias("value"))


def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, seq, token): answers as they arrive in pieces."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("stream_id"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type") == "click", F.col("props")).when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("token"))
