"""From search hits to prompts, answers and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import models

# Replies, labels and prompt parts that decide results.
NO_DOCUMENTS = "Hệ thống chưa có tài liệu nội bộ nào được upload."
NO_HITS = "Không tìm thấy thông tin liên quan."
NO_ANSWER = "I couldn't find any relevant information in the internal documents I have access to."
NO_MESSAGES = "Không có tin nhắn nào trong cuộc trò chuyện này."
AGENT_ERROR = "Đã xảy ra lỗi khi xử lý yêu cầu. Vui lòng thử lại."
SOURCE_LABEL, PROMPT = ("[Nguồn ", " — ", " > ", "]\n"), ("Thông tin:\n", "\n\nCâu hỏi:\n", "\n\nTrả về JSON duy nhất.\n")
#: What an answer model is told besides the prompt; replace it as the model needs.
SYSTEM = "Answer from the information given only. Reply with one JSON object: summary (text), details (list of texts), sources (list of texts)."
TITLE_PROMPT = "Give a short title for this question, as JSON with a summary:\n"
ANSWER = "summary string, details array<string>, sources array<string>"


def meta(key: str, fallback: str | Column) -> Column:
    """A metadata value, blank as missing."""
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return X.not_blank_or(F.col("metadata")[key], other)


def hit_columns() -> list[Column]:
    """A hit as a search result, with defaults for what is missing or no number."""
    m = F.col("metadata")
    number = lambda k: F.coalesce(F.expr(f"try_cast(metadata['{k}'] AS bigint)"), F.lit(0).cast("long"))
    return [
        number("documentId").alias("document_id"), number("chunkIndex").cast("int").alias("chunk_index"), F.coalesce(m["fileName"], F.lit("Unknown")).alias("document_name"),
        F.coalesce(m["chunkTitle"], F.lit("General")).alias("chunk_title"), F.col("content").alias("chunk_text"), F.coalesce("score", F.lit(0.0)).alias("similarity"),
    ]


def topic(file_name: Column) -> Column:
    """Keywords, else the chunk's title, else the file."""
    return X.not_blank_or(F.col("metadata")["excerpt_terms"], X.not_blank_or(F.col("metadata")["chunkTitle"], file_name))


def sources(hits: DataFrame) -> DataFrame:
    """Rows (query_id, rank, document_id, title, chunk_id, content, score)."""
    name = F.coalesce(F.col("metadata")["fileName"], F.lit("unknown"))
    return hits.select("query_id", "rank", F.coalesce(F.col("metadata")["documentId"], F.lit("unknown")).alias("document_id"), F.concat(name, F.lit(" > "), topic(name)).alias("title"), F.col("id").cast("string").alias("chunk_id"), "content", F.coalesce("score", F.lit(0.0)).alias("score"))


def context(hits: DataFrame) -> DataFrame:
    """Rows (query_id, context): the hits of each query as numbered blocks. At most k hits a query."""
    name = meta("fileName", "Unknown")
    a, b, c, d = map(F.lit, SOURCE_LABEL)
    block = F.concat(a, F.col("rank"), b, name, c, topic(name), d, F.coalesce("content", F.lit("null")), F.lit("\n\n"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "").alias("context"))


def prompt(question: Column, context: Column) -> Column:
    a, b, c = map(F.lit, PROMPT)
    return F.concat(a, context, b, question, c)


def extractive_answer(context: Column) -> Column:
    """A stand-in for an answer model: the first block of the context as the JSON that the contract asks for."""
    first = F.split(context, "\n\n")[0]
    return F.to_json(F.struct(F.regexp_replace(first, r"\A\[[^\n]*\]\n", "").alias("summary"), F.array().cast("array<string>").alias("details"), F.array(F.regexp_extract(first, r"\A\[([^\n]*)\]", 1)).alias("sources")))


def answered(prompts: DataFrame, model: models.Model | None = None, prompt: str = "prompt", **how) -> DataFrame:
    """``prompts`` with the column ``answer``: what ``model`` replies to each prompt on the executors, null where it fails for it (see ``models.called``).

    Without a model, the first block of the prompt's context as JSON, by built-in functions."""
    if model is None:
        return prompts.withColumn("answer", extractive_answer(F.regexp_replace(F.col(prompt), f"\\A{PROMPT[0]}", "")))
    return models.called(prompts, prompt, model, "answer", **how).drop("error")


def chat(prompt: Column, system: str = SYSTEM) -> Column:
    """A prompt as the messages that a chat model takes."""
    of = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(of("system", F.lit(system)), of("user", prompt))


def titled(conversations: DataFrame, model: models.Model, first: str = "first", title: str = "title", **how) -> DataFrame:
    """``conversations`` with the title that ``model`` makes of the ``first`` message, cleaned; where it fails or gives nothing, the old one stays."""
    asked = conversations.withColumn("_prompt", F.concat(F.lit(TITLE_PROMPT), F.col(first)))
    made = X.clean_title(F.col("_title"))
    got = models.called(asked, "_prompt", model, "_title", **how)
    return got.withColumn(title, X.not_blank_or(made, F.col(title))).drop("_prompt", "_title", "error")


def completed(answers: DataFrame, failed: Column) -> DataFrame:
    """Assistant messages (stream_id, role, content, tokens_used, response_time_ms) of answers (stream_id, answer, asked_at,
    answered_at) that are complete; of those that ``failed``, a fixed text instead and no time."""
    content = F.when(failed, AGENT_ERROR).otherwise(F.col("answer"))
    ms = F.when(~failed, elapsed_ms(F.col("asked_at"), F.col("answered_at")))
    return answers.select("stream_id", F.lit("assistant").alias("role"), content.alias("content"), X.tokens_by_ratio(content).alias("tokens_used"), ms.alias("response_time_ms"))


def elapsed_ms(begin: Column, end: Column) -> Column:
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(begin.cast("timestamp"))


def parsed(answer: Column) -> Column:
    """The answer's struct; null for what isn't the JSON asked for."""
    return F.from_json(answer, ANSWER)


def guard(completed: DataFrame, hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (query_id, reply): what is said at once, null where an answer is to be made."""
    any_done = completed.limit(1).select(F.lit(True).alias("_done"))
    q = queries.select("query_id").join(F.broadcast(any_done), F.lit(True), "left").join(hits.select("query_id", F.lit(True).alias("_hit")).distinct(), "query_id", "left")
    return q.select("query_id", F.when(F.col("_done").isNull(), NO_DOCUMENTS).when(F.col("_hit").isNull(), NO_HITS).alias("reply"))


def knowledge(hits: DataFrame) -> DataFrame:
    """Rows (query_id, rank, result): hits as a tool gives them."""
    return hits.select("query_id", "rank", F.concat(F.lit("["), F.coalesce(F.col("metadata")["fileName"], F.lit("Document")), F.lit("]\n"), F.coalesce("content", F.lit(""))).alias("result"))


def averaged(sums: DataFrame) -> DataFrame:
    """(document_id, total_chunks, total_tokens, total_chars) with averages by integer division, 0 without chunks."""
    avg = lambda x: F.when(F.col("total_chunks") > 0, F.expr(f"{x} div total_chunks")).otherwise(0).cast("long")
    return sums.select("*", avg("total_tokens").alias("avg_tokens"), avg("total_chars").alias("avg_chars"))


def chunk_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same from a chunk table: a row for each of ``documents`` (document_id), also one without chunks."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("total_chunks"), F.sum(F.coalesce("token_count", F.lit(0))).alias("total_tokens"), F.sum(F.coalesce("char_count", F.lit(0))).alias("total_chars"))
    return averaged(documents.select("document_id").join(n, "document_id", "left").na.fill(0, ["total_chunks", "total_tokens", "total_chars"]))


def response(**fields: Column) -> Column:
    """A JSON object of the fields without those that are null, "" or 0."""
    kept = [F.when((v.cast("string") != "") & (v.cast("string") != "0"), v).alias(k) for k, v in fields.items()]
    return F.to_json(F.struct(*kept), {"ignoreNullFields": "true"})


def audited(df: DataFrame, user: Column) -> DataFrame:
    """``df`` with created_at, updated_at, created_by and updated_by; without a user it is SYSTEM."""
    by, now = F.coalesce(user, F.lit("SYSTEM")), F.current_timestamp()
    return df.select("*", now.alias("created_at"), now.alias("updated_at"), by.alias("created_by"), by.alias("updated_by"))


def recent(messages: DataFrame, n: int, keep_system: bool = False) -> DataFrame:
    """The last n messages of every conversation, kept per task first.

    keep_system: a conversation's last system message stays whatever comes after it, as one of the n, and earlier ones go; ``age`` still
    counts the others and the system message by their times."""
    newest = [F.desc("created_at"), F.desc("id")]
    whole = Window.partitionBy("conversation_id").orderBy(*newest)
    if not keep_system:
        return messages.withColumn("age", F.row_number().over(whole)).filter(F.col("age") <= n)
    system = F.coalesce(F.col("role") == "system", F.lit(False))
    of_kind = F.row_number().over(Window.partitionBy("conversation_id", "_system").orderBy(*newest))
    few = messages.withColumn("_system", system).withColumn("_r", of_kind).filter(F.col("_r") <= n).filter(~F.col("_system") | (F.col("_r") == 1))
    has = F.max(F.col("_system").cast("int")).over(Window.partitionBy("conversation_id"))
    kept = few.withColumn("_has", has).filter(F.col("_system") | (F.col("_r") <= n - F.col("_has")))
    return kept.withColumn("age", F.row_number().over(whole)).drop("_system", "_r", "_has")


def summarize(messages: DataFrame, asked: int) -> DataFrame:
    """Rows (conversation_id, summary, n_messages): the last messages that aren't blank, the number kept to 10 to 100."""
    n = min(max(asked, 10), 100)
    last = recent(messages, n)
    line = F.struct("created_at", "id", F.concat("role", F.lit(": "), "content").alias("line"))
    kept = F.array_sort(F.collect_list(F.when(~X.blank(F.col("content")), line)))  # at most 100
    out = last.groupBy("conversation_id").agg(F.transform(kept, lambda x: x["line"]).alias("lines"))
    return out.select("conversation_id", F.when(F.size("lines") == 0, NO_MESSAGES).otherwise(F.array_join("lines", "\n")).alias("summary"), F.size("lines").alias("n_messages"))


def from_first_brace(tokens: DataFrame, part: Column | None = None) -> DataFrame:
    """Rows (stream_id, answer): each stream's tokens from its first "{" on, empty ones left out.

    A token's part before the first "{" goes. The place of the first "{" is found by an aggregate that combines before the
    shuffle, and only tokens from there on are gathered: first per ``part``, a column that grows with ``seq`` (as the hour), so
    that a long stream is spread, then the parts of a stream to its answer, which is one row.
    """
    t = tokens.filter("token != ''").withColumn("_part", F.lit(0) if part is None else part)
    first = t.groupBy("stream_id").agg(F.min(F.when(F.instr("token", "{") > 0, F.col("seq"))).alias("_first"))
    cut = F.when(F.col("seq") == F.col("_first"), F.expr("substring(token, instr(token, '{'))")).otherwise(F.col("token"))
    kept = t.join(first, "stream_id").filter(F.col("seq") >= F.col("_first")).select("stream_id", "_part", "seq", cut.alias("token"))

    def joined(of: str, x: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(of, x))), lambda y: y[x]), "")

    parts = kept.groupBy("stream_id", "_part").agg(joined("seq", "token").alias("_text"))
    whole = parts.groupBy("stream_id").agg(joined("_part", "_text").alias("answer"))
    return first.select("stream_id").join(whole, "stream_id", "left").select("stream_id", F.coalesce("answer", F.lit("")).alias("answer"))
