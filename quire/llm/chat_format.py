"""Conversations from messages that quote each other.

Quoted lines are parsed by level (">" marks, however nested). Quoted passages, whole and by line and sentence, are
hashed in a normal form and joined to the messages that hold them as their own words; the latest earlier
message wins. That gives the message each message replies to. A thread is a message that replies to none,
with all that reply to it, directly or not; conversations are ordered by thread and turn, without quotes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import shared

QUOTE = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)(.*)", re.S)
#: The line that introduces a quote in mails, in the languages of the corpus.
INTRO = re.compile(r"\s*(?:On|Am|Le|El)\b.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\b.{0,80}:\s*")
#: Where a sentence ends: after its marks and what closes with them, before white space, or anywhere after those of CJK.
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])(?![。！？”’」』）])")
CHUNK = 4096


def split_quotes(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(own text, [(level, passage)]): neighbouring lines of one level are a passage, empty ones don't end it."""
    own, passages, lines = [], [], (text or "").split("\n")
    for i, line in enumerate(lines):
        m = QUOTE.fullmatch(line)
        if m:
            level = m[1].count(">")
            if passages and passages[-1][0] == level and passages[-1][2] == i - 1:
                passages[-1][1].append(m[2])
                passages[-1][2] = i
            else:
                passages.append([level, [m[2]], i])
        elif INTRO.fullmatch(line) and any(QUOTE.fullmatch(x) for x in lines[i + 1 : i + 3]):
            continue
        else:
            own.append(line)
    said = "\n".join(own).strip("\n") if passages else text or ""
    return said, [(level, "\n".join(x)) for level, x, _ in passages]


def normal(passage: str) -> str:
    return " ".join(passage.split()).lower()


def sentences(text: str) -> list[str]:
    out, at = [], 0
    for m in SENTENCE.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


def units(passage: str) -> dict[int, int]:
    """hash -> characters of the whole passage, its paragraphs, their sentences however wrapped, and its lines, in normal form."""
    out = {}
    paragraphs = re.split(r"\n[ \t]*\n", passage)
    lines = passage.split("\n")
    for x in [passage, *paragraphs, *lines, *(y for x in (*paragraphs, *lines) for y in sentences(x))]:
        n = normal(x)
        if n:
            out[xxhash.xxh3_64_intdigest(n) >> 1] = len(n)
    return out


def _own(messages: DataFrame) -> DataFrame:
    """c, turn, role, text without quotes, and quotes: array of (level, hash, chars)."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("chars", pa.int64())]))
        for b in batches:
            texts, quotes, n = [], [], []
            for t in b.column("text"):
                said, passages = split_quotes(t.as_py())
                texts.append(said)
                n.append(len(passages))
                quotes.append([{"level": level, "hash": h, "chars": c} for level, p in passages for h, c in units(p).items()])
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("turn"), b.column("role"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(quotes, kind)], names=["c", "turn", "role", "text", "n_quoted", "quotes"])

    return messages.mapInArrow(parsed, "c long, turn long, role string, text string, n_quoted long, quotes array<struct<level:int,hash:bigint,chars:bigint>>")


def _units(messages: DataFrame) -> DataFrame:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c.as_py(), t.as_py(), h) for c, t, x in zip(b.column("c"), b.column("turn"), b.column("text")) for h in units(x.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(zip(*rows)) or [[]] * 3)], names=["c", "turn", "hash"])

    return messages.select("c", "turn", "text").mapInArrow(hashed, "c long, turn long, hash long")


def replies(own: DataFrame) -> DataFrame:
    """Rows (c, turn, parent, n_linked): for each message with a quote found in an earlier message of its
    conversation, the message of the outermost quote found; of several, that with the longest unit, then the latest."""
    q = shared.written(own.filter("n_quoted > 0").select("c", "turn", F.explode("quotes").alias("q")).select("c", "turn", "q.level", "q.hash", "q.chars").distinct(), "quotes")
    sources = own.join(q.select("c").distinct(), "c", "left_semi")
    u = _units(sources).distinct()
    both = u.select("c", "hash", "turn", F.lit(True).alias("said"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("chars")).unionByName(q.select("c", "hash", "turn", F.lit(False).alias("said"), "level", "chars"))
    both = both.withColumn("chunk", F.expr(f"turn div {CHUNK}"))
    # the latest earlier message: within a stretch of turns, or else from the stretches before
    per_chunk = both.filter("said").groupBy("c", "hash", "chunk").agg(F.max("turn").alias("last"))
    before = F.max("last").over(Window.partitionBy("c", "hash").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    earlier = both.select("c", "hash", "chunk").distinct().join(per_chunk, ["c", "hash", "chunk"], "left").withColumn("before", before).select("c", "hash", "chunk", "before")
    inside = F.max(F.when(F.col("said"), F.col("turn"))).over(Window.partitionBy("c", "hash", "chunk").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    found = both.withColumn("inside", inside).filter("NOT said").join(earlier, ["c", "hash", "chunk"]).withColumn("parent", F.coalesce("inside", "before")).filter("parent IS NOT NULL")
    best = F.max(F.struct(-F.col("level"), F.col("chars"), F.col("parent")))
    return found.groupBy("c", "turn").agg(best["parent"].alias("parent"), F.countDistinct("hash").alias("n_linked"))


def threads(parents: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Rows (c, turn, root, depth) of messages with a parent, by pointer jumping: rounds go by the logarithm of the depth."""
    p = shared.written(parents.select("c", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    for _ in range(most_rounds):
        up = p.select("c", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = p.join(up, ["c", "root"], "left")
        moved = shared.written(step.select("c", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "threads")
        shared.drop(p)
        p = moved.drop("moved")
        p._quire_path = moved._quire_path
        if not moved.filter("moved").limit(1).count():
            return p
    raise RuntimeError("replies go in a circle")


def report(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per row of ``messages``: conv_id, thread (its first turn), turn, depth, role, reply_to, n_quoted, n_linked, text.

    In order of (conv_id, thread, turn), every message comes after the one it replies to. A null text
    is an empty one; a message that is nothing but quotes has an empty text. Rows that repeat a turn get the same
    place; rows without conversation or turn are threads of their own. A very long message is parsed whole; other columns are not
    looked at; an empty table gives no rows.
    """
    m = messages.select(F.col(conv).cast("long").alias("c"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    own = shared.written(_own(m), "messages")
    parent = shared.written(replies(own), "replies")
    out = own.join(parent, ["c", "turn"], "left").join(threads(parent), ["c", "turn"], "left")
    return out.select(
        F.col("c").alias(conv), F.coalesce("root", "turn").alias("thread"), F.col("turn").alias(turn), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "role",
        F.col("parent").alias("reply_to"), "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "text",
    )


def chats(report: DataFrame, conv: str = "conv_id", turn: str = "turn", most: int = 10_000) -> DataFrame:
    """Rows (conv_id, thread, part, messages): a thread's turns as an array of (role, text), in order.

    A thread of more than ``most`` turns is given in parts, so that no row grows without bound.
    """
    part = F.expr(f"{turn} div {most}").alias("part")
    return report.groupBy(conv, "thread", part).agg(F.transform(F.array_sort(F.collect_list(F.struct(turn, "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))
