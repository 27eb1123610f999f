"""Benchmark decontamination by a broadcast set of benchmark n-grams.

A document is scanned in three steps, all by built-in functions:

1. A window of n words holds exactly one anchor of k words (k <= 6) that starts at a multiple of n - k + 1. Only these anchors of
   a document are hashed, and looked up in the set of the benchmark's anchors: 64-bit hashes in a hash table that is sent to all
   executors, if a count shows that they are at most ``max_set``. Of a larger benchmark the anchors' hashes are joined by a shuffle,
   and nothing else changes: no text and no window is shuffled for the search.
2. Around each anchor found, the windows that contain it are cut out of the documents that have one.
3. These are joined to the benchmark's windows by hash, length and the words themselves.

Steps 2 and 3 look at each text once, however many documents have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of letters, digits and everything beyond ASCII; between them is this, once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower-cased.
RAW_WORD, NOT_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
ANCHOR = 6
#: Rows up to which a table is sent to all executors (about 40 bytes a row): anchors, and texts with hits.
MAX_SET, MAX_TEXTS = 2_000_000, 50_000


def words(text: Column) -> Column:
    """The words in lower case. Splitting takes a fifth of the time of extracting."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN, -1), lambda x: x != "")


def windows(benchmark: DataFrame, n: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item_id, win, len, h): the distinct windows of each item.

    An item with fewer than ``n`` words is one window; without words it has none. Items without an
    id are left out.
    """
    w = F.col("w")
    size = F.size(w)
    starts = F.when(size >= n, F.sequence(F.lit(0), F.greatest(size - n, F.lit(0)))).otherwise(F.array(F.lit(0)))
    return (
        benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("w"))
        .filter((F.size("w") > 0) & F.col("item_id").isNotNull())
        .select("item_id", F.explode(F.transform(starts, lambda s: F.slice(w, s + 1, n))).alias("g"))
        .select("item_id", F.array_join("g", " ").alias("win"), F.size("g").alias("len"), F.xxhash64("g").alias("h"))
        .distinct()
    )


def _anchor(n: int) -> tuple[int, int]:
    """(words of an anchor in a window of ``n`` words, distance between a document's anchors)."""
    k = min(ANCHOR, n)
    return k, n - k + 1


def _anchors(lengths: list[int]) -> Column:
    """array<bigint> of array ``w``: first 0, then the hashes of the document's anchors for each length of windows in turn."""
    parts = ["array(0L)"]
    for n in lengths:
        k, step = _anchor(n)
        parts.append(f"if(size(w) < {n}, cast(array() AS array<bigint>), transform(sequence(0, size(w) - {k}, {step}), p -> xxhash64(slice(w, p + 1, {k}), {n})))")
    return F.expr(f"concat({', '.join(parts)})")


def _placed(lengths: list[int]) -> Column:
    """struct<len, p> of the i-th of these in a document of ``n_words`` words; a length of 0 for the first."""
    i, before, out = F.col("i"), F.lit(1), F.when(F.col("i") == 0, F.struct(F.lit(0).alias("len"), F.lit(0).alias("p")))
    for n in lengths:
        k, step = _anchor(n)
        count = F.when(F.col("n_words") >= n, F.floor((F.col("n_words") - k) / step).cast("int") + 1).otherwise(0)
        out = out.when(i < before + count, F.struct(F.lit(n).alias("len"), ((i - before) * step).cast("int").alias("p")))
        before = before + count
    return out


def _near(lengths: list[int]) -> Column:
    """array<struct<start, len, h, win>> of array ``w``: the windows that contain the anchors ``ps`` (len, p)."""
    parts = []
    for n in lengths:
        _, step = _anchor(n)
        starts = f"array_distinct(flatten(transform(filter(ps, x -> x.len = {n}), x -> filter(sequence(greatest(x.p - {step - 1}, 0), x.p), s -> s + {n} <= size(w)))))"
        parts.append(f"transform({starts}, s -> struct(s AS start, {n} AS len, xxhash64(slice(w, s + 1, {n})) AS h, array_join(slice(w, s + 1, {n}), ' ') AS win))")
    return F.expr(f"concat({', '.join(parts)})")


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", text_col: str = "text", max_set: int = MAX_SET) -> DataFrame:
    """Rows (key, text_hash, n_words, n_hit, items, positions) for every row of ``docs``.

    ``items`` is the sorted array of item ids (as strings) with a window in the text, ``positions``
    the sorted word positions inside any of them. A null or empty text has no words and no hits; a very long one is one row of
    anchors; a repeated row gets the same answer each time; empty tables give no rows or no hits. Other columns are not looked at.
    """
    win = shared.written(windows(benchmark, n), "windows")
    lengths = [r[0] for r in win.select("len").distinct().collect()]  # at most n
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    d = docs.select(F.col(f"`{key}`").alias("k"), F.xxhash64(text).alias("th"), words(text).alias("w"))
    none = docs.sparkSession.createDataFrame([], "th long, n_hit long, items array<string>, positions array<int>")
    if not lengths:
        b, per_text = d.select("k", "th", F.size("w").cast("long").alias("n_words")), none
    else:
        own = f"transform(sequence(0, len - least({ANCHOR}, len)), s -> xxhash64(slice(split(win, ' '), s + 1, least({ANCHOR}, len)), len))"
        grams = shared.written(win.select("len", "win").distinct().select(F.explode(F.expr(own)).alias("h")).distinct(), "anchors")
        scanned = d.select("k", "th", F.size("w").cast("long").alias("n_words"), F.posexplode(_anchors(lengths)).alias("i", "h"))
        place = _placed(lengths).alias("at")
        if grams.count() <= max_set:
            found = scanned.join(F.broadcast(grams.withColumn("hit", F.lit(True))), "h", "left").filter("hit OR i = 0").select("k", "th", "n_words", place)
        else:
            at = scanned.filter("i > 0").join(grams, "h").select("th", place)
            found = scanned.filter("i = 0").select("k", "th", "n_words", place).unionByName(at, allowMissingColumns=True)
        found = found.select("k", "th", "n_words", "at.*")
        found = shared.written(found, "found")
        b = found.filter("len = 0").select("k", "th", "n_words")
        per_text = _verified(docs.select(F.xxhash64(text).alias("th"), text.alias("text")), found.filter("len > 0"), win, lengths)
    j = b.join(F.broadcast(per_text) if _few(per_text) else per_text, "th", "left")
    empty = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as array<{kind}>)"))
    return j.select(
        F.col("k").alias(key), F.col("th").alias("text_hash"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), empty("items", "string").alias("items"), empty("positions", "int").alias("positions"),
    )


def _few(df: DataFrame) -> bool:
    return df.limit(MAX_TEXTS + 1).count() <= MAX_TEXTS


def _verified(texts: DataFrame, found: DataFrame, win: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows (th, n_hit, items, positions) of ``texts`` (th, text) in which the anchors ``found`` (th, len, p) are parts of windows."""
    per = shared.written(found.groupBy("th").agg(F.collect_set(F.struct("len", "p")).alias("ps")), "anchors-of")  # of one text
    own = texts.join(F.broadcast(per) if _few(per) else per, "th").select("th", "ps", words(F.col("text")).alias("w"))  # only texts with an anchor
    near = shared.written(own.select("th", F.explode(_near(lengths)).alias("f")).select("th", "f.*").distinct(), "near")
    # written, so that the join can split a window that many texts have
    items = shared.written(win.groupBy("len", "h", "win").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids")), "items")
    at = near.join(items, ["len", "h", "win"])
    positions = F.flatten(F.collect_set(F.expr("sequence(start, start + len - 1)")))
    out = at.groupBy("th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"), F.array_sort(F.array_distinct(positions)).alias("positions"))
    return shared.written(out.select("th", F.size("positions").cast("long").alias("n_hit"), "items", "positions"), "hits")


def report(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; nulls, empty, long and repeated rows as in ``hits``."""
    h = hits(docs, benchmark, **kw)
    return h.select(
        kw.get("key", "doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", key: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without contaminated rows (mode "documents") or without the words hit (mode "spans").

    Columns of any name stay as they are; rows with a null or empty text stay, and of repeated rows all or none. In mode "spans", a word goes
    with the separators that follow it.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"no such mode: {mode}")
    h = hits(docs, benchmark, key=key, text_col=text_col, **kw).filter("n_hit > 0").select(F.col(f"`{key}`").alias("hk"), F.col("text_hash").alias("hth"), F.col("positions").alias("ps"))
    h = shared.written(h.groupBy("hk", "hth").agg(F.first("ps").alias("ps")), "contaminated")
    h = F.broadcast(h) if _few(h) else h
    # rows are packed, so that no column of theirs can clash with what is added
    t = F.col(f"`{text_col}`")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col(f"`{key}`").alias("dk"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("dth"))
    same = F.col("dk").eqNullSafe(F.col("hk")) & (F.col("dth") == F.col("hth"))
    if mode == "documents":
        return d.join(h, same, "left_anti").select("r.*")
    t = F.col("r")[text_col]
    lead = F.regexp_extract(t, f"^{NOT_WORD}*", 0)
    pieces = F.regexp_extract_all(t, F.lit(RAW_WORD + NOT_WORD + "*"), F.lit(0))
    cut = F.concat(lead, F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains("ps", i)), ""))
    return d.join(h, same, "left").select(*[F.when(F.col("ps").isNull(), t).otherwise(cut).alias(c) if c == text_col else F.col("r")[c].alias(c) for c in docs.columns])
