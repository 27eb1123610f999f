"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in a pseudo-random order that depends only on their content, laid
end to end and cut into blocks of equally many words. The i-th slot of the schedule belongs to the
source in whose part of the cumulative target shares the i-th golden-ratio point falls; the k-th slot
of a source takes its k-th block, round and round. So every stretch of the schedule holds the
sources in nearly their target shares. A source's slots end when its target is reached, its last
one possibly within a block.

Running totals over a source, which may hold a third of all rows, are made within hash
buckets of about BUCKET_ROWS rows, whatever the size of the corpus, and then over the buckets' sums. What runs over all sources in
one task has one row a source. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import shared

SPACE = r"[\x20\x09-\x0D]+"
#: Golden-ratio points as integers below 2 ** 31: i * STEP modulo that. Odd, next to 2 ** 31 / 1.618...
STEP, BITS = 1327217885, 31
CELLS, CHUNK, BUCKET_ROWS, BROADCAST_ROWS = 4096, 4096, 20_000, 100_000


def n_words(text: Column) -> Column:
    """Words between white space: the parts of a split but for the empty ones at either end."""
    t = F.coalesce(text, F.lit(""))
    ends = F.substring(t, 1, 1).rlike(SPACE).cast("int") + F.substring(t, -1, 1).rlike(SPACE).cast("int")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, SPACE, -1)) - ends).cast("long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only tables whose row count has been seen to be small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def targets(sized: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Rows (src, no_src, source_size, weight, target) from rows (src, no_src, size).

    Sources by code point, those without a name last, weigh ``weights`` in turn. A target is the share
    of all sizes by weight, but at most ``cap`` times the source's size, the excess reshared by weight.
    These windows run over one row per source.
    """
    s = sized.groupBy("src", "no_src").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("no_src", "src")) - 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long"))
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "no_src", "src").rowsBetween(Window.unboundedPreceding, -1)
    most = F.col("source_size") * cap
    s = s.withColumn("rest", F.sum("source_size").over(all_rows) - F.coalesce(F.sum(most).over(before), F.lit(0)))
    s = s.withColumn("rest_w", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("capped", F.col("rest") * F.col("weight") >= most * F.col("rest_w"))
    # of those not capped, the first in order has the rest that all of them share
    s = s.withColumn("n_capped", F.sum(F.col("capped").cast("int")).over(all_rows))
    first = F.max(F.when(F.col("at") == F.col("n_capped"), F.struct("rest", "rest_w"))).over(all_rows)
    s = s.withColumn("at", F.row_number().over(Window.orderBy(F.col("source_size") / F.col("weight"), "no_src", "src")) - 1).withColumn("open", first)
    open_target = F.col("open.rest").cast("double") * F.col("weight") / F.col("open.rest_w")
    return s.select("src", "no_src", "source_size", "weight", F.when(F.col("capped"), most.cast("double")).otherwise(open_target).alias("target"))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """Rows (slot, src, no_src, k, block, take) of the whole mix. sources: as ``targets`` gives, counted to be small or not.

    Slot order is the order of the mix; ``k`` counts the slots of a source from 0; ``take`` words come
    from the start of its block number ``block``.
    """
    spark = sources.sparkSession
    s = sources.filter("source_size > 0 AND target >= 0.5").select("src", "no_src", F.col("source_size").alias("size"), F.round("target").cast("long").alias("t"))
    s = s.withColumn("nb", F.expr(f"(size + {block - 1}) div {block}"))
    s = s.withColumn("need", F.expr(f"(t div size) * nb + ((t % size) + {block - 1}) div {block}"))
    upto = Window.orderBy("no_src", "src").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.sum("t").over(upto) / F.sum("t").over(total)
    s = s.withColumn("hi", F.round(share * 2**BITS).cast("long")).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("no_src", "src")), F.lit(0)))
    n_sources, n = s.agg(F.count("*"), F.coalesce(F.sum("need"), F.lit(0))).first()
    n = int(n * 1.02) + 64 if n else 0
    width = 2**BITS // CELLS
    cells = s.filter("hi > lo").select("*", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("cell"))
    x = F.expr(f"((id + 1) % {2**BITS}L * {STEP}L) % {2**BITS}L")
    slots = spark.range(n).select(F.col("id").alias("slot"), x.alias("x")).withColumn("cell", F.expr(f"x div {width}"))
    slots = slots.join(_small(cells, n_sources + CELLS), "cell").filter("x >= lo AND x < hi").select("slot", "src", "no_src", "size", "t", "nb", "need", F.expr(f"slot div {CHUNK}").alias("chunk"))
    counts = slots.groupBy("src", "no_src", "chunk").agg(F.count("*").alias("c"))
    ahead = F.coalesce(F.sum("c").over(Window.partitionBy("src", "no_src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("src", "no_src", "chunk", ahead.alias("ahead"))
    own = F.row_number().over(Window.partitionBy("src", "no_src", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("own", own).join(offsets, ["src", "no_src", "chunk"]).withColumn("k", F.col("ahead") + F.col("own")).filter("k < need")
    # what a short stretch of points leaves out is put at the end
    got = counts.groupBy("src", "no_src").agg(F.sum("c").alias("got"))
    late = s.join(got, ["src", "no_src"], "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < need")
    late = late.select(F.lit(n).cast("long").alias("slot"), "src", "no_src", "size", "t", "nb", F.explode(F.expr("sequence(got, need - 1)")).alias("k"))
    both = ranked.select("slot", "src", "no_src", "size", "t", "nb", "k").unionByName(late)
    length = F.expr(f"least({block}L, size - (k % nb) * {block})")
    done = F.expr(f"(k div nb) * size + (k % nb) * {block}")
    return both.select("slot", "src", "no_src", "k", F.expr("k % nb").alias("block"), F.least(length, F.col("t") - done).alias("take"), length.alias("length"))


def _plan(docs: DataFrame, block: int = 512, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3), key: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7) -> DataFrame:
    h = F.xxhash64(F.lit(seed), F.col(key), F.col(source_col), F.coalesce(F.col(text_col), F.lit("")))
    d = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(source_col), F.lit("")).alias("src"), F.col(source_col).isNull().alias("no_src"), n_words(F.col(text_col)).alias("size"), h.alias("h"))
    d = shared.written(d, "sizes")
    sources = shared.written(targets(d, cap, weights).coalesce(1), "sources")
    n_sources, rows = sources.count(), d.count()
    nb = max(1, -(-rows // BUCKET_ROWS))
    d = d.withColumn("b", F.expr(f"pmod(h, {nb})"))
    in_bucket = Window.partitionBy("src", "no_src", "b").orderBy("h", "size", "_k").rowsBetween(Window.unboundedPreceding, 0)
    sums = d.groupBy("src", "no_src", "b").agg(F.sum("size").alias("bs"))
    off = sums.select("src", "no_src", "b", (F.sum("bs").over(Window.partitionBy("src", "no_src").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bs")).alias("off"))
    laid = d.withColumn("cum", F.sum("size").over(in_bucket) - F.col("size")).join(off, ["src", "no_src", "b"]).withColumn("start", F.col("off") + F.col("cum"))
    laid = shared.written(laid.select("_k", "src", "no_src", "size", "h", "start"), "laid")
    used = schedule(sources, block).groupBy("src", "no_src", "block").agg(F.sum((F.col("take") == F.col("length")).cast("long")).alias("full"), F.coalesce(F.max(F.when(F.col("take") < F.col("length"), F.col("take"))), F.lit(0)).alias("part"))
    pieces = laid.filter("size > 0").select("src", "no_src", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    pieces = pieces.select("src", "no_src", "start", "block", F.expr(f"greatest(start - block * {block}, 0)").alias("lo"), F.expr(f"least(start + size - block * {block}, {block})").alias("hi"))
    of_piece = F.expr("full * (hi - lo) + greatest(least(hi, part) - lo, 0)")
    taken = pieces.join(used, ["src", "no_src", "block"]).groupBy("src", "no_src", "start").agg(F.sum(of_piece).alias("taken")).withColumn("sized", F.lit(True))
    out = laid.withColumn("sized", F.col("size") > 0).join(taken, ["src", "no_src", "start", "sized"], "left")
    out = out.join(_small(sources, n_sources), ["src", "no_src"])
    return out.select("_k", "src", "no_src", F.col("h").alias("row_hash"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def plan(docs: DataFrame, key: str = "doc_id", **kw) -> DataFrame:
    """Rows (key, row_hash, size, source_size, target, taken), one per row of ``docs``.

    A null or empty text has size 0 and is never taken; a very long one is many blocks; a null source is a source of its own, the last.
    Repeated rows are further words of their source. Reruns agree, except that equal rows may swap
    what is taken of them. Other columns are not looked at; an empty table gives no rows.
    """
    return _plan(docs, key=key, **kw).withColumnRenamed("_k", key).drop("src", "no_src")


def report(docs: DataFrame, **kw) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken; nulls, empty, long and repeated texts as in ``plan``."""
    return plan(docs, **kw).drop("row_hash")


def mix(docs: DataFrame, key: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, **kw) -> DataFrame:
    """The rows of ``docs``, each as often as the plan takes it, to the nearest whole number, at most ``cap`` times.

    The plan takes most documents of a source whole; only those at the end of its target are rounded, so a source ends within one of its
    documents of its target. One whose documents would all be rounded to nothing keeps the one that is taken most. Columns of any
    name come back as they are; rows without words are in no mix.
    """
    p = _plan(docs, key=key, source_col=source_col, text_col=text_col, seed=seed, **kw).filter("taken > 0")
    p = p.groupBy("row_hash").agg(F.avg(F.col("taken") / F.col("size")).alias("share"), F.count("*").alias("rows"), F.first("src").alias("src"), F.first("no_src").alias("no_src"))
    p = shared.written(p.withColumn("copies", F.floor(F.col("share") + 0.5).cast("int")), "shares")
    per = p.groupBy("src", "no_src").agg(F.sum(F.col("copies") * F.col("rows")).alias("n"), F.max_by("row_hash", F.struct("share", "row_hash")).alias("row_hash"))
    least = shared.written(per.filter("n = 0").select("row_hash", F.lit(1).alias("least")), "least")
    p = p.join(_small(least, least.count()), "row_hash", "left").select("row_hash", F.greatest("copies", "least").alias("copies")).filter("copies > 0")
    # rows are packed, so that no column of theirs can clash with what is added
    h = F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{source_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), h.alias("row_hash")).join(p, "row_hash")
    return d.select("r", F.explode(F.expr("sequence(1, copies)")).alias("copy")).select("r.*")
