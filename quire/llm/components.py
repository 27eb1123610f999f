"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import shared


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))), F.lit(0))).first())


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    if large:
        e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        e = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))  # a > b
    least = shared.written(e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least", rows=2 * n)  # written, so that the join can split a hot node
    j = e.join(least, "u")
    if large:
        j = j.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        j = j.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = shared.written(j.filter("a != b").distinct(), "edges", rows=2 * n)
    shared.drop(least)
    return out


def components(edges: DataFrame, most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """Rows (node, root) for every node of the edges (a, b), root the least node of its component.

    rows: how many edges there are at most, where that is known. Edges may repeat, point either way or be loops. Tables of earlier rounds are deleted.
    """
    e = shared.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges", rows=rows)
    before = _state(e)
    for _ in range(most_rounds if before[0] else 0):
        big = _star(e, True, before[0])
        small = _star(big, False, before[0])
        shared.drop(e)
        shared.drop(big)
        e, now = small, _state(small)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
