"""Licence scan: a positional index of the rarest words of licence texts.

Of each template the words that are rarest in the corpus are indexed with their places; how rare they are is counted over all
documents. A file is looked at if it holds one of a template's ``ANCHORS`` rarest words, or the rarest of a phrase that is found as it stands. The places of its indexed words, less their places in a
template, give where the template would begin: postings that agree on that are one alignment, and it counts if all words
of the template's key phrases stand where they have to, enough anchors agree, and what was found weighs enough. Phrases on which nothing may
differ are templates that are one key phrase.

Built-in functions only. A text is split twice, words and places leave it only where it has an anchor, and all sums combine before their shuffle.
Rows are told apart by a name of their own, so that repeated rows and null keys are each a row, and no key is hot.

Null and empty texts have no words: no places, empty labels, a score of 0. Of ``docs`` only the key and the text are read. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import shared
from quire.llm.decontaminate import words


@dataclass(frozen=True)
class Template:
    """A label's text, as lower-case words between spaces, and the phrases in it that must be found. exact: all of it is one."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    exact: bool = False


# Phrases that are found as they stand, with their labels.
BASE = (
    Template("cc-by", "cc by", exact=True),
    Template("gpl", "general public license", exact=True),
    Template("reserved", "all rights reserved", exact=True),
)
# Notices of public licences, and what of them must be there.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "with or without modification")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("copy modify and or distribute this software", "without fee is hereby granted")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international license",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
)
#: Of a template: rarest words that make a file looked at, rarest words indexed besides its key phrases, anchors that must agree, and the
#: share of its weight that must be found.
ANCHORS, INDEXED, AGREE, LEAST = 3, 12, 2, 0.6


def key_places(template: Template) -> set[int]:
    """Where the words of key phrases stand."""
    w = template.text.split(" ")
    out = set()
    for phrase in template.phrases if not template.exact else (template.text,):
        p = phrase.split(" ")
        at = next((i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p), None)
        if at is None:
            raise ValueError(f"{phrase!r} is not in {template.text!r}")
        out |= set(range(at, at + len(p)))
    return out


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.text.split(" ")})


def rarity(docs: DataFrame, text: str, vocab: list[str]) -> dict[str, float]:
    """Of each word the logarithm of how few documents have it (inverse document frequency), counted over all of them."""
    of = F.array_intersect(words(F.col(text)), F.array(*map(F.lit, vocab)))
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), of)).alias("word")).groupBy("word").count().collect()  # a row for each of ``vocab`` at most
    n = {r["word"]: r["count"] for r in rows}
    return {w: math.log((1 + n.get("", 0)) / (1 + n.get(w, 0))) + 1 for w in vocab}


def postings(templates: tuple[Template, ...], idf: dict[str, float]) -> list[tuple]:
    """Rows (template, word, place, weight, anchor, required)."""
    out = []
    for k, t in enumerate(templates):
        w, required = t.text.split(" "), key_places(t)
        rare = sorted(set(w), key=lambda x: (-idf[x], x))
        for i, x in enumerate(w):
            if i in required or x in rare[:INDEXED]:
                out.append((k, x, i, round(idf[x], 6), x in rare[: 1 if t.exact else ANCHORS], i in required))
    return out


def _table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A few rows as literals of the plan."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names.split(" "))]) for r in rows])))


def occurrences(docs: DataFrame, key: str, text: str, index: list[tuple]) -> DataFrame:
    """(row, key, n_words, hits) of each row of ``docs``: ``hits`` are the places of indexed words, null in a file without an anchor."""
    anchors = F.array(*map(F.lit, sorted({r[1] for r in index if r[4]})))
    indexed = sorted({r[1] for r in index})
    places = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("at"), x.alias("word"))), lambda h: h["word"].isin(*indexed))
    d = docs.select(F.col(key).alias("key"), words(F.col(text)).alias("w"))
    d = d.select("key", F.size("w").cast("long").alias("n_words"), F.when(F.arrays_overlap("w", anchors), places).alias("hits"))
    return shared.written(d.select(F.expr("uuid()").alias("row"), "*"), "licence-words")


def alignments(found: DataFrame, templates: tuple[Template, ...], index: list[tuple]) -> DataFrame:
    """(row, template, label, exact, at, score): the templates that files hold, and the place of their first word (before the file, if
    it begins within one); ``score`` is the share of the template's weight that is there."""
    spark = found.sparkSession
    whole = []
    for k, t in enumerate(templates):
        own = [r for r in index if r[0] == k]
        anchors = sum(r[4] for r in own)
        whole.append((k, t.label, t.exact, sum(r[5] for r in own), min(AGREE, anchors), sum(r[3] for r in own)))
    hits = found.filter("hits IS NOT NULL").select("row", F.explode("hits").alias("h")).select("row", F.col("h.word").alias("word"), F.col("h.at").alias("place"))
    own = F.broadcast(_table(spark, index, "template word in_template weight anchor required"))  # as many rows as words in the templates
    j = hits.join(own, "word").withColumn("at", F.col("place") - F.col("in_template"))
    n = lambda c: F.sum(F.col(c).cast("int"))
    a = j.groupBy("row", "template", "at").agg(n("required").alias("n_required"), n("anchor").alias("n_anchors"), F.sum(F.col("weight").cast("decimal(18,6)")).alias("found"))
    a = a.join(F.broadcast(_table(spark, whole, "template label exact need_required need_anchors total")), "template")
    score = F.least(F.lit(1.0), F.round(F.col("found").cast("double") / F.col("total"), 6))
    return a.filter((F.col("n_required") == F.col("need_required")) & (F.col("n_anchors") >= F.col("need_anchors"))).withColumn("score", score).filter(F.col("score") >= LEAST).select("row", "template", "label", "exact", "at", "score")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES) -> tuple[DataFrame, DataFrame]:
    """The files (row, key, n_words, hits), a row for each of ``docs``, and the alignments in them, by ``row``."""
    templates = (*base, *notices)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    index = postings(templates, rarity(docs, "text", vocabulary(templates)))
    found = occurrences(docs, "key", "text", index)
    return found, alignments(found, templates, index)


def _joined(labels: Column) -> Column:
    return F.coalesce(F.array_join(F.array_sort(labels), ","), F.lit(""))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base, first_word and last_word are the number, first and last of the places of the phrases of ``BASE``; score is that of the best alignment."""
    found, at = scan(docs)
    exact = F.when(F.col("exact"), F.col("at"))
    per = at.groupBy("row").agg(F.count(exact).alias("n_base"), F.min(exact).alias("first_word"), F.max(exact).alias("last_word"), F.collect_set(F.when(F.col("exact"), F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"), F.max("score").alias("score"))
    j = found.select("row", "key", "n_words").join(per, "row", "left")
    return j.select(F.col("key").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), _joined(F.col("base_labels")).alias("base_labels"), _joined(F.col("labels")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
