"""Spelling variants: words one edit apart, and the common form that each word is a variant of.

Near words are found by an even-partition pigeonhole join. A word of length l is indexed by its two halves, ``l div 2`` code points and the rest. One
edit hits one half only, so a word of the same length, or of one more code point, shares the other half with it: the first half at the
same place, the second one where it begins or one place on. Buckets of a common half with more than ``heavy`` words are not
compared as they are: what is left of their words is halved again, and so on, as long as two code points are left. Candidates are
verified by one edit, and counted once.

Words come with counts that are summed in each task before any shuffle. A form has at least twice its word's count, so forms lead upwards and end:
roots are found by pointer jumping in a number of rounds that grows with the logarithm of that of the chain.

Null and empty texts have no words. A null key is as an empty one. Repeated rows count each. Only the key and the text of ``docs`` are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import shared

#: Distinct words that a task holds before it gives their counts; bytes of a text that are taken at once.
HELD, SLICE = 100_000, 1 << 20
#: Words of a bucket from which its words are partitioned again; buckets that are broadcast at most.
HEAVY, BROADCAST = 64, 200_000
_RUN = re.compile(rb"(?:[a-z]|\xc3.){5,}", re.DOTALL)  # UTF-8 of a-z and U+00C0 to U+00FF
_ASCII_RUN = re.compile(rb"[a-z]{5,}")
_BETWEEN = re.compile(rb"[\x00-@\[-`{-\x7f]")


def _slices(t: bytes) -> Iterator[bytes]:
    """A long text in slices that end at an ASCII character outside of words."""
    at = 0
    while at < len(t):
        m = _BETWEEN.search(t, at + SLICE)
        end = m.end() if m else len(t)
        yield t[at:end]
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def given() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return b

    for b in batches:
        texts = b.column("text").cast(pa.large_binary())
        for key, value in zip(b.column("key").to_pylist(), texts):
            seed = zlib.crc32(f"{key or ''}:".encode())
            for t in _slices(value.as_py() or b""):
                t = t.lower()
                for run, n in Counter((_RUN if b"\xc3" in t else _ASCII_RUN).findall(t)).items():
                    word, h = run.decode(), zlib.crc32(run, seed)
                    if h % 97 == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    held[word] += n
                if len(held) >= HELD:
                    yield given()
    if held:
        yield given()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words of ``shortest`` code points (5 at least) or more that occur ``least`` times or more.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; of a 97th of a document's words, by a checksum, one letter is left out."""
    d = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    n = d.mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return n.filter((F.length("word") >= shortest) & (F.col("n") >= least))


def _halves(rows: DataFrame, of: str, keep: list[str], more: str = "0") -> DataFrame:
    """Each row twice, with the half that is to be found, hashed into ``bucket``, and what is left of the word in ``of``. more: how many
    code points longer than the indexed word it is."""
    half = f"cast((length({of}) - {more}) div 2 as int)"
    first, second = F.expr(f"substring({of}, 1, {half})"), F.expr(f"substring({of}, {half} + {more} + 1)")
    rest_second, rest_first = F.expr(f"substring({of}, {half} + 1)"), F.expr(f"substring({of}, 1, {half} + {more})")
    at = lambda j, seg, rest: F.struct(F.xxhash64("bucket", F.lit(j), seg).alias("bucket"), rest.alias("rest"))
    both = F.explode(F.array(at(0, first, rest_second), at(1, second, rest_first))).alias("h")
    return rows.select(*keep, both).select(*keep, F.col("h.bucket").alias("bucket"), F.col("h.rest").alias(of))


def near_pairs(words: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(a, a_n, b, b_n): the pairs of ``words`` (word, n), each word once, that differ by one inserted, deleted or replaced code point."""
    length = F.length("word")
    index = _halves(words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("word").alias("a_rest"), F.xxhash64(length).alias("bucket")), "a_rest", ["a", "a_n"])
    own = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("word").alias("b_rest"), F.explode(F.array(F.lit(0), F.lit(1))).alias("more"), length.alias("l"))
    probe = _halves(own.select("b", "b_n", "b_rest", "more", F.xxhash64(F.col("l") - F.col("more")).alias("bucket")), "b_rest", ["b", "b_n", "more"], "more")
    found = []
    while True:
        # a bucket whose words differ in one code point at most has nothing to be partitioned
        large = index.groupBy("bucket").agg(F.count("*").alias("k"), F.max(F.length("a_rest")).alias("left")).filter((F.col("k") > heavy) & (F.col("left") >= 2))
        large = shared.written(large.select("bucket"), "spelling-heavy")
        n = large.count()
        marked = F.broadcast(large) if n <= BROADCAST else large
        light = index.join(marked, "bucket", "left_anti") if n else index
        edit = F.levenshtein("a", "b", 1) == 1
        pairs = light.join(probe, "bucket").filter(((F.col("more") == 1) | (F.col("a") < F.col("b"))) & edit).select("a", "a_n", "b", "b_n")
        found.append(shared.written(pairs, "spelling-near"))
        if not n:
            break
        index = shared.written(_halves(index.join(marked, "bucket", "left_semi"), "a_rest", ["a", "a_n"]), "spelling-index")
        probe = shared.written(_halves(probe.join(marked, "bucket", "left_semi"), "b_rest", ["b", "b_n", "more"], "more"), "spelling-probe")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form (word, form): where following forms ends."""
    t = shared.written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = t.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        j = shared.written(t.join(up, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "spelling-roots")
        t = j.select("word", "root")
        if not j.filter("moved").limit(1).count():
            return t


def variants(words: DataFrame, ratio: int = 2, heavy: int = HEAVY) -> DataFrame:
    """Per row of ``words`` (word, n): word, form, root, n, n_near, form_n.

    The form is the near word that occurs most (ties: the first in code-point order) if it does ``ratio`` (2 at least) times as often."""
    if ratio < 2:
        raise ValueError("forms have to lead to words that occur more often")
    words = shared.written(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words, heavy)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("form"), F.col("b_n").alias("form_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("form"), F.col("a_n").alias("form_n")))
    best = F.min(F.struct((-F.col("form_n")).alias("least"), "form")).alias("best")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best)
    large = -F.col("best.least") >= ratio * F.col("n")
    own = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.least")).alias("form_n"))
    own = shared.written(own, "spelling-forms")
    return own.join(roots(own.filter("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    """The variants of all words of ``docs``."""
    return variants(word_counts(docs))
