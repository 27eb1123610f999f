"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per rule
that failed. A policy is a versioned set of rules: it decides by one bitwise AND, so a policy can be
changed, and its rules ablated, without reading a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_marks")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition on the measurements. ``bit`` never changes once given."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "upper_case", "n_words > 0 AND 2 * n_upper_words > n_words"),
    Rule(5, "marks", "2 * n_marks > n_words"),
    Rule(6, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: 1 << r.bit for r in rules}
        return sum(bits[n] for n in self.rules)


BASE = Policy("base-1", ("too_few_words", "repeated_words"))
PRODUCTION = Policy("production-1", tuple(r.name for r in RULES))


def repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    v = len(ids)
    if v == n:
        return 0
    pair = w[:-1] * v + w[1:]
    if v > 2_000_000:  # v ** 3 would not fit
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair[:-1] * v + w[2:]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES; all 0 for a null or empty text."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated(words),
        sum(map(bytes.isupper, words)),
        text.count("!") + text.count("?"),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure(t.as_py()) for t in b.column("_text")]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays([b.column("_row"), *columns], names=["_row", *("_m_" + m for m in MEASURES)])


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: list[str] | None = None, out: str = "ledger") -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct ``out``: the measurements and ``fail_bits``.

    A null text is measured as an empty one. Any column of ``docs`` named ``out`` is replaced; all
    others may have any name. Repeated rows are measured each.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != out]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row") if names else F.struct(F.lit(0).alias("_")).alias("_row"), F.col(text_col).alias("_text"))
    schema = T.StructType([packed.schema["_row"], *(T.StructField("_m_" + m, T.LongType()) for m in MEASURES)])
    found = packed.mapInArrow(_measured, schema)
    m = found.select("_row", F.struct(*[F.col("_m_" + x).alias(x) for x in MEASURES]).alias("m"))
    flat = m.select("_row", "m.*")
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules), F.lit(0).cast("long"))
    flat = flat.select("_row", F.struct(*MEASURES, bits.alias("fail_bits")).alias("_ledger"))
    return flat.select(*([f"_row.`{c}`" for c in names]), F.col("_ledger").alias(out))


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES, bits: str | Column = "ledger.fail_bits") -> Column:
    """True where no rule of the policy failed."""
    c = F.col(bits) if isinstance(bits, str) else bits
    return c.bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablation(led: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, bits: str = "ledger.fail_bits") -> DataFrame:
    """Per rule of the policy: version, rule, n_failed, n_only (documents that this rule alone rejects),
    n_kept_without (documents kept if this rule goes), n_rows.

    The rows are first counted by their bits, of which there are at most 2 ** (number of rules).
    """
    mask = policy.mask(rules)
    counts = led.groupBy(F.col(bits).bitwiseAND(F.lit(mask).cast("long")).alias("bits")).count()
    own = [r for r in rules if r.name in policy.rules]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in own])).alias("r")
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0).cast("long"))
    return (
        counts.select("bits", "count", each)
        .groupBy(F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule"))
        .agg(some(has).alias("n_failed"), some(F.col("bits") == F.col("r.bit")).alias("n_only"), some((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit"))).alias("n_kept_without"), F.sum("count").alias("n_rows"))
    )


def keep(docs: DataFrame, policy: Policy = PRODUCTION, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with its columns, of any names. A null or empty text has no words and goes; a very
    long one is measured whole; repeated rows go or stay alike; an empty table gives an empty one."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return ledger(row, rules, "text", keep=["row"]).filter(passes(policy, rules)).select("row.*")


def report(docs: DataFrame, policy: Policy = PRODUCTION, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, fail_bits, policy. A null or empty text
    has no words and fails; a very long one is measured whole; repeated rows are measured each."""
    led = ledger(docs, text_col=text_col, keep=[key])
    m = [F.col(f"ledger.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    base = ~passes(BASE)
    return led.select(key, *m, base.alias("base_failed"), (passes(policy) & ~base).alias("kept"), F.col("ledger.fail_bits").alias("fail_bits"), F.lit(policy.version).alias("policy"))
