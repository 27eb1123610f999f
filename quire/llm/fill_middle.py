"""Fill-in-the-middle: cuts each text at two line ends and moves its middle to the end.

Lines, and the marks that a text must not hold, are found by one automaton over UTF-8 bytes. A chunk of bytes doesn't know the state
it is entered in, so it gives a function from each possible state to the state it is left in, with the lines and marks counted
on the way. Such functions compose, in any grouping: the chunks of a short text meet in its task, those of a giant one are dealt out,
composed in blocks and then over blocks, and the chunk that holds a cut is selected by the lines before it.

Null texts are empty. Empty texts, and those that hold a mark, stay as they are (form ``plain``). A null key draws as an empty one. Repeated rows are
each a row of their own; rows of one key are cut by the same draws. Columns that are named like a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import shared

MARKS = ("<P>", "<S>", "<M>")
#: States: at a line's start, in a line, behind "<", behind "<" and a mark's letter.
STATES = 4
_PAD = 5  # a class that leaves everything as it is
_CLASS = np.zeros(256, np.uint8)
_CLASS[10] = 1
_CLASS[ord("<")] = 2
_CLASS[[ord(m[1]) for m in MARKS]] = 3
_CLASS[ord(">")] = 4
# next state by state (row) and class (column): other, line feed, "<", letter, ">", padding
_NEXT = np.array([[1, 0, 2, 1, 1, 0], [1, 0, 2, 1, 1, 1], [1, 0, 2, 3, 1, 2], [1, 0, 2, 1, 1, 3]], np.uint8).ravel()
_LINES, _MARKS = np.zeros(24, np.uint32), np.zeros(24, np.uint32)
_LINES[1::6] = 1
_MARKS[3 * 6 + 4] = 1
_EMIT = _LINES | _MARKS << 16
#: Bytes of a chunk, of texts scanned at once, of a piece of a giant text; pieces that are composed in one block.
STRIDE, GROUP, PIECE, BLOCK = 128, 1 << 21, 1 << 16, 256


def scan(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text data[bounds[i]:bounds[i + 1]]: end state, lines ended and marks, each by start state."""
    size = np.diff(bounds)
    rows = -(-size // STRIDE)
    first = np.r_[0, np.cumsum(rows)]
    padded = np.full(first[-1] * STRIDE, _PAD, np.uint8)
    cls = _CLASS[data[bounds[0] : bounds[-1]]]
    for at, n, to in zip((bounds[:-1] - bounds[0]).tolist(), size.tolist(), (first[:-1] * STRIDE).tolist()):
        padded[to : to + n] = cls[at : at + n]
    by_step = np.ascontiguousarray(padded.reshape(-1, STRIDE).T)
    state = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], first[-1], 1)
    counts = np.zeros(state.shape, np.uint32)
    for c in by_step:
        at = state * np.uint8(6) + c
        counts += _EMIT[at]
        state = _NEXT[at]
    return fold(state.T.astype(np.int64), (counts & 0xFFFF).T.astype(np.int64), (counts >> 16).T.astype(np.int64), np.repeat(np.arange(len(size)), rows), len(size))


def fold(f: np.ndarray, lines: np.ndarray, marks: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Composes the functions of each of ``n`` owners in order, neighbours in pairs. Who owns none gets the identity."""
    out = np.repeat(np.arange(STATES)[None], n, 0), np.zeros((n, STATES), np.int64), np.zeros((n, STATES), np.int64)
    while len(owner):
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        left = np.flatnonzero((place % 2 == 0) & np.r_[owner[1:] == owner[:-1], False])
        if not len(left):
            break
        via = f[left]
        lines[left] += np.take_along_axis(lines[left + 1], via, 1)
        marks[left] += np.take_along_axis(marks[left + 1], via, 1)
        f[left] = np.take_along_axis(f[left + 1], via, 1)
        kept = place % 2 == 0
        f, lines, marks, owner = f[kept], lines[kept], marks[kept], owner[kept]
    for o, x in zip(out, (f, lines, marks)):
        o[owner] = x
    return out


def _buffer(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds of the values) of a string or binary array; nulls are empty."""
    a = a.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    if not len(a):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.empty(0, np.uint8), bounds


def _groups(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of values of about GROUP bytes."""
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + GROUP, "right")) - 1)
        yield i, j
        i = j


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


_CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "marks", "first", "past")])


@F.arrow_udf(_CUTS)
def _cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """Lines, marks and the two cuts, in code points, of texts that are scanned in one place."""
    data, bounds = _buffer(text)
    draws = np.stack([one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False)])
    out = np.zeros((4, len(text)), np.int64)
    for i, j in _groups(bounds):
        f, lines, marks = scan(data, bounds[i : j + 1])
        n = lines[:, 0] + (f[:, 0] != 0)
        units = np.sort(draws[:, i:j] % (n + 1), 0)
        out[0, i:j], out[1, i:j] = n, marks[:, 0]
        for k in range(j - i):
            own = data[bounds[i + k] : bounds[i + k + 1]]
            ends = np.flatnonzero(own == 10)
            for c in (0, 1):
                u = units[c, k]
                out[2 + c, i + k] = 0 if not u else _chars(own[: ends[u - 1] + 1] if u <= len(ends) else own)
    return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n", "marks", "first", "past"])


_FUNCTION = "f array<bigint>, lines array<bigint>, marks array<bigint>, chars bigint"


def _function(f: np.ndarray, lines: np.ndarray, marks: np.ndarray, chars) -> list[pa.Array]:
    lists = lambda x: pa.array(list(x), pa.list_(pa.int64()))
    return [lists(f), lists(lines), lists(marks), pa.array(chars, pa.int64())]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, t in zip(b.column("row"), b.column("text").cast(pa.large_binary())):
            whole, parts = t.as_buffer(), 0
            for lo in range(0, whole.size, GROUP):
                cut = [whole.slice(at, min(PIECE, whole.size - at)).to_pybytes() for at in range(lo, min(lo + GROUP, whole.size), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(cut)), pa.array(range(parts, parts + len(cut)), pa.int64()), pa.array(cut, pa.binary())], names=["row", "part", "bytes"])
                parts += len(cut)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, bounds = _buffer(b.column("bytes"))
        for i, j in _groups(bounds):
            chars = [_chars(data[p:q]) for p, q in zip(bounds[i:j].tolist(), bounds[i + 1 : j + 1].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("row").slice(i, j - i), b.column("part").slice(i, j - i), *_function(*scan(data, bounds[i : j + 1]), chars)], names=["row", "part", "f", "lines", "marks", "chars"])


def _in_order(t: pa.Table, by: str):
    t = t.sort_by(by).combine_chunks()
    tables = [np.array(t.column(c).to_pylist(), np.int64).reshape(-1, STATES) for c in ("f", "lines", "marks")]
    return t, tables, np.array(t.column("chars").to_pylist(), np.int64)


def _block(t: pa.Table) -> pa.Table:
    """The function of one block of pieces."""
    t, tables, chars = _in_order(t, "part")
    made = fold(*tables, np.zeros(len(chars), np.int64), 1)
    return pa.Table.from_arrays([t.column("row").slice(0, 1), t.column("block").slice(0, 1), *_function(*made, [int(chars.sum())])], names=["row", "block", "f", "lines", "marks", "chars"])


def _entries(tables: list[np.ndarray], chars: np.ndarray, state: int) -> tuple[np.ndarray, ...]:
    """Of functions in order that are entered in ``state``: each one's start state, lines, and lines, marks and characters before it; and the end's state and sums."""
    f, lines, marks = tables
    states = [state]
    for g in f:
        states.append(int(g[states[-1]]))
    at = np.arange(len(f)), np.array(states[:-1], np.int64)
    before = lambda x: np.r_[0, np.cumsum(x)]
    return np.array(states), before(lines[at]), before(marks[at]), before(chars)


def _over_blocks(t: pa.Table) -> pa.Table:
    """Where each block of a text begins, and the text's lines and marks."""
    t, tables, chars = _in_order(t, "block")
    states, lines, marks, at = _entries(tables, chars, 0)
    k = len(chars)
    n = int(lines[-1] + (states[-1] != 0))
    return pa.Table.from_arrays([t.column("row"), t.column("block"), pa.array(states[:k]), pa.array(lines[:k]), pa.array(at[:k]), pa.array([n] * k), pa.array([int(marks[-1])] * k), pa.array([int(at[-1])] * k)], names=["row", "block", "state", "lines_before", "chars_before", "n", "n_marks", "n_chars"])


def _over_pieces(t: pa.Table) -> pa.Table:
    """Where each piece of a block begins."""
    t, tables, chars = _in_order(t, "part")
    _, lines, _, at = _entries(tables, chars, t.column("state")[0].as_py())
    lines, at = lines + t.column("lines_before")[0].as_py(), at + t.column("chars_before")[0].as_py()
    return pa.Table.from_arrays([t.column("row"), t.column("part"), pa.array(lines[:-1]), pa.array(lines[1:]), pa.array(at[:-1])], names=["row", "part", "lines_before", "lines_past", "chars_before"])


@F.arrow_udf(T.LongType())
def _line_end(piece: pa.Array, line: pa.Array) -> pa.Array:
    """Code points up to the end of a piece's ``line``-th line."""
    data, bounds = _buffer(piece)
    own = (data[p:q] for p, q in zip(bounds[:-1], bounds[1:]))
    return pa.array([_chars(x[: np.flatnonzero(x == 10)[k - 1] + 1]) for x, k in zip(own, line.to_pylist())], pa.int64())


def giant_cuts(texts: DataFrame) -> DataFrame:
    """(row, n, marks, first, past) of texts (row, one, two, text) that are dealt out in pieces; ``row`` is their own name."""
    pieces = shared.written(texts.select("row", "text").mapInArrow(_pieces, "row string, part bigint, bytes binary").repartition("row", "part"), "fim-pieces")
    block = F.expr(f"part div {BLOCK}")
    sums = shared.written(pieces.mapInArrow(_scanned, f"row string, part bigint, {_FUNCTION}").withColumn("block", block), "fim-functions")
    blocks = sums.groupBy("row", "block").applyInArrow(_block, f"row string, block bigint, {_FUNCTION}")
    tops = shared.written(blocks.groupBy("row").applyInArrow(_over_blocks, "row string, block bigint, state bigint, lines_before bigint, chars_before bigint, n bigint, n_marks bigint, n_chars bigint"), "fim-blocks")
    parts = sums.join(tops.select("row", "block", "state", "lines_before", "chars_before"), ["row", "block"]).groupBy("row", "block").applyInArrow(_over_pieces, "row string, part bigint, lines_before bigint, lines_past bigint, chars_before bigint")
    whole = tops.filter("block = 0").select("row", "n", "n_marks", "n_chars").join(texts.select("row", "one", "two"), "row")
    one, two = F.col("one") % (F.col("n") + 1), F.col("two") % (F.col("n") + 1)
    whole = whole.select("row", "n", "n_marks", "n_chars", F.least(one, two).alias("u_first"), F.greatest(one, two).alias("u_past"))
    wanted = whole.select("row", F.explode(F.array("u_first", "u_past")).alias("unit")).distinct()
    found = parts.join(wanted, "row").filter("lines_before < unit AND unit <= lines_past")
    at = found.join(pieces, ["row", "part"]).select("row", "unit", (F.col("chars_before") + _line_end(F.col("bytes"), F.col("unit") - F.col("lines_before"))).alias("at"))
    at = at.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("unit", "at"))).alias("at"))  # two at most
    cut = lambda u: F.when(F.col(u) == 0, 0).otherwise(F.coalesce(F.try_element_at("at", F.col(u)), F.col("n_chars")))
    return whole.join(at, "row", "left").select("row", "n", F.col("n_marks").alias("marks"), cut("u_first").alias("first"), cut("u_past").alias("past"))


def draw(key: Column, k: int, seed: str) -> Column:
    """The k-th 32-bit number that a key draws."""
    of = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(of, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 100, spm: int = 50, seed: str = "7", giant: int = PIECE) -> DataFrame:
    """``docs`` with n (lines), form (plain, psm, spm), prefix_chars, middle_chars and output.

    rate, spm: of 100 texts, those that are changed, and those of them that begin with the suffix. giant: bytes from which a text is dealt
    out in pieces; it changes no result.
    """
    packed = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"), F.struct("*").alias("doc"))
    packed = packed.select("*", draw(F.col("key"), 1, seed).alias("one"), draw(F.col("key"), 2, seed).alias("two"))
    small = packed.filter(F.octet_length("text") <= giant).withColumn("cut", _cuts("text", "one", "two"))
    big = packed.filter(F.octet_length("text") > giant)
    if big.limit(1).count():
        big = shared.written(big.withColumn("row", F.expr("uuid()")), "fim-giants")  # written once, so that the names stay
        cuts = giant_cuts(big)
        small = small.unionByName(big.join(cuts.select("row", F.struct("n", "marks", "first", "past").alias("cut")), "row").drop("row"))
    plain = (F.col("text") == "") | (F.col("cut.marks") > 0) | (draw(F.col("key"), 3, seed) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(F.col("key"), 4, seed) % 100 < spm, "spm").otherwise("psm")
    f = small.select("doc", "text", "cut", form.alias("form"))
    prefix, suffix = F.expr("substring(text, 1, int(cut.first))"), F.expr("substring(text, int(cut.past) + 1)")
    middle = F.expr("substring(text, int(cut.first) + 1, int(cut.past - cut.first))")
    p, s, m = map(F.lit, MARKS)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    changed = F.col("form") != "plain"
    made = {"n": F.col("cut.n"), "form": F.col("form"), "prefix_chars": F.when(changed, F.col("cut.first")), "middle_chars": F.when(changed, F.col("cut.past") - F.col("cut.first")), "output": output}
    own = [F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in made]
    return f.select(*own, *[v.alias(k) for k, v in made.items()])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    part = F.split(output, "|".join(MARKS), -1)
    at = lambda i: F.get(part, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, and the hashes of the output and of the text rebuilt from it."""
    t = transform(docs.select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
