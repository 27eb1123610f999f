"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from quire.llm import spelling

rng = random.Random(12)
DOCS = "doc_id long, text string, word string, `a b` string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(docs):
    out = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    form, out = {}, {}
    for w, n in words.items():
        own = [x for x in words if near(w, x)]
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = len(own)
    rows = []
    for w, n in words.items():
        r = w
        while form[r] is not None:
            r = form[r]
        rows.append((w, form[w], r, n, out[w], words[form[w]] if form[w] else None))
    return sorted(rows)


def vocabulary():
    base = ["colour", "centre", "aaaaa", "aaaaaa", "ababab", "naïveté", "straße", "Ünïted", "x" * 40, "tionstion"] + ["".join(rng.choice("abé") for _ in range(rng.choice([5, 6, 7, 8]))) for _ in range(60)]
    out = set(base)
    for w in base:
        for _ in range(4):
            i = rng.randrange(len(w))
            out |= {w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]}
    return sorted(out)


@pytest.mark.parametrize("heavy", [spelling.HEAVY, 1])
def test_against_plain_python(spark, monkeypatch, heavy):
    monkeypatch.setattr(spelling, "HELD", 50)
    monkeypatch.setattr(spelling, "SLICE", 300)
    words = vocabulary()
    docs = [(i, rng.choice([" ", "1", "×" if i % 2 else ", ", "—"]).join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, [1 + k % 7 * (k % 5) for k in range(len(words))], k=rng.choice([1, 20, 200])))) for i in range(120)]
    docs += [(500, None), (501, ""), (None, "centre centre centre"), docs[3], docs[3], (3, "other words"), (502, "Œuvre ßßßßß ÀÀÀÀÀ ààààà ßßßßß ßßßßß" * 3), (503, " ".join(rng.choices(words, k=30_000)))]
    d = spark.createDataFrame([(i, t, "w", "x") for i, t in docs], DOCS).repartition(3)
    want = counts(docs)
    got = sorted(map(tuple, spelling.variants(spelling.word_counts(d), heavy=heavy).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert got == brute(want) and any(r[1] is not None and r[2] != r[1] for r in got)


def test_empty_tables(spark):
    assert spelling.report(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.report(spark.createDataFrame([(1, None, "", "")], DOCS)).count() == 0
    one = spark.createDataFrame([("alone", 3)], "word string, n long")
    assert [tuple(r) for r in spelling.variants(one).collect()] == [("alone", None, "alone", 3, 0, None)]


def test_words_that_share_halves(spark):
    """A bucket of words with one and the same half is partitioned on; no link is lost."""
    words = {"commonpart" + a + b + c: 3 + k for k, (a, b, c) in enumerate((a, b, c) for a in "abcdefg" for b in "abcdefg" for c in "abcdé")}
    words |= {"commonpart" + a + b: 9 for a in "abc" for b in "abc"}
    d = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(d, heavy=8).select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute(words)
