"""Fill-in-the-middle against plain Python, in one place and dealt out."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import fill_middle

rng = random.Random(11)
DOCS = "doc_id long, text string, n string, `a b` string, row string, cut string"


def plain(key, t, rate=100, spm=50):
    t = t or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= rate:
        return n, "plain", None, None, t
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def corpus():
    parts = ["a line", "é ü ß", "\n", "\n\n", "\r", "<", "<P", "P>", "<S>", "\U0001f600", " ", "x" * 300, "<M", " "]
    out = [(i, "".join(rng.choice(parts) + rng.choice(["", "\n", " "]) for _ in range(rng.choice([0, 1, 3, 30, 90]))).replace("<S>", rng.choice(["<S>", "", ""]))) for i in range(150)]
    out += [(500, None), (501, ""), (None, "one\ntwo\nthree\n"), (502, "\n"), (503, "no end"), (504, "<M>"), out[3], out[3], (3, "other\ntext"), (505, "<" * 5000 + "P>"), (506, ("long line é " * 40 + "\n") * 3000)]
    return [(i, t, "n", "ab", "row", "cut") for i, t in out]


@pytest.mark.parametrize("giant", [fill_middle.PIECE, 64])
def test_against_plain_python(spark, monkeypatch, giant):
    monkeypatch.setattr(fill_middle, "PIECE", 64 if giant == 64 else fill_middle.PIECE)
    rows = corpus() if giant != 64 else [r for r in corpus() if len(r[1] or "") < 10_000] + [(900, ("k é\n" * 9 + "z" * 200) * 400, "n", "ab", "row", "cut")]
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    t = fill_middle.transform(d, rate=90, spm=40, giant=giant)
    assert set(t.columns) == set(d.columns) | {"form", "prefix_chars", "middle_chars", "output"}
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"], r["a b"]) for r in t.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()), key=repr)
    assert got == sorted(((r[0], *plain(r[0], r[1], 90, 40), r[1] or "", "ab") for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fill_middle.report(spark.createDataFrame([], DOCS)).count() == 0


def test_functions_compose_in_any_grouping():
    data = np.frombuffer(bytes(rng.choice(b"<PSM>>\n\nab<") for _ in range(20_000)), np.uint8)
    whole = [x[0] for x in fill_middle.scan(data, np.array([0, len(data)]))]
    for cuts in ([1, 2, 3], [127, 128, 129, 9000], sorted(rng.sample(range(20_001), 300))):
        bounds = np.array([0, *cuts, len(data)])
        parts = fill_middle.scan(data, bounds)
        got = fill_middle.fold(*parts, np.zeros(len(bounds) - 1, np.int64), 1)
        assert all((g[0] == w).all() for g, w in zip(got, whole))
    text = data.tobytes().decode()
    assert whole[1][0] == text.count("\n") and whole[2][0] == len(re.findall("<[PSM]>", text))
