"""The licence scan against plain Python, which compares every template with every place."""

import math
import random
import re

import pytest

from quire.llm import licenses

rng = random.Random(13)
DOCS = "doc_id long, text string, row string, label string, `a b` string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEMPLATES = (*licenses.BASE, *licenses.NOTICES)


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs):
    all_words = [words_of(t) for _, t in docs]
    sets = [set(w) for w in all_words]
    out = []
    idf = {x: math.log((1 + len(docs)) / (1 + sum(x in s for s in sets))) + 1 for t in TEMPLATES for x in t.text.split()}
    for (i, _), w in zip(docs, all_words):
        base, labels, best = [], set(), 0.0
        for t in TEMPLATES:
            tw = t.text.split()
            rare = sorted(set(tw), key=lambda x: (-idf[x], x))
            need = set()
            for p in t.phrases or (t.text,):
                at = (" " + t.text)[: (" " + t.text).index(" " + p)].count(" ")
                need |= set(range(at, at + len(p.split())))
            used = [k for k, x in enumerate(tw) if k in need or x in rare[:12]]
            total = sum(round(idf[tw[k]], 6) for k in used)
            for s in range(-len(tw), len(w)):
                there = [k for k in used if 0 <= s + k < len(w) and w[s + k] == tw[k]]
                score = min(1.0, round(sum(round(idf[tw[k]], 6) for k in there) / total, 6))
                anchors = sum(tw[k] in rare[:3] for k in there)
                if need <= set(there) and score >= 0.6 and (t.exact or anchors >= min(2, sum(x in rare[:3] for x in tw))):
                    labels.add(t.label)
                    best = max(best, score)
                    if t.exact:
                        base.append((s, t.label))
        out.append((i, len(w), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), best))
    return sorted(out, key=repr)


def corpus():
    notices = [t.text for t in TEMPLATES] + ["CC BY, cc-by CC. by", "All rights Reserved. All rights reserved!", "GNU General Public License, version 3.", "all rights\nreserved cc", "GENERAL PUBLIC LICENSE general public", "the mit licence", "redistribution and use in source and binary forms, without modification", "Apache License, Version 1.0", "under the Apache License, Version 2.0."]
    filler = ["the", "of", "all", "by", "license", "public", "word", "été", "x9", "rights", "cc", "and"]
    out = []
    for i in range(200):
        parts = [" ".join(rng.choices(filler, k=rng.choice([0, 2, 10]))) for _ in range(3)]
        if rng.random() < 0.7:
            parts.insert(rng.randrange(4), rng.choice(notices).title() if rng.random() < 0.3 else rng.choice(notices))
        t = rng.choice([" ", ". ", "\n"]).join(parts)
        if rng.random() < 0.2:
            w = t.split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        out.append((i, t))
    return [*out, (500, None), (501, ""), (None, "cc by"), out[3], out[3], (3, "all rights reserved"), (502, "--- !!"), (503, "word all rights reserved " * 5000 + "cc by")]


def test_against_plain_python(spark):
    docs = corpus()
    d = spark.createDataFrame([(i, t, "r", "l", "x") for i, t in docs], DOCS).repartition(3)
    got = sorted(map(tuple, licenses.report(d).collect()), key=repr)
    want = brute(docs)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(abs(g[7] - w[7]) < 2e-6 for g, w in zip(got, want))
    assert len({g[6] for g in got}) > 15


def test_empty_tables(spark):
    assert licenses.report(spark.createDataFrame([], DOCS)).count() == 0
    assert tuple(licenses.report(spark.createDataFrame([(1, None, "", "", "")], DOCS)).first()) == (1, 0, 0, None, None, "", "", 0.0)


def test_a_phrase_that_is_not_in_its_template():
    with pytest.raises(ValueError, match="is not in"):
        licenses.postings((licenses.Template("x", "one two", ("three",)),), {"one": 1.0, "two": 1.0})


def test_no_python_on_the_executors(spark):
    plan = licenses.report(spark.createDataFrame([(1, "cc by", "", "", "")], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
