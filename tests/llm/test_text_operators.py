"""Decontamination, quality rules, mixing and the classifier against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from quire.llm import decontaminate, mixing, quality_classifier, quality_rules

DOCS = "doc_id long, text string, source string, w string, ledger string"
rng = random.Random(4)


def corpus(n=80):
    words = ["alpha", "Beta", "gamma", "dELTA", "été", "x9", "über", "no"]
    out = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 30, 80])))
        t = t.replace(" no ", rng.choice([" no. ", "\nno, ", " - no! ", "\t"]))
        out.append((i, t, rng.choice(["a", "b", "é", None]), "w", "l"))
    return [*out, (900, None, None, None, None), (901, "", "b", None, None), (None, "alpha beta", "a", None, None), out[3], out[3], (5, "other text", "b", None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def key(r):
    return repr(r)


@pytest.mark.parametrize("max_set", [50_000, 2])
def test_decontamination(spark, rows, max_set):
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) >= 30]
    items = [(1, " ".join(texts[0].split()[5:20])), (2, " ".join(texts[1].split()[:12])), (10, "Unseen words are not in any of these documents at all"), (3, "x9 x9 über"), (4, None), (5, ""), (None, texts[2]), (6, "BETA"), (7, " ".join(texts[0].split()[5:20]))]
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.report(d, b, max_set=max_set).collect()), key=key)
    want = sorted(brute.decontamination([r[:2] for r in rows], items), key=key)
    assert got == want
    dirty = {(r[0], r[1]) for r, w in zip(rows, brute.decontamination([r[:2] for r in rows], items)) if w[5]}
    kept = decontaminate.decontaminate(d, b, max_set=max_set)
    assert kept.columns == d.columns
    assert sorted(map(tuple, kept.collect()), key=key) == sorted((r for r in rows if (r[0], r[1]) not in dirty), key=key)


def test_decontaminated_spans(spark):
    d = spark.createDataFrame([(1, "- Keep this; one two, THREE four! five"), (2, None), (3, "clean")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(d, b, mode="spans").collect()}
    assert got == {1: "- Keep this; four! five", 2: None, 3: "clean"}
    assert decontaminate.report(d, b.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.report(d.limit(0), b).count() == 0


def test_quality(spark, rows):
    long_text = "line one here\n" * 40 + "end"
    more = [*rows, (1000, long_text, "a", None, None), (1001, "a b c a b c x\n\n a b c", "a", None, None), (1002, "### $$ || ok <b>", "a", None, None), (1003, "é" * 30 + " ü", "a", None, None), (1004, "a b c b c a b c " * 20, "a", None, None)]
    d = spark.createDataFrame(more, DOCS).repartition(3)
    got = sorted((tuple(r)[:8] for r in quality_rules.report(d).collect()), key=key)
    want = []
    for i, t, *_ in more:
        m = brute.quality(t)
        base = m[0] < 50 or 100 * m[4] > 50 * m[0]
        want.append((i, *m, base))
    assert sorted((g[:7] for g in got), key=key) == sorted(want, key=key)
    assert not any(g[7] for g in got if g[6])
    assert quality_rules.report(d.limit(0)).count() == 0


def test_policies_and_ablation(spark, rows):
    d = spark.createDataFrame(rows, DOCS)
    led = quality_rules.ledger(d)
    assert led.columns == ["doc_id", "text", "source", "w", "ledger"] and led.count() == len(rows)
    bits = [r[0] for r in led.select("ledger.fail_bits").collect()]
    p = quality_rules.PRODUCTION
    got = {r["rule"]: r for r in quality_rules.ablation(led, p).collect()}
    for rule in quality_rules.RULES:
        b = 1 << rule.bit
        assert got[rule.name]["n_failed"] == sum(bool(x & b) for x in bits)
        assert got[rule.name]["n_only"] == sum(x == b for x in bits)
        assert got[rule.name]["n_kept_without"] == sum(x in (0, b) for x in bits)
    kept = quality_rules.keep(d)
    assert kept.columns == d.columns and kept.count() == sum(x == 0 for x in bits)


@pytest.mark.parametrize("block", [7, 512])
def test_mixing(spark, rows, block):
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(brute.plain_words(r[1]))
    want = brute.mixing_targets(sizes)
    p = mixing.plan(d, block=block).drop("row_hash").join(d.select("doc_id", "source").distinct(), "doc_id", "left")
    got = mixing.report(d, block=block).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((r[0], len(brute.plain_words(r[1]))) for r in rows if r[0] is not None)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        t = next(s for s in want if sizes[s] == r["source_size"] and abs(want[s] - r["target"]) < 1e-6)
        by[t] = by.get(t, 0) + r["taken"]
    assert all(abs(by[s] - want[s]) <= 1 for s in want)
    again = mixing.report(d.repartition(5), block=block).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    assert p.count() >= len(rows)
    mixed = mixing.mix(d, block=block)
    assert mixed.columns == d.columns
    counts = {tuple(r)[:2]: r["count"] for r in mixed.groupBy("doc_id", "text").count().collect()}
    assert all(c <= 3 * sum(x[0] == k[0] and x[1] == k[1] for x in rows) for k, c in counts.items())
    assert mixing.report(d.limit(0)).count() == 0


def test_caps(spark):
    d = spark.createDataFrame([(1, "a " * 5, "rare"), (2, "b " * 500, "common"), (3, "", "none"), (4, "c " * 40, "middle")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.report(d, block=4).collect()}
    want = brute.mixing_targets({"rare": 5, "common": 500, "none": 0, "middle": 40})
    assert got[1]["target"] == pytest.approx(want["rare"]) and got[2]["target"] == pytest.approx(want["common"]) and got[3]["target"] == 0
    assert got[1]["taken"] == round(want["rare"]) and abs(got[2]["taken"] - want["common"]) <= 1


def test_slots_are_spread(spark):
    """In any stretch of the schedule, sources are near their shares."""
    s = spark.createDataFrame([("a", False, 6000, 6000.0), ("b", False, 3000, 3000.0), ("", True, 1000, 1000.0)], "src string, no_src boolean, source_size long, target double")
    slots = sorted((r["slot"], r["src"]) for r in mixing.schedule(s, 10).collect())
    order = [x for _, x in slots]
    assert len(order) == 1000
    for lo in range(0, 900, 50):
        part = order[lo : lo + 100]
        assert abs(part.count("a") - 60) <= 4 and abs(part.count("b") - 30) <= 4


def test_classifier(spark):
    r = random.Random(8)
    good = ["the", "and", "of", "is", "with", "there", "rest", "in"]
    rows, labels = [], []
    for i in range(400):
        q = i % 3 != 0
        w = [r.choice(good) for _ in range(60)]
        rows.append((i, " ".join(w) + "." if q else " ".join(x.upper() + "!!" for x in w), 7))
        labels.append((i, int(q)))
    rows += [(500, None, 7), (501, "", 7), (None, "the and", 7), rows[0]]
    d = spark.createDataFrame(rows, "doc_id long, text string, score long")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (2, 0)], "doc_id long, quality int")
    got = quality_classifier.report(d, lab).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert len(held) > 60 and sum(truth[x["doc_id"]] == x["predicted"] for x in held) / len(held) > 0.97
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got)
    # held-out labels don't matter
    import zlib

    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    other = quality_classifier.report(d, spark.createDataFrame([*flipped, (2, 0)], "doc_id long, quality int")).collect()
    assert {x["doc_id"]: x["score"] for x in other} == {x["doc_id"]: x["score"] for x in got}
    nothing = quality_classifier.report(d, lab.limit(0)).collect()
    assert all(x["score"] == 0.5 for x in nothing)
    assert quality_classifier.report(d.limit(0), lab).count() == 0


def test_bounded_sample(spark):
    d = spark.createDataFrame([(i, "some text") for i in range(50)], "doc_id long, text string")
    lab = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert isinstance(quality_classifier.train(d, lab, max_train=5), quality_classifier.Model)


def test_decontamination_of_large_benchmarks(spark):
    """Half a million windows: sent as a table of hashes, or joined; the texts aren't written, and both give the same."""
    from pyspark.sql import functions as F

    n = 50_000
    item = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.concat(F.lit("b"), (F.col("id") * 20 + k).cast("string"))), " ")
    b = spark.range(n).select(F.col("id").alias("item_id"), item.alias("text"))
    doc = lambda i: " ".join(f"d{i}x{k}" for k in range(30)) + (" " + " ".join(f"b{i * 20 + k}" for k in range(5, 15)) if i % 3 == 0 else "") + " tail"
    d = spark.createDataFrame([(i, doc(i)) for i in range(60)], "doc_id long, text string")
    want = [(i, 31 + 10 * (i % 3 == 0), 10 * (i % 3 == 0), int(i % 3 == 0)) for i in range(60)]
    for most in (2_000_000, 1000):
        got = decontaminate.report(d, b, max_set=most).orderBy("doc_id").select("doc_id", "n_words", "n_hit", "n_items").collect()
        assert [tuple(r) for r in got] == want


def test_mixing_takes_what_plain_python_takes(spark):
    """What is taken of each document, and which source each slot belongs to, against a plain model of the schedule."""
    import random

    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 400)))) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    block = 64
    plan = {r["doc_id"]: r for r in mixing.plan(d, block=block).collect()}
    source = {i: s for i, s, _ in rows}
    size = {}
    for i, s, t in rows:
        size[s] = size.get(s, 0) + len(t.split())
    goal = {s: round(t) for s, t in brute.mixing_targets(size).items()}
    for s in size:
        buckets = 1
        docs = sorted((i for i in plan if source[i] == s), key=lambda i: (plan[i]["row_hash"] % buckets, plan[i]["row_hash"], plan[i]["size"], i))
        words = [i for i in docs for _ in range(plan[i]["size"])]
        taken = dict.fromkeys(docs, 0)
        for k in range(goal[s]):  # word by word, round and round
            taken[words[k % len(words)]] += 1
        # whole blocks go first, so within a document at the end of the target, words may come from another place of the same round
        assert {i: plan[i]["taken"] for i in docs} == taken, s
    sources = mixing.targets(spark.createDataFrame([(s or "", s is None, n) for s, n in size.items()], "src string, no_src boolean, size long"))
    slots = [(r["src"], r["no_src"]) for r in mixing.schedule(sources, block).orderBy("slot", "no_src", "src", "k").collect()]
    order = sorted((s or "", s is None) for s in size if s is not None) + ([("", True)] if None in size else [])
    total, upto, hi = sum(goal.values()), 0, []
    for s, none in order:
        upto += goal[None if none else s]
        hi.append(round(upto / total * 2**31))
    need = {(s, none): -(-goal[None if none else s] // block) for s, none in order}
    count, want, i = dict.fromkeys(order, 0), [], 0
    while len(want) < len(slots) // 2:
        x = (i + 1) * mixing.STEP % 2**31
        s = next(o for o, h in zip(order, hi) if x < h)
        if count[s] < need[s]:
            count[s] += 1
            want.append(s)
        i += 1
    assert slots[: len(want)] == want


def test_no_source_of_the_mix_falls_to_nothing(spark):
    long = " ".join("w" for _ in range(1000))
    rows = [(i, "a", long) for i in range(20)] + [(100, "b", " ".join("w" for _ in range(40_000)))]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = [r["source"] for r in mixing.mix(d, weights=(60, 1)).collect()]
    assert kept.count("b") == 1 and kept.count("a") > 20
    named = spark.createDataFrame([(1, "a", long, 7, "x")], "doc_id long, source string, text string, _copies int, _row_hash string")
    assert [tuple(r)[3:] for r in mixing.mix(named).collect()] == [(7, "x")]


def test_ftrl_against_a_plain_one():
    import math
    import random

    import numpy as np

    rng = random.Random(9)
    rows = []
    for _ in range(60):
        y = rng.randrange(2)
        idx = sorted(rng.sample(range(50), 6))
        rows.append((np.array(idx, np.int32), np.array([rng.random() + (0.5 if y and i < 10 else 0) for i in idx], np.float32), y))
    m = quality_classifier.ftrl(rows, epochs=3)
    z, n = {}, {}
    bias = 1 << quality_classifier.BITS

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= 0.02 else (math.copysign(0.02, zi) - zi) / ((1.0 + math.sqrt(n.get(i, 0.0))) / 0.5 + 0.02)

    for _ in range(3):
        for idx, v, y in rows:
            x = {**dict(zip(idx.tolist(), map(float, v))), bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i]
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / 0.5 * w[i]
                n[i] = n.get(i, 0.0) + g * g
    assert all(abs(m.weights[i] - weight(i)) < 1e-5 for i in range(50)) and abs(m.bias - weight(bias)) < 1e-6


def test_rules_keep_columns_of_any_name(spark):
    text = " ".join(f"word{i}" for i in range(60))
    d = spark.createDataFrame([(1, text, "a", "b", "c"), (2, None, "a", "b", "c"), (3, "w " * 400_000, "a", "b", "c")], "doc_id long, text string, ledger string, _own_ledger string, row string")
    kept = quality_rules.keep(d)
    assert kept.columns == d.columns and [tuple(r)[0:1] + tuple(r)[2:] for r in kept.collect()] == [(1, "a", "b", "c")]
