import zlib

import brute
import corpus_pipeline
from quire.llm import shared, token_tables

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = shared.written(stage(spark, docs, SF), f"test-{name}")
        assert out.columns == columns
        rows = out.collect()
        after = [(r["doc_id"], r["text"]) for r in rows]
        assert all(before[i] == t for i, t in after)
        kept = {i for i, _ in after}
        if name == "quality_rules":
            base = {i for i, t in before.items() if (m := brute.quality(t))[0] >= 50 and 100 * m[4] <= 50 * m[0]}
            assert kept <= base and len(kept) > 0.8 * len(base) and len(after) == len(kept)
        if name == "near_duplicates":
            c = brute.components(list(before.items()), 5, 80)
            assert kept == {i for i in before if c[i] == i} and len(after) == len(kept)
        if name == "decontamination":
            assert kept == {w[0] for w in brute.decontamination(list(before.items()), items) if not w[5]}
        if name == "mixing":
            size, by = {}, {}
            for r in docs.collect():
                size[r["source"]] = size.get(r["source"], 0) + len(brute.plain_words(r["text"]))
            for r in rows:
                by[r["source"]] = by.get(r["source"], 0) + len(brute.plain_words(r["text"]))
            longest = max(len(brute.plain_words(t)) for t in before.values())
            assert all(abs(by.get(s, 0) - t) <= longest for s, t in brute.mixing_targets(size).items())
            assert max(sum(i == k for i, _ in after) for k in kept) <= 3
        docs, before = out, dict(after)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()))
    enc = token_tables.Encoder(token_tables.public_tokenizer(), 2, False, 4)
    start, want = 0, []
    for (i, _), ids in zip(texts, enc([t for _, t in texts])):
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(tuple, last)) == sorted(want)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 50


def test_stages_take_any_rows(spark):
    """Nulls in every column, empty, very long and repeated texts, columns with the operators' own names; and an empty table."""
    text = "a text of quite ordinary words number {} that is long enough to be kept by every rule there is, as it has more than fifty words in all, "
    text += "and none of them comes again and again in the same way, nor does it shout, or swear, or hold many signs; it goes on like this for a while, to its end, here."
    rows = [(i, text.format(i * 7919), "en", f"s{i % 3}", 300) for i in range(30)]
    rows += [(None, " ".join(f"own{i} word{i * 7}" for i in range(60)), None, None, None), (40, None, "en", "s1", 0), (41, "", "en", "s1", 0), (3, rows[3][1], "en", "s0", 300), (3, rows[3][1], "en", "s0", 300), (3, text.format("other"), "en", "s0", 1), (50, " ".join(f"w{i}x{i * 31 % 997}" for i in range(60_000)), "de", "s2", 9)]
    extra = "rows int, _k string, _th string, ledger string, _row_hash string, _copies int, r string, k int, n int, ps string, row string, th string"
    d = spark.createDataFrame([(*r, 1, "a", "b", "c", "d", 2, "e", 3, 4, "f", "g", "h") for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    for table in (d, d.limit(0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = shared.written(stage(spark, docs, SF), f"any-{name}")
            assert docs.columns == d.columns, name
        got = docs.collect()
        ids = [r["doc_id"] for r in got]
        assert all(r["ledger"] == "c" and r["rows"] == 1 for r in got)
        if table is d:
            assert {None, 50} <= set(ids) and not {40, 41} & set(ids)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert last.count() == len(got)
        alone = [stage(spark, table, SF).count() for _, stage in corpus_pipeline.STAGES]  # each on its own takes them, too
        assert alone[-1] == table.count()
