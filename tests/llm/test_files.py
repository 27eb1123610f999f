"""Archives and token shards: exact round trips."""

import base64
import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from quire.llm import token_tables as T
from quire.llm import warc

PAGES = [
    (3, "http://a.example/3", "<p>one</p>"), (1, "http://a.example/1\r\nX: y", "<p>one</p>"), (2, None, ""), (4, "http://b.example/ü", None), (5, "u5", "é" * 40_000), (6, "u6", "<p>one</p>"),
    (None, "u7", "<p>one</p>"), (None, None, "alone"), (8, "u8", "tail\r\n\r\nmore\r\n"), (8, "u8", "tail\r\n\r\nmore\r\n"),
]


def want_pages():
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and f != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


def test_archive(spark):
    d = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    assert sorted(map(tuple, warc.report(d).collect()), key=repr) == want_pages()
    index = warc.write(d)
    assert index.count() == len(PAGES)
    some = index.filter("page_id IN (1, 5, 8)")
    got = warc.read(some, payloads=True, gap=0, most=1000).collect()
    assert sorted((r["page_id"], r["html"]) for r in got) == [(1, "<p>one</p>"), (5, "é" * 40_000), (8, "tail\r\n\r\nmore\r\n"), (8, "tail\r\n\r\nmore\r\n")]
    assert warc.report(d.limit(0)).count() == 0
    small = warc.report(d, min_revisit_bytes=1).filter("payload_bytes = 0").collect()
    assert {r["record_type"] for r in small} == {"response"}


def test_ranges(spark):
    rows = [("f", 0, 10), ("f", 10, 10), ("f", 500, 10), ("g", 0, 5), ("f", 530, 5)]
    r = warc.ranges(spark.createDataFrame(rows, "path string, offset long, length long"), gap=50, most=1000).collect()
    assert sorted((x["path"], x["lo"], x["size"], len(x["members"])) for x in r) == [("f", 0, 20, 2), ("f", 500, 35, 2), ("g", 0, 5, 1)]


def test_damage_is_seen():
    rec = zlib.compressobj(wbits=31)
    raw = warc.record(1, "u", b"payload", warc.base32_sha1(b"other"), None, False, "2024-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        warc.parse(rec.compress(raw) + rec.flush())


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("keys", [[None, -5, 0, 1, 1, 1, 2, 10**12], [], [""], ["a", "a", "ab", "ö"], list(range(3000))])
def test_shard(keys):
    T.BLOCK_BYTES, before = 200, T.BLOCK_BYTES
    try:
        out = File()
        w = T.Writer(out, 2)
        values = [np.arange(i % 7, dtype="<u2").tobytes() for i in range(len(keys))]
        for k, v in zip(keys, values):
            w.add(T.encode_key(k), v)
        w.close()
    finally:
        T.BLOCK_BYTES = before
    r = T.Reader(out)
    text = any(isinstance(k, str) for k in keys)
    got = list(r)
    assert [T.decode_key(k, text) for k, _, _ in got] == keys and [v for _, v, _ in got] == values
    assert [b for _, _, b in got] == [sum(len(v) // 2 for v in values[:i]) for i in range(len(values))]
    for k in set(keys):
        assert [x.tolist() for x in r.get(T.encode_key(k))] == [list(range(i % 7)) for i, x in enumerate(keys) if x == k]
    assert r.get(T.encode_key(987_654_321)) == [] and len(r.blocks) >= min(len(keys), 1)
    if len(keys) == 3000:
        assert sum(T.encode_key(i) in r.bloom for i in range(10_000, 20_000)) < 300


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.public_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


TEXTS = ["Hello, world! It's 2024.", "", None, "  \n\t ", "a<|endoftext|>b", "ÀÉ é̂ Σας İ ẞ", "x" * 5000, "word " * 3000, "I'LL'VE  don't stop now", "日本語 テキスト", "a\x00b\x1cc", "😀 ok"]


def test_encoder():
    e = T.Encoder(T.public_tokenizer(), 2, True, 2)
    assert [np.frombuffer(x, "<u2").tolist() for x in e([t or "" for t in TEXTS])] == library(TEXTS)
    plain = T.Encoder(T.public_tokenizer("byte_bpe_50k.json"), 2, T.drops_space(T.public_tokenizer("byte_bpe_50k.json")), 2)
    assert T.drops_space(T.public_tokenizer()) and not plain.split and plain(["a b"])


def test_encoder_on_whole_documents(spark):
    """All documents of a table get the library's ids."""
    from tokenizers import Tokenizer

    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    t = Tokenizer.from_file(T.public_tokenizer())
    e = T.Encoder(T.public_tokenizer(), 2, True, 2)
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        want = [np.array([*x.ids, 2], "<u2").tobytes() for x in t.encode_batch(part, add_special_tokens=False)]
        assert e(part) == want


def test_encoder_keeps_few_characters():
    e = T.Encoder(T.public_tokenizer(), 2, True, 2)
    e.KEPT_CHARS = 1000
    for i in range(20):
        e([f"{i}" + "漢字" * 300])
    assert e.chars < 3000 and len(e.ids) < 6


def test_other_replacements_go_to_the_library(tmp_path):
    import json

    t = json.loads(open(T.public_tokenizer(), encoding="utf-8").read())
    t["normalizer"]["normalizers"][1]["content"] = "_"
    (tmp_path / "t.json").write_text(json.dumps(t), encoding="utf-8")
    assert T.drops_space(T.public_tokenizer()) and not T.drops_space(str(tmp_path / "t.json"))


def test_archive_columns(spark):
    d = spark.createDataFrame([(1, "u", "x", 5, "y", 2), (2, "u", None, 5, "y", 2)], "page_id int, url string, html string, first int, sha string, n int")
    assert [(r["page_id"], r["record_type"]) for r in warc.report(d).orderBy("page_id").collect()] == [(1, "response"), (2, "response")]
    with pytest.raises(ValueError):
        warc.write(d.withColumn("page_id", d["url"]))


def test_report(spark):
    rows = [(i * 3 - 9, t, 1) for i, t in enumerate(TEXTS)] + [(None, "no id", 1), (0, "again", 1), (0, "again", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(4)
    got = T.report(d, T.public_tokenizer()).collect()
    start, want = 0, []
    for i, t in sorted(((i, t) for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library([t])[0]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    manifest = T.write(d, T.public_tokenizer())
    assert [x.tolist() for x in T.lookup(manifest, 0)] == [*library([TEXTS[3]]), *library(["again"]), *library(["again"])]
    assert T.lookup(manifest, 1) == [] and len(T.lookup(manifest, None)) == 1
    assert T.report(d.limit(0), T.public_tokenizer()).count() == 0
    named = T.report(spark.createDataFrame([("b", "x"), ("a", "y")], "doc_id string, text string"), T.public_tokenizer()).orderBy("start").collect()
    assert [r["doc_id"] for r in named] == ["a", "b"]
