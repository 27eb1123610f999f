"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order: prefix-compressed entries in compressed blocks, a
sparse index with one entry per block, a Bloom filter over the keys, and a footer. A lookup goes
manifest -> Bloom filter -> binary search of the sparse index -> one block.

    shard  = MAGIC, block..., index, bloom, footer
    block  = zstd(entry...)
    entry  = varint shared key bytes, varint further key bytes, varint value bytes, key bytes, value
    value  = ids as little-endian uint16 (uint32 where the vocabulary needs it)
    index  = zstd of (varint key bytes, first key, varint offset, size, raw size, entries, ids before)...
    footer = FOOTER: index offset, index size, bloom offset, bloom size, entries, ids, id width, crc32, MAGIC

A key is b"" for null, else b"\\x01" and the identifier, big-endian with its sign flipped, or in UTF-8.

Tasks name their files by attempt; only files in the manifest, which holds those of finished tasks, are read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import shared

MAGIC = b"QSST0001"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK_BYTES, SHARD_BYTES, BLOOM_BITS, BLOOM_HASHES = 1 << 18, 1 << 26, 10, 7
MANIFEST = "part int, seq int, path string, first_key binary, last_key binary, n_docs long, n_ids long"


def encode_key(key: int | str | None) -> bytes:
    if key is None:
        return b""
    return b"\x01" + (struct.pack(">Q", key + (1 << 63)) if isinstance(key, int) else key.encode())


def decode_key(key: bytes, text: bool = False) -> int | str | None:
    if not key:
        return None
    return key[1:].decode() if text else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


class Bloom:
    def __init__(self, bits: bytearray):
        self.bits, self.m = bits, len(bits) * 8

    @classmethod
    def sized(cls, n: int) -> Bloom:
        return cls(bytearray(max(8, n * BLOOM_BITS // 8 + 1)))

    def _places(self, key: bytes) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key)
        a, b = h & (1 << 64) - 1, h >> 64 | 1
        return [(a + i * b) % self.m for i in range(BLOOM_HASHES)]

    def add(self, key: bytes) -> None:
        for p in self._places(key):
            self.bits[p >> 3] |= 1 << (p & 7)

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class Writer:
    """Writes one shard to a binary stream; keys come in ascending order, equal keys may repeat."""

    def __init__(self, stream, width: int):
        self.out, self.width, self.at = stream, width, 0
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.block, self.raw, self.last = [], 0, b""
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.n = self.in_block = self.ids = self.block_ids = 0
        self.block_key = self.first = None
        self._write(MAGIC)

    def _write(self, b: bytes) -> None:
        self.out.write(b)
        self.at += len(b)

    def add(self, key: bytes, value: bytes) -> None:
        if self.first is None:
            self.first = key
        if self.block_key is None:
            self.block_key, self.last = key, b""
            self.block_ids = self.ids
        shared_bytes = 0
        for x, y in zip(self.last, key):
            if x != y:
                break
            shared_bytes += 1
        self.block += [_varint(shared_bytes), _varint(len(key) - shared_bytes), _varint(len(value)), key[shared_bytes:], value]
        self.raw += len(value) + len(key) + 6
        self.last = key
        self.n += 1
        self.in_block += 1
        self.ids += len(value) // self.width
        self.keys.append(key)
        if self.raw >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.in_block:
            return
        raw = b"".join(self.block)
        b = self.zstd.compress(raw)
        self.index.append(b"".join([_varint(len(self.block_key)), self.block_key, *map(_varint, (self.at, len(b), len(raw), self.in_block, self.block_ids))]))
        self._write(b)
        self.block, self.raw, self.in_block, self.block_key = [], 0, 0, None

    def close(self) -> None:
        self.flush()
        bloom = Bloom.sized(self.n)
        for k in self.keys:
            bloom.add(k)
        index = self.zstd.compress(b"".join(self.index))
        at = self.at
        self._write(index)
        bits = bytes(bloom.bits)
        self._write(bits)
        self._write(FOOTER.pack(at, len(index), at + len(index), len(bits), self.n, self.ids, self.width, zlib.crc32(index + bits), MAGIC))


class Reader:
    """A shard in a file that can be read at any offset."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = self._at(size - FOOTER.size, FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.n, self.ids, self.width, crc, magic = FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError("not a shard, or cut off")
        index, bits = self._at(index_at, index_size), self._at(bloom_at, bloom_size)
        if zlib.crc32(index + bits) != crc:
            raise ValueError("the shard's index is damaged")
        self.zstd = zstandard.ZstdDecompressor()
        self.bloom, self.keys, self.blocks = Bloom(bytearray(bits)), [], []
        raw, at = self.zstd.decompress(index), 0
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.keys.append(raw[at : at + n])
            at += n
            block = []
            for _ in range(5):
                x, at = _read_varint(raw, at)
                block.append(x)
            self.blocks.append(block)

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes, int]]:
        """(key, value, ids before it in the shard) of each entry."""
        offset, size, raw_size, n, before = self.blocks[i]
        raw, at, key = self.zstd.decompress(self._at(offset, size), max_output_size=raw_size), 0, b""
        for _ in range(n):
            s, at = _read_varint(raw, at)
            u, at = _read_varint(raw, at)
            v, at = _read_varint(raw, at)
            key = key[:s] + raw[at : at + u]
            value = raw[at + u : at + u + v]
            at += u + v
            yield key, value, before
            before += v // self.width

    def ids_of(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def __iter__(self) -> Iterator[tuple[bytes, bytes, int]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every entry with this key."""
        if not self.keys or key not in self.bloom:
            return []
        i = max(0, bisect_right(self.keys, key) - 1)
        while i and self.keys[i] == key:  # equal keys may begin in an earlier block
            i -= 1
        found = []
        while i < len(self.keys) and self.keys[i] <= key:
            found += [self.ids_of(v) for k, v, _ in self.block(i) if k == key]
            i += 1
        return found


def _byte_letters() -> dict[int, int]:
    """Byte-level tokenizers write a byte that prints as itself, the others as the letters from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(rest)}


_BYTES = _byte_letters()


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class Encoder:
    """Ids of whole texts, by the tokenizers library, as little-endian uint16 or uint32.

    Where ``split`` says that the tokenizer treats the pieces between spaces and line feeds each by
    itself, as one that drops white space does, pieces are encoded once and kept. Of new pieces in Latin letters,
    which normalising only lower-cases, the words are cut by the tokenizer's own pattern and given
    to its model, each once; other new pieces are encoded whole.
    """

    #: Pieces kept, and characters in them.
    KEPT, KEPT_CHARS = 700_000, 1 << 24

    def __init__(self, path: str, end_id: int, split: bool, width: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.split = Tokenizer.from_file(path), split
        self.model = self.tokenizer.model
        if split:
            self.word = regex.compile(_file(path)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            self.special = regex.compile("|".join(regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.ids, self.words, self.chars = _Numbers(), [], {}, 0
        self.numbers.new = []

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        if piece and (max(piece) >= "\u0180" or "\u0130" in piece or self.special.search(piece)):
            return self._library([piece])[0]
        out = []
        for w in self.word.findall(piece.lower()):
            ids = self.words.get(w)
            if ids is None:
                tokens = self.model.tokenize(w.encode("utf-8").decode("latin-1").translate(_BYTES))
                ids = self.words[w] = np.array([t.id for t in tokens], self.kind).tobytes()
            out.append(ids)
        return b"".join(out)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Per text its ids, the end id last."""
        if not self.split:
            return [x + self.end for x in self._library(texts)]
        if len(self.ids) > self.KEPT or self.chars > self.KEPT_CHARS:
            self._clear()
        number = self.numbers.__getitem__
        found = [list(map(number, t.replace("\n", " ").split(" "))) for t in texts]
        self.ids += map(self._piece, self.numbers.new)
        self.chars += sum(map(len, self.numbers.new))
        self.numbers.new.clear()
        of = self.ids.__getitem__
        return [b"".join(map(of, f)) + self.end for f in found]


_encoders: dict[tuple, Encoder] = {}


def encoder(*args) -> Encoder:
    if args not in _encoders:
        _encoders[args] = Encoder(*args)
    return _encoders[args]


def _file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def drops_space(path: str) -> bool:
    """Whether a tokenizer file never looks across white space, which it drops: it makes white space one space, lower-cases, keeps the
    matches of a pattern without spaces, maps their bytes and gives each to a byte-pair model."""
    t = _file(path)
    steps = (t.get("pre_tokenizer") or {}).get("pretokenizers", [])
    kinds = [x["type"] for x in steps]
    normalizers = [x["type"] for x in (t.get("normalizer") or {}).get("normalizers", [])]
    if kinds != ["Split", "ByteLevel"] or normalizers != ["NFC", "Replace", "Lowercase"] or t["model"]["type"] != "BPE" or t["model"].get("dropout"):
        return False
    replaced = t["normalizer"]["normalizers"][1]
    if replaced["pattern"] != {"Regex": r"\s+"} or replaced["content"] != " ":
        return False
    cut, mapped = steps
    added = all(not x["lstrip"] and not x["rstrip"] and not x["single_word"] and not re.search(r"\s", x["content"]) for x in t.get("added_tokens", []))
    return added and cut["behavior"] == "Removed" and cut["invert"] and not mapped["add_prefix_space"] and not mapped["use_regex"] and r"[^\s\p{L}\p{N}]" in cut["pattern"].get("Regex", "")


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes all of ``docs`` as shards under ``folder`` (a new one in the shared folder by default); gives the manifest.

    ``key`` is an integer or string column, null first. A null text is an empty one: its only id is
    ``end_id``; a very long one is one entry. Rows with equal keys are kept, in the order of their texts. Other columns are not
    looked at; an empty table makes no shard.
    """
    spark = docs.sparkSession
    folder = folder or shared.new_path(spark, "shards")
    split, width = drops_space(tokenizer), 2 if max(end_id + 1, _vocabulary(tokenizer)) <= 1 << 16 else 4
    fs, base = shared.file_system(folder)
    fs.create_dir(base)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id, split, width)
        fs, base = shared.file_system(folder)
        task = TaskContext.get()
        part, attempt, seq, writer, path, size, rows = task.partitionId(), task.taskAttemptId(), 0, None, "", 0, []

        def close():
            writer.close()
            writer.out.close()
            rows.append((part, seq, path, writer.first, writer.last, writer.n, writer.ids))

        for b in batches:
            fs.create_dir(base)
            keys = b.column("_key").to_pylist()
            for lo in range(0, len(keys), 500):
                texts = [t or "" for t in b.column("_text").slice(lo, 500).to_pylist()]
                for k, ids in zip(keys[lo : lo + 500], encode(texts)):
                    if writer and size >= SHARD_BYTES:
                        close()
                        writer, seq = None, seq + 1
                    if writer is None:
                        path, size = f"{base}/part-{part:06d}-{attempt}-{seq:04d}.sst", 0
                        writer = Writer(fs.open_output_stream(path), width)
                    writer.add(encode_key(k), ids)
                    size += len(ids)
        if writer:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["part", "seq", "path", "first_key", "last_key", "n_docs", "n_ids"])

    d = docs.select(F.col(key).alias("_key"), F.col(text_col).alias("_text"))
    if not isinstance(d.schema["_key"].dataType, T.StringType):
        d = d.withColumn("_key", F.col("_key").cast("long"))
    ordered = d.repartitionByRange("_key").sortWithinPartitions("_key", "_text")
    manifest = shared.written(ordered.mapInArrow(shards, MANIFEST), "manifest")
    return with_starts(manifest, folder)


def with_starts(manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest with each shard's first position in the stream of all ids. One row per shard."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn("path", F.concat(F.lit(scheme), "path") if scheme not in ("", "file://") else F.col("path"))


def read(manifest: DataFrame, text_key: bool = False, with_ids: bool = False, key: str = "doc_id") -> DataFrame:
    """Rows (key, start, n_tokens, ids_crc32 and, if asked for, ids) of every document in the shards."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string() if text_key else pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
        names = [key, "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
        for b in batches:
            for row in b.to_pylist():
                fs, path = shared.file_system(row["path"])
                with fs.open_input_file(path) as f:
                    shard = Reader(f)
                    for i in range(len(shard.blocks)):
                        rows = []
                        for k, value, before in shard.block(i):
                            ids = shard.ids_of(value)
                            rows.append((decode_key(k, text_key), row["start"] + before, len(ids), zlib.crc32(ids.tobytes()), *([ids.tolist()] if with_ids else [])))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    spark = manifest.sparkSession
    schema = f"`{key}` {'string' if text_key else 'long'}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    n = max(1, min(manifest.count(), 8 * spark.sparkContext.defaultParallelism))
    return manifest.repartition(n, "path").mapInArrow(entries, schema)


def lookup(manifest: DataFrame, key: int | str | None) -> list[np.ndarray]:
    """The ids of the documents with this key: reads the manifest's matching shards, one block of each."""
    k = encode_key(key)
    found = []
    for row in manifest.filter((F.col("first_key") <= F.lit(k)) & (F.col("last_key") >= F.lit(k))).orderBy("part", "seq").collect():
        fs, path = shared.file_system(row["path"])
        with fs.open_input_file(path) as f:
            found += Reader(f).get(k)
    return found


def report(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all of ``docs``, then gives doc_id, start, n_tokens and ids_crc32 as read back from the shards; nulls, empty, long and
    repeated rows as in ``write``."""
    text_key = isinstance(docs.schema[key].dataType, T.StringType)
    return read(write(docs, tokenizer, end_id, key, text_col), text_key, key=key)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


