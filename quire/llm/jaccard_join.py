"""Similarity join of word n-gram sets by Jaccard, exact, with signature trees.

1. Equal sets are one: each document gets the hash of its set.
2. A set can only link if at least t |x| of its shingles are in another set too. All shingles are dealt out by hash
   once, counted over distinct sets, and for each set the shared ones are summed. The sets that pass are active.
3. Candidate groups. Two sets that link share one of the first |x| - ceil(t |x|) + 1 shingles of each, in any one order of all
   shingles. Here those that the fewest active sets have come first, then hashes decide: so chance shingles, which get the more common the
   larger the corpus, don't connect all of it. Active sets with such a shingle in common and sizes within t of each other, directly
   or over further ones, form a group.
4. Within a group a signature tree holds in each node the OR of its sets' token bitmaps, their size range and slack
   (size less bits set). Two nodes traverse together, and are left when their greatest possible overlap is
   too small for their smallest sizes, or when all their sets are connected already. Pairs that remain are compared exactly.
5. A group with too many shingles for one task is cut into blocks, and every two blocks meet in a task; the links
   found are joined to components again.

For the components alone (``classes``) only links that connect are needed, so a group of near copies takes about one
comparison a set. ``links`` counts and ``pairs`` gives every link: node pairs are left by the bound alone, and the sets
below two lowest nodes are compared at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import shared
from quire.llm.components import components
from quire.llm.shingles import set_id, sets

LEAF, FANOUT, CHUNK = 16, 8, 256
#: Shingles of the sets in a task, of a bucket, of a shuffle partition of buckets, and of what a task deals out at once.
TASK_SHINGLES, BUCKET_SHINGLES, PARTITION_SHINGLES, FLUSH_SHINGLES = 4_000_000, 1 << 21, 1 << 24, 1 << 19
#: Of active sets, whose number is known, a partition has fewer, as work on them is large next to moving them.
ACTIVE_SHINGLES = 1 << 20
POSTING, RARITY = np.dtype([("g", "<u4"), ("sid", "<i8"), ("n", "<u4")]), np.dtype([("df", "<u4"), ("g", "<u8")])
BROADCAST_ROWS, SEEN, SUMS, MAP_BITS, CACHE_BYTES = 100_000, 200_000, 1 << 19, 1 << 14, 1 << 24
#: Bits of the bitmap of active sets' keys, of which each worker holds one (8 MB).
KEY_BITS = 1 << 26


def prefix_length(size: int, num: int) -> int:
    return size - -(-num * size // 100) + 1


class Tree:
    """A signature tree over sets. ``links`` and ``pairs`` join its sets by a dual traversal of the tree with itself.

    Sets are in the order of their least hash, which similar sets share. A bitmap has about twice as many bits as most sets
    have shingles; of larger sets it holds less, which their slack makes up for.
    """

    def __init__(self, sets: list[np.ndarray], num: int):
        self.num = num
        order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
        self.order, self.sets = order, [sets[i] for i in order]
        n = np.array([len(s) for s in self.sets])
        bits = 1 << int(min(MAP_BITS, max(64, 2 * np.quantile(n, 0.9))) - 1).bit_length()
        maps = np.zeros((len(n), bits // 64), np.uint64)
        for row, s in zip(maps, self.sets):
            flags = np.zeros(bits, np.uint8)
            flags[s & np.uint64(bits - 1)] = 1
            row[:] = np.packbits(flags, bitorder="little").view(np.uint64)
        slack = n - np.bitwise_count(maps).sum(1)
        self.levels = [(maps, n, n, slack)]
        self.each = [1]  # sets below a node, by level
        while len(self.levels[-1][1]) > 1:
            m, lo, hi, sl = self.levels[-1]
            fan = LEAF if len(self.levels) == 1 else FANOUT
            at = np.arange(0, len(lo), fan)
            self.each.append(self.each[-1] * fan)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sl, at)))
        self.root = list(range(len(n)))
        self.met = 0  # pairs of lowest nodes with sets that were compared exactly
        self._labels: np.ndarray | None = None
        self._words: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def union(self, x: np.ndarray, y: np.ndarray) -> None:
        for p, q in zip(x.tolist(), y.tolist()):
            p, q = self.find(p), self.find(q)
            if p != q:
                self.root[max(p, q)] = min(p, q)
                self._labels = None

    def span(self, i: int) -> range:
        """The sets below a lowest node."""
        return range(i * LEAF, min((i + 1) * LEAF, len(self.sets)))

    def connected(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of which pairs of nodes all sets are in one component already."""
        if self._labels is None:
            self._labels = np.array([self.find(k) for k in range(len(self.sets))])
        at = np.arange(0, len(self._labels), self.each[level])
        lo, hi = np.minimum.reduceat(self._labels, at), np.maximum.reduceat(self._labels, at)
        return (lo[x] == hi[x]) & (lo[y] == hi[y]) & (lo[x] == lo[y])

    def possible(self, level: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of which pairs of nodes sets could link, by size range and greatest possible overlap."""
        m, lo, hi, slack = self.levels[level]
        num = self.num
        fits = (100 * hi[left] >= num * lo[right]) & (100 * hi[right] >= num * lo[left])
        for at in range(0, len(left), 4096):
            k = at + np.flatnonzero(fits[at : at + 4096])
            x, y = left[k], right[k]
            most = np.bitwise_count(m[x] & m[y]).sum(1) + np.minimum(slack[x], slack[y])
            fits[k] = (100 + num) * most >= num * (lo[x] + lo[y])
        return fits

    def _leaf_pairs(self, open_only: bool) -> Iterator[tuple[int, int]]:
        """The pairs of lowest nodes with sets that could link, near ones first; with ``open_only`` without those whose sets
        have all been connected by then. Only a chunk of pairs a level is held."""
        one = np.zeros(1, np.int64)
        todo = [(len(self.levels) - 1, one, one)]
        while todo:
            level, x, y = todo.pop()
            if open_only:
                ok = ~self.connected(level, x, y)
                x, y = x[ok], y[ok]
            if len(x) > CHUNK:
                todo.append((level, x[CHUNK:], y[CHUNK:]))
                x, y = x[:CHUNK], y[:CHUNK]
            if level == 1:
                for at in range(0, len(x), 16):
                    p, q = x[at : at + 16], y[at : at + 16]
                    if open_only:
                        ok = ~self.connected(1, p, q)
                        p, q = p[ok], q[ok]
                    yield from zip(p.tolist(), q.tolist())
                continue
            step, below = np.arange(FANOUT), len(self.levels[level - 1][1])
            p = np.repeat(x[:, None] * FANOUT + step, FANOUT, 1).ravel()
            q = np.tile(y[:, None] * FANOUT + step, FANOUT).ravel()
            ok = (p <= q) & (q < below)
            p, q = p[ok], q[ok]
            ok = self.possible(level - 1, p, q)
            p, q = p[ok], q[ok]
            if len(p):
                near = np.argsort(q - p, kind="stable")
                todo.append((level - 1, p[near], q[near]))

    def _held(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(the shingles of a lowest node's sets, which set has which)."""
        if i not in self._words:
            if sum(w.nbytes + a.nbytes for w, a in self._words.values()) > CACHE_BYTES:
                self._words.clear()
            own = [self.sets[k] for k in self.span(i)]
            words = np.unique(np.concatenate(own))
            has = np.zeros((len(own), len(words)), np.uint8)
            for row, s in zip(has, own):
                row[np.searchsorted(words, s)] = 1
            self._words[i] = words, has
        return self._words[i]

    def _met(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, places, shingles in common) of the links between the sets of two lowest nodes, each once."""
        n, left, right = self.levels[0][1], self.span(i), self.span(j)
        x, y = np.repeat(np.array(left), len(right)), np.tile(np.array(right), len(left))
        ok = x < y
        ok[ok] = self.possible(0, x[ok], y[ok])
        if not ok.any():
            return x[:0], x[:0], x[:0]
        self.met += 1
        words, has = self._held(i)
        s = np.concatenate([self.sets[k] for k in right])
        at = np.minimum(np.searchsorted(words, s), len(words) - 1)
        hit = words[at] == s
        starts = np.r_[0, np.cumsum(n[right.start : right.stop])[:-1]]
        common = np.add.reduceat(has[:, at] * hit.view(np.uint8), starts, axis=1, dtype=np.int64).ravel()
        ok &= 100 * common >= self.num * (n[x] + n[y] - common)
        return x[ok], y[ok], common[ok]

    def links(self) -> list[int]:
        """For each set, in the order given, the place of the first set of its component. Sets that are connected already aren't
        compared, so a group of near copies takes about one meeting of nodes a node."""
        if len(self.sets) > 1:
            for i, j in self._leaf_pairs(True):
                x, y, _ = self._met(i, j)
                self.union(x, y)
        return self.firsts()

    def firsts(self) -> list[int]:
        out = [0] * len(self.sets)
        for place, original in enumerate(self.order):
            out[original] = self.order[self.find(place)]
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Every link once: (places, places, shingles in common), in batches, by the order given. Joins the sets, too."""
        order = np.array(self.order)
        if len(order) < 2:
            return
        for i, j in self._leaf_pairs(False):
            x, y, common = self._met(i, j)
            if len(x):
                self.union(x, y)
                yield order[x], order[y], common


def _set_rows(docs: DataFrame, n: int, key: str, text_col: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(len(s), set_id(s)) for s in sets(b.column("_text"), n)]
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("th"), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["_k", "th", "n", "sid"])

    d = docs.select(F.col(key).alias("_k"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("_text"))
    return d.mapInArrow(rows, f"_k {docs.schema[key].dataType.simpleString()}, th long, n long, sid long")


def _flushed(found: Iterator[tuple[int, np.ndarray]], most: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(ids, arrays) of items gathered until they have ``most`` numbers."""
    ids, own, size = [], [], 0
    for i, s in found:
        ids.append(i)
        own.append(s)
        size += len(s)
        if size >= most:
            yield ids, own
            ids, own, size = [], [], 0
    if own:
        yield ids, own


def _dealt(df: DataFrame, buckets: int, shingles: int) -> DataFrame:
    """Rows (bucket, rows) by bucket; a shuffle partition has several buckets, of a bounded number of shingles together."""
    return df.repartition(max(12, min(buckets, -(-shingles // PARTITION_SHINGLES), 100_000)), "bucket").sortWithinPartitions("bucket")


def _packed(found: Iterator[tuple[int, np.ndarray]], buckets: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, rows) of (set id, shingles): a bucket gets, packed, each set's id, its number of shingles there and their low bits."""
    for ids, own in _flushed(found, FLUSH_SHINGLES):
        g, sid = np.concatenate(own), np.array(ids, np.int64)
        of = np.repeat(np.arange(len(own), dtype=np.int32), [len(s) for s in own])
        where = ((g >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        g, of, where = g.astype(kind)[order], of[order], where[order]
        at = np.append(np.flatnonzero(np.r_[True, where[1:] != where[:-1]]), len(where))
        blobs = []
        for p, q in zip(at[:-1], at[1:]):
            x = of[p:q]
            edge = np.append(np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), len(x))
            blobs.append(b"".join([len(edge[1:]).to_bytes(4, "little"), sid[x[edge[:-1]]].tobytes(), np.diff(edge).astype("<u4").tobytes(), g[p:q].tobytes()]))
        yield pa.RecordBatch.from_arrays([pa.array(where[at[:-1]]), pa.array(blobs, pa.binary())], names=["bucket", "rows"])


def _unpacked(held: list, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set ids, shingles of each, shingles) of a bucket."""
    sids, counts, grams = [], [], []
    for x in held:
        m = int.from_bytes(bytes(x[:4]), "little")
        sids.append(np.frombuffer(x, "<i8", m, 4))
        counts.append(np.frombuffer(x, "<u4", m, 4 + 8 * m))
        grams.append(np.frombuffer(x, kind, -1, 4 + 12 * m))
    sid, count, g = np.concatenate(sids), np.concatenate(counts), np.concatenate(grams)
    first = np.zeros(len(sid), bool)  # copies met in other tasks count once
    first[np.unique(sid, return_index=True)[1]] = True
    return sid[first], count[first], g[np.repeat(first, count)]


def _shared_counts(docs: DataFrame, n: int, total: int, text_col: str) -> DataFrame:
    """Rows (sid, shared): of each set, how many shingles another set has too, never too few. total: shingles of all sets.

    What is held at once is bounded by shingles, on either side of the shuffle.
    """
    buckets = max(12, -(-total // BUCKET_SHINGLES))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def new() -> Iterator[tuple[int, np.ndarray]]:
            for b in batches:
                for s in sets(b.column("_text"), n):
                    i = set_id(s)
                    if i is not None and i not in seen:
                        if len(seen) > SEEN:
                            seen.clear()
                        seen.add(i)
                        yield i, s

        yield from _packed(new(), buckets, "<u4")

    def counted(held: list) -> tuple[np.ndarray, np.ndarray]:
        sid, count, g = _unpacked(held, "<u4")
        order = np.argsort(g, kind="stable")
        s = g[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        n_shared = np.bincount(np.repeat(np.arange(len(sid), dtype=np.int32), count)[order[twice]], minlength=len(sid))
        return sid[n_shared > 0], n_shared[n_shared > 0]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a set and task, not one a bucket, as long as there are few enough."""
        sids, counts, size = [], [], 0

        def sums() -> tuple[np.ndarray, np.ndarray]:
            sid, of = np.unique(np.concatenate(sids), return_inverse=True)
            return sid, np.bincount(of, np.concatenate(counts)).astype(np.int64)

        for sid, n_shared in _by_bucket(counted)(batches):
            sids.append(sid)
            counts.append(n_shared)
            size += len(sid)
            if size > SUMS:
                sid, n_shared = sums()
                if 2 * len(sid) > SUMS:
                    yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(n_shared)], names=["sid", "shared"])
                    sid, n_shared = sid[:0], n_shared[:0]
                sids, counts, size = [sid], [n_shared], len(sid)
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums()], names=["sid", "shared"])

    spread = docs.select(F.col(text_col).alias("_text")).mapInArrow(dealt, "bucket long, rows binary")
    return _dealt(spread, buckets, total).mapInArrow(summed, "sid long, shared long").groupBy("sid").agg(F.sum("shared").alias("shared"))


def _by_bucket(each):
    """Gathers a sorted partition's rows by bucket; gives what ``each`` makes of the packed rows of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator:
        held, now = [], None
        for b in batches:
            for k, r in zip(b.column("bucket").to_pylist(), b.column("rows")):
                r = memoryview(r.as_buffer())
                if k != now and held:
                    yield each(held)
                    held = []
                now = k
                held.append(r)
        if held:
            yield each(held)

    return run


def _rarity(held: list) -> pa.RecordBatch:
    """Of each set of a bucket (sid, alone, rows): how many of its shingles there no other set has, and the others with how many sets have them."""
    sid, count, g = _unpacked(held, "<u8")
    order = np.argsort(g, kind="stable")
    s = g[order]
    at = np.append(np.flatnonzero(np.r_[True, s[1:] != s[:-1]]), len(s))
    rows = np.empty(len(g), RARITY)
    rows["g"], rows["df"][order] = g, np.repeat(np.diff(at), np.diff(at))
    more = rows["df"] > 1
    kept = np.bincount(np.repeat(np.arange(len(sid)), count)[more], minlength=len(sid))
    ends = np.r_[0, np.cumsum(kept) * RARITY.itemsize].astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(sid), [None, pa.py_buffer(ends), pa.py_buffer(rows[more].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(sid), pa.array(count.astype(np.int64) - kept), packed], names=["sid", "alone", "rows"])


def _firsts(sid: np.ndarray, alone: np.ndarray, size: np.ndarray, rows: np.ndarray, num: int) -> np.ndarray:
    """Postings of the first shingles of whole sets, the rarest first. A set's rows, of ``size`` shingles each, stand together."""
    at = np.flatnonzero(np.r_[True, sid[1:] != sid[:-1]])
    ids, alone, size = sid[at], np.add.reduceat(alone, at), np.add.reduceat(size, at)
    n = alone + size
    left = prefix_length(n, num) - alone  # shingles of one set are the rarest, and connect nothing
    of = np.repeat(np.arange(len(ids)), size)
    order = np.lexsort((rows["g"], rows["df"], of))
    ok = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) < left[of]
    out = np.empty(int(ok.sum()), POSTING)
    out["g"], out["sid"], out["n"] = (rows["g"][order][ok] & np.uint64(0xFFFFFFFF)).astype(np.uint32), ids[of[ok]], n[of[ok]]
    return out


def _candidates(docs: DataFrame, n: int, num: int, shingles: int, total: int) -> DataFrame:
    """Edges (a, b) between set ids of (sid, _text) that connect the candidate groups. shingles: of all these sets; total: in all prefixes, about."""
    buckets, dealt_to = max(12, -(-total // BUCKET_SHINGLES)), max(12, -(-shingles // BUCKET_SHINGLES))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own() -> Iterator[tuple[int, np.ndarray]]:
            for b in batches:
                for i, s in zip(b.column("sid").to_pylist(), sets(b.column("_text"), n)):
                    if i == set_id(s):  # else another text with the same document id
                        yield i, s

        yield from _packed(own(), dealt_to, "<u8")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[tuple]:
            """Rows of whole sets, as far as they have come."""
            held: tuple = ()
            for b in batches:
                if not b.num_rows:
                    continue
                blob = b.column("rows").cast(pa.large_binary())
                ends = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset : blob.offset + len(blob) + 1]
                rows = np.frombuffer(blob.buffers()[2], RARITY, int(ends[-1] - ends[0]) // RARITY.itemsize, int(ends[0])) if ends[-1] > ends[0] else np.empty(0, RARITY)
                own = (b.column("sid").to_numpy(), b.column("alone").to_numpy(), np.diff(ends) // RARITY.itemsize, rows)
                own = tuple(map(np.concatenate, zip(held, own))) if held else own
                cut = int(np.searchsorted(own[0], own[0][-1]))
                edge = int(own[2][:cut].sum())
                if cut:
                    yield own[0][:cut], own[1][:cut], own[2][:cut], own[3][:edge]
                held = own[0][cut:], own[1][cut:], own[2][cut:], own[3][edge:].copy()
            if held:
                yield held

        for own in whole():
            rows = _firsts(*own, num)
            w = rows["g"].astype(np.int64) % 0xFFFFFFFB % buckets
            order = np.argsort(w, kind="stable")
            rows, w = rows[order], w[order]
            at = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else w
            yield pa.RecordBatch.from_arrays([pa.array(w[at]), pa.array([x.tobytes() for x in np.split(rows, at[1:])][: len(at)], pa.binary())], names=["bucket", "rows"])

    def edges(held: list[bytes]) -> pa.RecordBatch:
        r = np.frombuffer(b"".join(held), POSTING)
        r = r[np.lexsort((r["sid"], r["n"], r["g"]))]
        a, b = r[:-1], r[1:]
        ok = (a["g"] == b["g"]) & (a["sid"] != b["sid"]) & (100 * a["n"].astype(np.int64) >= num * b["n"].astype(np.int64))
        pairs = np.unique(np.stack([a["sid"][ok], b["sid"][ok]], 1), axis=0)
        root: dict[int, int] = {}

        def find(x):
            while (p := root.setdefault(x, x)) != x:
                root[x] = root[p]
                x = root[x]
            return x

        for p, q in pairs.tolist():
            p, q = find(p), find(q)
            if p != q:
                root[max(p, q)] = min(p, q)
        e = [(x, find(x)) for x in list(root) if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in e], pa.int64()), pa.array([y for _, y in e], pa.int64())], names=["a", "b"])

    rare = _dealt(docs.select("sid", "_text").mapInArrow(dealt, "bucket long, rows binary"), dealt_to, shingles).mapInArrow(_by_bucket(_rarity), "sid long, alone long, rows binary")
    rare = rare.repartition(_parts(shingles), "sid").sortWithinPartitions("sid")
    return _dealt(rare.mapInArrow(prefixes, "bucket long, rows binary"), buckets, total).mapInArrow(_by_bucket(edges), "a long, b long")


def _parts(shingles: int) -> int:
    """Partitions of active sets."""
    return max(12, min(-(-shingles // ACTIVE_SHINGLES), 10_000))


def _within(rows: DataFrame, n: int, num: int, parts: int) -> DataFrame:
    """Edges (a, b), a set and the first of its component, found in the groups of rows (comp, i, j, sid, _text)."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        now, out = None, []

        def close():
            if len(held) > 1:
                ids, found = list(held), Tree(list(held.values()), num).links()
                out.extend((ids[x], ids[y]) for x, y in enumerate(found) if x != y)
            held.clear()

        def batch():
            x = pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
            out.clear()
            return x

        for b in batches:
            for comp, i, j, sid, s in zip(*(b.column(c).to_pylist() for c in ("comp", "i", "j", "sid")), sets(b.column("_text"), n)):
                if (comp, i, j) != now:
                    close()
                    now = comp, i, j
                if set_id(s) == sid:  # else another text with the same document id
                    held[sid] = s
            yield batch()
        close()
        yield batch()

    return rows.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(trees, "a long, b long")


def _all_within(rows: DataFrame, n: int, num: int, parts: int, each: bool) -> DataFrame:
    """Of every link in the groups of rows (comp, i, j, own, sid, _text): with ``each`` rows (a, b, common), one a link; else
    rows (a, b, n): a set, the first of its component in the task, and how many links of it are counted there.

    Two sets of one block meet in several tasks; their links count in the first: (0, 1) for block 0, (0, k) for block k.
    """
    names = ["a", "b", "common" if each else "n"]

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        blocks: dict[int, int] = {}
        now = None

        def batch(*cols):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        def close():
            if len(held) > 1:
                ids, tree = np.array(list(held), np.int64), Tree(list(held.values()), num)
                block, total = np.array(list(blocks.values())), np.zeros(len(held), np.int64)
                _, i, j = now
                once = i == j or (i == 0 and j == 1)
                out: list = []
                size = 0
                for x, y, common in tree.pairs():
                    ok = (block[x] != block[y]) | once | ((i == 0) & (block[x] == j))
                    x, y = x[ok], y[ok]
                    if each:
                        out.append((ids[x], ids[y], common[ok]))
                        size += len(x)
                        if size > 100_000:
                            yield batch(*map(np.concatenate, zip(*out)))
                            out, size = [], 0
                    else:
                        np.add.at(total, x, 1)
                        np.add.at(total, y, 1)
                if out:
                    yield batch(*map(np.concatenate, zip(*out)))
                if not each:
                    yield batch(ids, ids[tree.firsts()], total)
            held.clear()
            blocks.clear()

        for b in batches:
            for comp, i, j, own, sid, s in zip(*(b.column(c).to_pylist() for c in ("comp", "i", "j", "own", "sid")), sets(b.column("_text"), n)):
                if (comp, i, j) != now:
                    yield from close()
                    now = comp, i, j
                if set_id(s) == sid:  # else another text with the same document id
                    held[sid], blocks[sid] = s, own
        yield from close()

    return rows.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(trees, ", ".join(f"{x} long" for x in names))


def _joined(ids: DataFrame, reps: DataFrame, links: DataFrame, split: bool, n: int) -> DataFrame:
    """(sid, least) of each set, least the smallest key of its component. links: edges (a, b) to the first of a component in a
    task; split: a component may have come from several tasks; n: sets that can link."""
    if split:
        links = shared.written(components(links).select(F.col("node").alias("a"), F.col("root").alias("b")), "links", rows=n)
    joined = links.select(F.col("a").alias("sid"), F.col("b").alias("root")).union(links.select(F.col("b").alias("sid"), F.col("b").alias("root"))).distinct()
    joined = shared.written(joined.join(reps, "sid").select("sid", "root", "rep"), "joined", rows=n)
    least = joined.groupBy("root").agg(F.min("rep").alias("least"))
    return shared.written(joined.join(least, "root").select("sid", "least"), "found", rows=n)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for a join: to all executors, through the driver, if it has few rows, else never."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


@lru_cache(2)
def _bitmap(path: str) -> np.ndarray:
    """Bits, packed, at the hashes (h) of a table in the shared folder."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    bits = np.zeros(KEY_BITS // 8, np.uint8)
    fs, base = shared.file_system(path)
    for x in fs.get_file_info(FileSelector(base)):
        if x.base_name.endswith(".parquet"):
            with fs.open_input_file(x.path) as f:
                for b in pq.ParquetFile(f).iter_batches(1 << 16, columns=["h"]):
                    h = b.column("h").to_numpy(zero_copy_only=False) & (KEY_BITS - 1)
                    np.bitwise_or.at(bits, h >> 3, np.uint8(1) << (h & 7).astype(np.uint8))
    return bits


def _sieved(d: DataFrame, active: DataFrame) -> DataFrame:
    """Of (_dk, _text) the rows whose key may be one of ``active`` (_k), all of those that are: so that an exact join of many keys moves
    few other texts. A worker reads the keys' hashes from the shared folder, and the driver holds nothing of them."""
    path = shared.written(active.select(F.xxhash64("_k").alias("h")), "active-keys")._quire_path
    schema = d.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bitmap(path)
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False) & (KEY_BITS - 1)
            yield b.select(["_dk", "_text"]).filter(pa.array(bits[h >> 3] >> (h & 7).astype(np.uint8) & np.uint8(1) == 1))

    return d.withColumn("h", F.xxhash64("_dk")).mapInArrow(rows, schema)


def _grouped(docs: DataFrame, n: int, num: int, key: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, bool, int, int]:
    """(rows of ``docs`` with their sets' ids, sets with their smallest keys, the texts of the candidate groups by task, whether
    a group has several tasks, how many sets can link, in how many partitions they are compared)."""
    ids = shared.written(_set_rows(docs, n, key, text_col), "sets")
    reps = shared.written(ids.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("_k").alias("rep"), F.first("n").alias("n")), "reps", rows=ids.count())
    total, n_sets = reps.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    active = _shared_counts(docs, n, total, text_col).join(reps, "sid").filter(f"100 * shared >= {num} * n")
    active = shared.written(active.select("sid", F.col("rep").alias("_k"), F.col("n").alias("_n")), "active", rows=n_sets)
    n_active, shingles, prefixes = active.agg(F.count("*"), *(F.coalesce(F.sum(F.expr(x)), F.lit(0)) for x in ("_n", f"_n * {100 - num} div 100 + 1"))).first()
    d = docs.select(F.col(key).alias("_dk"), F.col(text_col).alias("_text"))
    d = d if n_active <= BROADCAST_ROWS else _sieved(d, active)
    a = _small(active, n_active)
    texts = shared.written(d.join(a, d["_dk"].eqNullSafe(a["_k"])).select("sid", "_n", "_text"), "active-texts")
    groups = shared.written(components(_candidates(texts, n, num, shingles, prefixes), rows=prefixes), "groups", rows=n_active)
    sized = groups.join(active, groups["node"] == active["sid"]).groupBy(F.col("root").alias("comp")).agg(F.expr(f"cast(ceil(sum(_n) / {TASK_SHINGLES}) as int)").alias("blocks"))
    cut = shared.written(groups.join(sized, groups["root"] == sized["comp"]).select("node", "comp", "blocks"), "tasks", rows=n_active)
    split = bool(cut.filter("blocks > 1").limit(1).count())
    cut = cut.withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    cut = cut.withColumn("other", F.explode(F.expr("if(blocks = 1, array(0), filter(sequence(0, blocks - 1), x -> x != own))")))
    cut = cut.select("node", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    cut = cut.hint("merge") if split else _small(cut, n_active)  # as many rows as sets times blocks, which Spark takes for few
    rows = texts.join(cut, texts["sid"] == cut["node"]).select("comp", "i", "j", "own", "sid", "_text")
    return ids, reps, rows, split, n_active, _parts(shingles)


def classes(docs: DataFrame, n: int = 5, num: int = 80, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id, text_hash.

    Two rows link when 100 * intersection >= num * union of their sets of n-word shingles. component_id is
    the smallest key reachable by links. A row without words has an empty set, no links and its own
    key. Rows with equal ids are rows of their own. Keys that are null don't count for the smallest
    unless there are no others.
    """
    ids, reps, rows, split, n_active, parts = _grouped(docs, n, num, key, text_col)
    of_set = _joined(ids, reps, shared.written(_within(rows, n, num, parts), "links"), split, n_active)
    of_set = _small(of_set, n_active)
    of_set = reps.join(of_set, "sid", "left").select("sid", F.coalesce("least", "rep").alias("least"))
    return ids.join(of_set, "sid", "left").select(F.col("_k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "_k").alias("component_id"), F.col("th").alias("text_hash"))


def links(docs: DataFrame, n: int = 4, num: int = 85, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id as in ``classes``, set_id, n_equal, n_links.

    n_equal is how many other rows have an equal set, n_links how many different sets the row's set links to, each
    counted once, whether or not they are connected otherwise. A row without words has set_id null and 0 of both.
    """
    ids, reps, rows, split, n_active, parts = _grouped(docs, n, num, key, text_col)
    found = shared.written(_all_within(rows, n, num, parts, False), "links")
    of_set = _joined(ids, reps, found.filter("a != b").select("a", "b"), split, n_active)
    of_set = reps.join(of_set, "sid", "left").select("sid", F.coalesce("least", "rep").alias("least"))
    equal = ids.filter("sid IS NOT NULL").groupBy("sid").agg((F.count("*") - 1).alias("n_equal"))
    counted = found.groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("n_links"))
    per = shared.written(of_set.join(equal, "sid").join(counted, "sid", "left"), "per-set")
    none = F.lit(0).cast("long")
    return ids.join(per, "sid", "left").select(
        F.col("_k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "_k").alias("component_id"), F.col("sid").alias("set_id"), F.coalesce("n_equal", none).alias("n_equal"), F.coalesce("n_links", none).alias("n_links")
    )


def pairs(docs: DataFrame, n: int = 4, num: int = 85, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (a, b, set_a, set_b, common): every link between two different sets once, by the smallest keys and the ids of
    the sets, with their shingles in common. ``links`` has the set_id of each row. As many rows as there are links."""
    _, reps, rows, *_, parts = _grouped(docs, n, num, key, text_col)
    p = _all_within(rows, n, num, parts, True).select(F.least("a", "b").alias("set_a"), F.greatest("a", "b").alias("set_b"), "common")
    x, y = (reps.select(F.col("sid").alias(f"set_{c}"), F.col("rep").alias(c)) for c in "ab")
    return p.join(x, "set_a").join(y, "set_b").select("a", "b", "set_a", "set_b", "common")


def report(docs: DataFrame, n: int = 4, num: int = 85, **kw) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, as in ``classes``. A null or empty text has no shingles and its own id;
    repeated rows are in one component; other columns are not looked at; an empty table gives no rows."""
    return classes(docs, n, num, **kw).drop("text_hash")


def deduplicate(docs: DataFrame, n: int = 5, num: int = 80, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that with the class's smallest id, of several with this id one.

    Rows without words (null and empty texts) stay, all of them. Rows are packed, so columns may have any names. A very long
    text is a set like others. An empty table gives an empty one.
    """
    c = classes(docs, n, num, key, text_col).filter("n_shingles > 0")
    c = shared.written(c.select(F.col(f"`{key}`").alias("k"), F.col("component_id").alias("c"), F.col("text_hash").alias("th")), "classes")
    gone = c.filter(~F.col("k").eqNullSafe(F.col("c"))).select("k", "th").distinct()
    cols = [F.col(f"`{x}`") for x in docs.columns]
    d = docs.select(F.struct(*cols).alias("r"), F.col(f"`{key}`").alias("dk"), F.xxhash64(f"`{text_col}`").alias("dth"))
    left = d.join(gone, d["dk"].eqNullSafe(gone["k"]) & (d["dth"] == gone["th"]), "left_anti")
    first = c.filter(F.col("k").eqNullSafe(F.col("c"))).groupBy("k").agg(F.count("*").alias("n"), F.min("th").alias("least")).filter("n > 1")
    if first.limit(1).count():  # ids that repeat: one row of each stays
        left = left.join(first, left["dk"].eqNullSafe(first["k"]), "left").filter("n IS NULL OR dth = least")
        left = left.withColumn("once", F.when(F.col("n").isNull(), F.monotonically_increasing_id())).dropDuplicates(["dk", "dth", "once"])
    return left.select("r.*")
