"""Plain Python models of the operators, for small inputs."""

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def decontamination(docs, items, n=10):
    """docs, items: (id, text). Rows (doc_id, n_words, n_hit, n_items, sha, contaminated)."""
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    wins = {}
    for i, t in items:
        x = w(t)
        if i is None or not x:
            continue
        for s in range(max(1, len(x) - n + 1)):
            wins.setdefault(tuple(x[s : s + n]), set()).add(str(i))
    lens = {len(k) for k in wins}
    out = []
    for i, t in docs:
        x, hit, ids = w(t), set(), set()
        for m in lens:
            for s in range(len(x) - m + 1):
                if (g := tuple(x[s : s + m])) in wins:
                    hit.update(range(s, s + m))
                    ids |= wins[g]
        out.append((i, len(x), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def quality(t):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = t or ""
    w = plain_words(t)
    lines, seen, dup = [x for x in t.split("\n") if plain_words(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = list(zip(w, w[1:], w[2:]))
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def mixing_targets(sizes, cap=3):
    """sizes: source -> size. source -> target."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        rest, ws = total - sum(fixed.values()), sum(w[s] for s in open_)
        over = [s for s in open_ if rest * w[s] > cap * sizes[s] * ws]
        if not over:
            return fixed | {s: rest * w[s] / ws for s in open_}
        fixed |= {s: cap * sizes[s] for s in over}


def shingles(t, n=4):
    w = plain_words((t or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def components(docs, n=4, num=85):
    """docs: (id, text). id -> smallest id reachable by links."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                p, q = find(sets[a][0]), find(sets[b][0])
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}
