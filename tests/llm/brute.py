"""Plain versions of the operators, for small tables."""

from collections import Counter, defaultdict

import numpy as np
import xxhash


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def majority(parts):
    h = np.array([xxhash.xxh64_intdigest(p, 42) for p in parts], np.uint64)
    if not len(h):
        return 0
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def fingerprint(text, width):
    words = [w for w in (text or "").encode().lower().split()]
    return majority([b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else [])


def simhash_groups(texts, width, radius):
    """doc_id to the smallest doc_id of its group."""
    fps, groups = {d: fingerprint(t, width) for d, t in texts.items()}, Union()
    for a in fps:
        groups.find(a)
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                groups.join(a, b)
    return {d: groups.find(d) for d in fps}


def shingle_groups(texts, width=5, least=0.8):
    """doc_id to the smallest doc_id of its group: links are Jaccard similarities of distinct shingles of least or more."""
    words = {d: (t or "").encode().lower().split() for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for d, w in words.items()}
    groups = Union()
    for a in sets:
        groups.find(a)
        for b in sets:
            if a < b:
                both = len(sets[a] & sets[b])
                if both >= least * (len(sets[a]) + len(sets[b]) - both):
                    groups.join(a, b)
    return {d: groups.find(d) for d in sets}


def contaminated(texts, items, width=5, least=0.8):
    """(doc_id, item_id) to the best similarity of any window of the item's size."""
    out = {}
    shingles = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
    for item, text in items.items():
        words = (text or "").lower().split()
        n = len(words)
        k = min(width, n)
        want = shingles(words, k)
        for d, t in texts.items():
            w = (t or "").lower().split()
            for s in range(max(1, len(w) - n + 1) if n and w else 0):
                have = shingles(w[s : s + n], k)
                if not want.keys() & have.keys():
                    continue
                both = sum((want & have).values())
                sim = both / (sum(want.values()) + sum(have.values()) - both)
                if sim >= least:
                    out[d, item] = max(sim, out.get((d, item), 0))
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def normalised(line):
    """Lower case, letters and digits of any script, single spaces."""
    import regex

    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ")


def blocks_of(norm):
    """The hashes of a line's distinct words by the block that each votes in."""
    blocks = [[] for _ in range(4)]
    for w in dict.fromkeys(norm.split(" ")):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        blocks[(h >> 29 ^ h) & 3].append(h)
    return blocks


def line_keys(norm):
    """The keys of a line: pairs of blocks of its SimHash."""
    blocks = blocks_of(norm)
    bits = [tuple(2 * sum(h >> s & 1 for h in hs) > len(hs) for s in range(64) if s % 8 // 2 == b) for b, hs in enumerate(blocks)]
    n = [len(hs) for hs in blocks]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return {(i, j, bits[i], bits[j]) for i, j in pairs if n[i] + n[j] >= (3 if sum(n) > 5 else 2) and 4 * (n[i] + n[j]) >= sum(n)}


def line_firsts(texts, least=0.8):
    """(doc_id, line_no) to whether the line stays."""
    where = defaultdict(list)
    for d in sorted(texts):
        for i, line in enumerate((texts[d] or "").split("\n")):
            norm = normalised(line)
            if norm:
                where[norm].append((d, i))
    norms, groups, keys = list(where), Union(), {n: line_keys(n) for n in where}
    for i, a in enumerate(norms):
        groups.find(a)
        for b in norms[i + 1 :]:
            if keys[a] & keys[b] and groups.find(a) != groups.find(b) and min(len(a), len(b)) >= least * max(len(a), len(b)):
                if 1 - edit_distance(a, b) / max(len(a), len(b)) >= least:
                    groups.join(a, b)
    first = {}
    for n in norms:
        first[groups.find(n)] = min([*where[n], first.get(groups.find(n), (1 << 60, 0))])
    return {p: p == first[groups.find(n)] for n in norms for p in where[n]}


def targets(sizes, weights=(1, 2, 3), most=3):
    """Source to target, by dealing the excess again until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        left, open_ = total - sum(full.values()), [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}
