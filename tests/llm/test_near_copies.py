"""Near-copies against all pairs of shingle sets."""

import random

import numpy as np
import pytest

from strandframe.llm import near_copies
from strandframe.scratch import Scratch
from tests.llm import brute

DOCS = "doc_id long, text string, component string, first string, key string"


def corpus(seed):
    """Families of texts with some words changed, passages that many share, and short ones."""
    rnd = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(3000)]
    shared = " ".join(rnd.choices(vocabulary, k=60))
    texts = []
    for _ in range(40):
        base = rnd.choices(vocabulary, k=rnd.choice([30, 80, 250, 900]))
        for rate in (0, 0, 0.004, 0.008, 0.015, 0.03, 0.06, 0.2):
            texts.append(" ".join(w if rnd.random() >= rate else rnd.choice(vocabulary) for w in base))
    texts += [shared + " " + " ".join(rnd.choices(vocabulary, k=120)) for _ in range(20)]
    return texts + ["", None, " \n", "one", "ONE", "one two three four five", "one  two three four FIVE", "one two three four six"]


def docs(spark, texts, n=4):
    rows = [(i, t, "own", "own", "own") for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, DOCS).repartition(n)


@pytest.mark.parametrize("cell_rows", [4, 1024])
def test_groups(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(near_copies, "CELL_ROWS", cell_rows)
    texts = corpus(1)
    rows, df = docs(spark, texts)
    exp = brute.shingle_groups(dict(enumerate(texts)))
    left = {r.doc_id for r in near_copies.drop_near_copies(df).collect()}
    assert all(exp[d] != d for d in set(exp) - left)
    assert len(exp) - len(left) >= 0.95 * sum(exp[d] != d for d in exp)


def test_large_groups(spark, monkeypatch):
    """A group of more near-copies than a block holds, each near the first, at 0.8 to 0.85, but not to the others."""
    monkeypatch.setattr(near_copies, "FEW", 8)
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    texts = [" ".join(base)]
    for _ in range(300):
        words = list(base)
        for at in rnd.sample(range(300), 6):
            words[at] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    _, df = docs(spark, texts)
    left = [r.doc_id for r in near_copies.drop_near_copies(df).collect()]
    assert 0 in left and len(left) <= 6


@pytest.mark.parametrize("few, cell_rows", [(128, 1024), (8, 1024), (128, 16)])
def test_no_seeming_pair_is_dropped(spark, monkeypatch, few, cell_rows):
    """Texts with three changed words are similar to each other (0.816), but lie among many with four (0.788 and less) that seem as near."""
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies.candidates, "__defaults__", (cell_rows,))
    if hasattr(near_copies, "untried"):
        monkeypatch.setattr(near_copies.untried, "__defaults__", (cell_rows,))
    rnd = random.Random(5)
    base, texts = [f"w{rnd.randrange(5000)}" for _ in range(300)], []
    for k in range(90):
        words, n = list(base), 3 if k % 8 == 0 else 4
        for i in range(n):
            words[10 + rnd.randrange(280 // n - 10) + i * (280 // n)] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    hashes = [near_copies.shingle_hashes(t) for t in texts]
    sketches = [np.frombuffer(near_copies.sketch(h), np.uint64) for h in hashes]
    fps = [near_copies.text_fingerprint(t, near_copies.FINGER_WIDTH) & (1 << 64) - 1 for t in texts]
    meet = [(a, b) for a in range(90) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= near_copies.RADIUS]
    seem = [(a, b) for a, b in meet if np.bitwise_count(sketches[a] ^ sketches[b]).sum() <= near_copies.REACH * 512]
    near = [(a, b) for a, b in seem if near_copies.similarity(hashes[a], hashes[b]) >= near_copies.LEAST]
    assert 10 < len(near) < len(seem) / 10
    _, df = docs(spark, texts)
    got = {r.first: r.component for r in near_copies.groups(df, Scratch(spark, "t")).collect()}
    assert not [(a, b) for a, b in near if got[a] != got[b]]
    exp = brute.shingle_groups(dict(enumerate(texts)))
    assert all(exp[a] == exp[b] for a in got for b in got if got[a] == got[b])


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text, "a", None, None), (1, text + " more", "b", None, None), (1, text + " more", "b", None, None), (None, text, "c", None, None), (None, text, "c", None, None), (7, "quite another text", "d", None, None), (7, text, "e", None, None), (9, None, "f", None, None), (8, "", "g", None, None)]
    got = sorted(map(tuple, near_copies.drop_near_copies(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([rows[1], rows[3], rows[4], rows[5], rows[8]], key=str)
    assert near_copies.drop_near_copies(spark.createDataFrame([], DOCS)).count() == 0
    assert near_copies.groups(spark.createDataFrame([], DOCS), Scratch(spark, "t")).count() == 0


def test_sketches():
    """The share of bits that differ follows the similarity."""
    rnd = random.Random(3)
    for same in (0, 300, 500, 900):
        a = np.unique(np.array([rnd.getrandbits(64) for _ in range(1000)], np.uint64))
        b = np.unique(np.concatenate([a[:same], np.array([rnd.getrandbits(64) for _ in range(1000 - same)], np.uint64)]))
        x, y = (np.frombuffer(near_copies.sketch(s), np.uint64) for s in (a, b))
        assert abs(np.bitwise_count(x ^ y).sum() / 512 - np.arccos(same / 1000) / np.pi) < 0.07
    assert near_copies.similarity(a, a) == near_copies.similarity(a[:0], b[:0]) == 1 and near_copies.similarity(a, a[:0]) == 0


def family(n, changed, seed):
    """n texts of 300 words, each with words of its own at so many places, far from each other."""
    rnd = random.Random(seed)
    base, texts = [f"w{rnd.randrange(5000)}" for _ in range(300)], []
    for k in range(n):
        words, m = list(base), changed[k % len(changed)]
        for i in range(m):
            words[10 + rnd.randrange(280 // m - 10) + i * (280 // m)] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts


class Counting(Scratch):
    """A scratch that adds up the rows of the tables of pairs that are saved."""

    rows = 0

    def save(self, df, name):
        out = super().save(df, name)
        self.rows += out.count() if df.columns[:2] == ["a", "b"] else 0
        return out


def test_rows_grow_with_texts(spark):
    """Of 400 texts that seem alike and of which few are similar, edges that connect them are handed on, not their pairs."""
    scratch, texts = Counting(spark, "t"), family(400, (4, 4, 5), 7)
    exp = brute.shingle_groups(dict(enumerate(texts)))
    _, df = docs(spark, texts)
    got = {r.first: r.component for r in near_copies.groups(df, scratch).collect()}
    assert len(set(got.values())) > 50
    assert all(exp[a] == exp[b] for a in got for b in got if got[a] == got[b])
    assert scratch.rows < 8 * 400


@pytest.mark.parametrize("block_rows", [8, 512])
def test_all_pairs_of_a_cluster(spark, monkeypatch, block_rows):
    """Groups of a cluster are those of all its pairs, in one block and in many."""
    if hasattr(near_copies, "BLOCK_ROWS"):
        monkeypatch.setattr(near_copies, "BLOCK_ROWS", block_rows)
    texts = family(60, (1, 2, 3, 4, 4, 5), 11) + ["", " ", "a b", "A  b"]
    exp = brute.shingle_groups(dict(enumerate(texts)))
    _, df = docs(spark, texts)
    got = {r.first: r.component for r in near_copies.groups(df, Scratch(spark, "t")).collect()}
    assert all((exp[a] == exp[b]) == (got[a] == got[b]) for a in got for b in got)


def test_linked():
    """Edges within a task against each pair by itself; shingles held by few, by many, and by all."""
    rnd = random.Random(4)
    for n, size in ((2, 9), (3, 0), (40, 5), (70, 60), (200, 40)):
        base = [rnd.getrandbits(64) for _ in range(size)]
        sets = []
        for k in range(n):
            own = rnd.choice([0, 1, 2, size // 6, size // 4, size])
            sets.append(np.unique(np.array(rnd.sample(base, size - min(own, size)) + [rnd.getrandbits(64) for _ in range(own)] if k % 9 else [], np.uint64)))
        exp = {i: i for i in range(n)}
        for i in range(n):
            for j in range(i):
                if near_copies.similarity(sets[i], sets[j]) >= near_copies.LEAST and exp[i] != exp[j]:
                    exp = {k: exp[j] if v == exp[i] else v for k, v in exp.items()}
        got = near_copies.linked(sets)
        assert len(got) == n - len(set(exp.values()))
        for i, j in got:
            exp = {k: exp[j] if v == exp[i] else v for k, v in exp.items()}
        assert len(got) == n - len(set(exp.values()))
