"""The filter audit against counting by hand, order by order."""

import random
from itertools import permutations

import numpy as np
import pytest

from strandframe.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, part string, failed string"
LABELS = "doc_id long, quality int, toxic int"


def verdicts(rows):
    out = []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        words = raw.split()
        bad = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum(65 <= b <= 90 for b in raw) > 10 * len(text or ""),
            "D": any(c in "#$%&*|" for c in text or ""),
            "E": doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == (text or "") for o in rows),
        }
        out.append({k for k, v in bad.items() if v})
    return out


def by_hand(rows, labels):
    bad = verdicts(rows)
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    out = {}
    for part in {r[2] or "" for r in rows}:
        here = [(r[0], b) for r, b in zip(rows, bad, strict=True) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = here
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                kept = [x for x in left if f not in x[1]]
                failing = sum(f in b for _, b in here)
                shapley[f] += len(gone)
                out[part, "".join(order), step] = (
                    [len(kept), len(gone), failing - len(gone), sum(b == {f} for _, b in here), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)], f, shapley
                )
                left = kept
    return {k: (*v, s[f]) for k, (v, f, s) in out.items()}


def some_texts(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    texts = [None, "", " \t\n", "\x1c \x85   word", "ÄÖÜ É", "ABC abc", "a b c #", "x" * 300_000, "word " * 40_000]
    for _ in range(40):
        text = " ".join(rnd.choices(words[: rnd.choice([10, 60, 150])], k=rnd.choice([20, 99, 100, 101, 140])))
        texts.append(text + rnd.choice(["", "", " A" * 30, " *", " $5"]))
    return texts


@pytest.mark.parametrize("seed", [0, 1])
def test_against_counting(spark, seed):
    rnd = random.Random(seed)
    texts = some_texts(seed)
    rows = [(rnd.choice([None, *range(60)]), rnd.choice(texts), rnd.choice(["de", "en", "", None]), None, "own", "own") for _ in range(150)]
    rows += rows[:10]
    labels = [(rnd.choice([None, *range(60)]), rnd.choice([None, 0, 1]), rnd.choice([None, 0, 1])) for _ in range(50)]
    got = filter_audit.op12_query(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()}
    assert found == by_hand(rows, labels)


def test_no_documents(spark):
    got = filter_audit.op12_query(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 1)], LABELS))
    assert got.count() == 0
    one = filter_audit.op12_query(spark.createDataFrame([(1, None, None, None, None, None)], DOCS), spark.createDataFrame([], LABELS))
    assert {(r.part, r.kept + r.removed + r.redundant) for r in one.where("step = 1").collect()} == {("", 1)}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 31, 1000])
def test_popcounts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    assert filter_audit.positional_popcounts(words).tolist() == [sum(int(w) >> s & 1 for w in words) for s in range(32)]


def test_survival_words():
    for failed, word in enumerate(filter_audit.survival_words(np.arange(32)).tolist()):
        assert word == sum(1 << s for s in range(32) if not s & failed)
