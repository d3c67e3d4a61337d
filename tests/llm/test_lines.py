"""Fuzzy line dedup: what the plan computes once, groups joined by further pairs, edit similarity of short and long lines, repeated rows."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.llm import lines
from strandframe.scratch import Scratch
from tests.llm import brute


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_hashed_once(spark):
    """No filter makes the hashes of a line's words a second time."""
    rows = lines._lines(spark.createDataFrame([(1, "one two three\nfour")], "doc_id long, text string"))
    # once for each width of lanes
    assert plan(lines._fingerprints(rows.localCheckpoint())).count("array_distinct") == 3


def test_normalised(spark):
    rnd = random.Random(5)
    alphabet = [*"abAB09   \t.,-_'\"\r\x0b\x85", " ", "—", "é", "ß", "你", "。", "́", "²", "Ⅷ", "½", "𝒜", "😀"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(500)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.trim(lines.normalised(F.col("t"))).alias("norm")).collect()
    assert {r.i: r.norm for r in got} == {i: brute.normalised(t) for i, t in enumerate(texts)}


def test_joined_groups(spark):
    """Groups and further pairs, among them, with single nodes and between these, give the components of all."""
    rnd, all_, scratch = random.Random(6), brute.Union(), Scratch(spark, "test")
    first, more = ([(rnd.randrange(n), rnd.randrange(n)) for _ in range(k)] for n, k in ((400, 200), (600, 60)))
    made = spark.createDataFrame(first, "a long, b long")
    got = lines._joined(lines.connected_components(made, scratch), spark.createDataFrame(more, "a long, b long"), scratch).collect()
    for a, b in first + more:
        if a != b:
            all_.join(a, b)
    nodes = {x for p in first + more if p[0] != p[1] for x in p}
    least = {}
    for x in sorted(nodes):
        least.setdefault(all_.find(x), x)
    assert len(got) == len(nodes) and {r.node: r.component for r in got} == {x: least[all_.find(x)] for x in nodes}


@pytest.mark.parametrize("exact", [True, False])
def test_similarity_around_the_bound(spark, exact):
    """Lines up to and over the length from which words are looked at first, changed in about a fifth of their letters at random or by moved parts."""
    rnd, pairs = random.Random(7), []
    for k in range(120):
        words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 8))) for _ in range(rnd.choice([1, 3, 20, 27, 40, 90]))]
        a = " ".join(words)
        b = list(a)
        for _ in range(round(len(a) * rnd.choice([0.02, 0.15, 0.2, 0.25]))):
            b[rnd.randrange(len(b))] = rnd.choice("vwxyz")
        b = "".join(b)
        if k % 4 == 0:
            cut = rnd.randint(0, len(words) // 6)
            b = " ".join(words[cut:] + words[:cut])
        pairs.append((k, a, b))
    got = {r.k: r.similarity for r in lines.edit_similarity(spark.createDataFrame(pairs, "k int, a string, b string"), "a", "b", 0.8, exact).collect()}
    exp = {k: 1 - brute.edit_distance(a, b) / max(len(a), len(b)) for k, a, b in pairs}
    assert {k for k in got if got[k] is not None} == {k for k in exp if exp[k] >= 0.8}
    assert all(got[k] == exp[k] if exact else got[k] <= exp[k] for k in got if got[k] is not None)
    assert 20 < sum(x is not None for x in got.values()) < 100


def test_repeated_rows(spark):
    """Rows equal in doc_id and text are one document, whatever their first line is."""
    texts = {1: "one two three\n\none two three\nfour five", 2: "\nsix seven eight\n...\nnine ten", 3: "...", 4: None, 5: "", 6: "one two three"}
    rows = [(d, t) for d, t in texts.items() for _ in range(1 + d % 3)]
    got = lines.op5_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    firsts = brute.line_firsts(texts)
    of = lambda d: [n for (x, n) in firsts if x == d]
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n_lines, r.n_kept, r.removed) for r in got} == {
        d: (len(of(d)), sum(firsts[d, n] for n in of(d)), sorted(n for n in of(d) if not firsts[d, n])) for d in texts
    }
