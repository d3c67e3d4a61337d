"""Interval algebra against per-base models."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import intervals


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    out = []
    for i in range(120):
        s = rnd.randint(0, 300)
        out.append((i, rnd.choice("ab"), s, s + rnd.randint(1, 40)))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, start long, end long")


def bases(rows, key):
    return {b for _, k, s, e in rows if k == key for b in range(s, e)}


@pytest.mark.parametrize("width", [7, 1 << 16])
@pytest.mark.parametrize("gap", [0, 3])
def test_merge(table, rows, gap, width):
    got = intervals.merge(table, ["k"], gap, {"n": F.lit(1)}, width).collect()
    for key in "ab":
        mine = sorted((r.start, r.end, r.n) for r in got if r.k == key)
        left, exp = sorted((s, e) for _, k, s, e in rows if k == key), []
        for s, e in left:
            if exp and s <= exp[-1][1] + gap:
                exp[-1][1], exp[-1][2] = max(e, exp[-1][1]), exp[-1][2] + 1
            else:
                exp.append([s, e, 1])
        assert mine == [tuple(x) for x in exp]


def test_complement_and_depth(spark, table, rows):
    lengths = spark.createDataFrame([("a", 350), ("b", 350), ("c", 20)], "k string, length long")
    gaps = intervals.complement(intervals.merge(table, ["k"]), lengths, ["k"]).collect()
    for key, n in (("a", 350), ("b", 350), ("c", 20)):
        assert {b for r in gaps if r.k == key for b in range(r.start, r.end)} == set(range(n)) - bases(rows, key)
    deep = intervals.depth(table, ["k"], 3).collect()
    for key in "ab":
        exp = {}
        for _, k, s, e in rows:
            for b in range(s, e) if k == key else ():
                exp[b] = min(3, exp.get(b, 0) + 1)
        assert {b: r.depth for r in deep if r.k == key for b in range(r.start, r.end)} == exp


@pytest.mark.parametrize("how", ["overlap", "contains", "stab"])
def test_joins(table, rows, how):
    right = table.select("k", F.col("id").alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    got = sorted((r.id, r.r_id) for r in intervals.overlap_join(table, right, ["k"], how, 16).collect())
    test = {"overlap": lambda a, b: a[2] < b[3] and b[2] < a[3], "contains": lambda a, b: a[2] <= b[2] and b[3] <= a[3], "stab": lambda a, b: b[2] <= a[2] < b[3]}[how]
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and test(a, b))


def test_subtract(spark, table, rows):
    masks = [("a", 20, 31), ("a", 60, 71), ("a", 65, 90), ("b", 0, 5)]
    got = intervals.subtract(table, spark.createDataFrame(masks, "k string, start long, end long"), ["k"], "id").collect()
    for i, k, s, e in rows:
        hidden = {b for m, x, y in masks if m == k for b in range(x, y)}
        assert {b for r in got if r.id == i for b in range(r.start, r.end)} == set(range(s, e)) - hidden


def test_cut_and_drop(table, rows):
    got = intervals.cut_at_ends(table, ["k"], ["id"]).collect()
    for i, k, s, e in rows:
        points = sorted({p for _, k2, a, b in rows if k2 == k for p in (a, b) if s < p < e} | {s, e})
        assert sorted((r.piece_start, r.piece_end) for r in got if r.id == i) == list(zip(points[:-1], points[1:], strict=True))
    kept = {r.id for r in intervals.drop_shorter(table, ["k"], 16).collect()}
    assert kept == {a[0] for a in rows if not any(b[1] == a[1] and b[2] < a[3] and a[2] < b[3] and b[3] - b[2] > a[3] - a[2] for b in rows)}
