"""Ranges that pile up over one base, and ranges of very unlike lengths."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import alignments, intervals


def ranges(seed, n=150):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        size = rnd.choice([0, 1, 2, 5, 17, 60, 64, 65, 300, 5000, 70_000])
        s = rnd.randint(-50, 400) if size < 5000 else rnd.randint(-60_000, 300)
        out.append((i, rnd.choice(["a", "b", None]), s, s + size))
    return out


def overlap(a, b):
    return a[1] is not None and a[1] == b[1] and a[2] < b[3] and b[2] < a[3]


@pytest.mark.parametrize("heavy", [3, 40, 4096])
@pytest.mark.parametrize("how", ["overlap", "contains", "stab"])
def test_levels(spark, how, heavy):
    left, right = ranges(1), ranges(2)
    a = spark.createDataFrame(left, "id long, k string, start long, end long")
    b = spark.createDataFrame(right, "r_id long, k string, r_start long, r_end long")
    test = {
        "overlap": overlap,
        "contains": lambda x, y: x[1] is not None and x[1] == y[1] and x[2] <= y[2] and y[3] <= x[3] and y[2] < y[3],
        "stab": lambda x, y: x[1] is not None and x[1] == y[1] and y[2] <= x[2] < y[3],
    }[how]
    got = sorted((r.id, r.r_id) for r in intervals.overlap_join(a, b, ["k"], how, heavy).collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if test(x, y))


def test_no_rows(spark):
    a = spark.createDataFrame([], "id long, k string, start long, end long")
    b = spark.createDataFrame([(1, "k", 2, 3)], "r_id long, k string, r_start long, r_end long")
    assert intervals.overlap_join(a, b, ["k"]).count() == 0
    c = b.select("r_id", "k", F.col("r_start").alias("start"), F.col("r_end").alias("end"))
    assert intervals.overlap_join(c, b.limit(0).withColumnRenamed("r_id", "o"), ["k"]).count() == 0
    assert intervals.drop_shorter(a, ["k"]).count() == 0


@pytest.mark.parametrize("sweep", [1, 7, 1024])
def test_longest(spark, sweep):
    rows = ranges(3)
    table = spark.createDataFrame(rows, "id long, k string, start long, end long")
    points = [(k, p, 0) for k in "ab" for p in range(-70, 500, 3)]
    got = {(r.k, r.p): r.longest for r in intervals.longest_over(table, spark.createDataFrame(points, "k string, p long, beyond long"), ["k"], sweep).collect()}
    exp = {}
    for k, p, _ in points:
        over = [e - s for _, k2, s, e in rows if k2 == k and s <= p < e]
        if over:
            exp[k, p] = max(over)
    assert got == exp
    kept = {r.id for r in intervals.drop_shorter(table, ["k"], sweep).collect()}
    assert kept == {a[0] for a in rows if not any(overlap(a, b) and a[2] < a[3] and b[3] - b[2] > a[3] - a[2] for b in rows)}


def largest_task(df):
    got = df.groupBy(F.spark_partition_id()).count().collect()
    return max(r["count"] for r in got) / sum(r["count"] for r in got)


@pytest.fixture
def plain(spark):
    """No help of adaptive execution, and more partitions than heaps."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_heap_of_ranges(plain):
    """100,000 ranges over one base: as many points are swept in many tasks, and one longest range is left."""
    rows = plain.range(100_000).select(F.lit("k").alias("k"), (-F.col("id")).alias("start"), (F.col("id") * 7 % 99_991 + 1).alias("end"))
    points = rows.select("k", F.col("start").alias("p"), F.lit(0).cast("bigint").alias("beyond"))
    assert largest_task(intervals.longest_over(rows, points, ["k"])) < 0.1
    kept = intervals.drop_shorter(rows, ["k"]).collect()
    most = max(i + i * 7 % 99_991 + 1 for i in range(100_000))
    assert [r.end - r.start for r in kept] == [most]


def test_heap_on_one_side(plain):
    left = plain.range(60_000).select(F.lit("k").alias("k"), F.col("id"), (F.col("id") % 500).alias("start"), (F.col("id") % 500 + 600).alias("end"))
    right = plain.range(3).select(F.lit("k").alias("k"), F.col("id").alias("r_id"), (F.col("id") + 550).alias("r_start"), (F.col("id") + 560).alias("r_end"))
    met = intervals.overlap_join(left, right, ["k"])
    assert met.count() == 180_000
    assert largest_task(met) < 0.34


def dominance_rows(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        s = rnd.randint(0, 300)
        size = rnd.choice([0, 3, 20, 70, 400])
        out.append((i, rnd.choice("qr"), s, s + size, 500, rnd.choice([size, size + 5, 2 * size]), rnd.choice([None, 0, 5, 11, 30, 60]), rnd.choice(["P", "S", None]), rnd.choice([None, None, "c", "d"]), rnd.choice([None, 0.5, 0.99])))
    return out


ROWS = "id long, query_name string, query_start long, query_end long, query_len long, block_len long, mapq long, tp string, rc string, identity double"


def dominated(x, y, ratio, least, share, mapq, block, identity):
    """Whether y takes x away, clause by clause."""
    (i, q, s, e, _, b, m, tp, rc, _), (i2, q2, s2, e2, len2, b2, m2, tp2, rc2, id2) = x, y
    m, m2, p, p2 = -1 if m is None else m, -1 if m2 is None else m2, (tp or "P") == "P", (tp2 or "P") == "P"
    if i == i2 or q != q2 or not (s < max(e2, s2 + 1) and s2 < max(e, s + 1)):
        return False
    if m2 < mapq or (len2 > block and b2 < block) or (1.0 if id2 is None else id2) < identity or (rc and rc2 and rc != rc2):
        return False
    if b and min(e, e2) - max(s, s2) < share * b:
        return False
    over = lambda a, c: a / (c + 1e-6) >= ratio
    wins = True
    if ratio:
        if s >= e:
            wins = False
        elif s2 < e2 and p == p2:
            wins = over(m, m2) or (not over(m2, m) and over(b, b2))
        elif s2 < e2:
            wins = p
    return not wins or bool(least and b2 >= least)


@pytest.mark.parametrize("heavy", [2, 4096])
@pytest.mark.parametrize("how", [(2.0, 0, 0.0, 0, 0, 0.0), (1.5, 100, 0.25, 5, 20, 0.9), (0.0, 80, 0.0, 0, 0, 0.0), (3.0, 0, 0.5, 0, 0, 0.0)])
def test_dominance(spark, how, heavy):
    rows = dominance_rows(4, 150)
    got = {r.id for r in alignments.dominance_filter(spark.createDataFrame(rows, ROWS), "id", *how, heavy=heavy).collect()}
    assert got == {x[0] for x in rows if not any(dominated(x, y, *how) for y in rows)}


def test_heap_of_alignments(plain):
    """100,000 alignments over one base: the few that the strongest leave meet all others, not all with all."""
    rows = plain.range(100_000).select(
        "id", F.lit("q").alias("query_name"), (F.lit(500_000) - F.col("id") * 7919 % 3000).alias("query_start"), (F.lit(500_001) + F.col("id") * 104_729 % 3000).alias("query_end"), F.lit(1_000_000).cast("bigint").alias("query_len"),
        (F.col("id") * 31 % 5000 + 1).alias("block_len"), (F.col("id") * 17 % 61).alias("mapq"), F.lit(None).cast("string").alias("tp"), F.lit(None).cast("string").alias("rc"), F.lit(None).cast("double").alias("identity"),
    )
    y = rows.select("query_name", *[F.col(c).alias(f"y_{c}") for c in ("id", "query_start", "query_end", "block_len", "mapq", "tp", "rc")], F.col("query_start").alias("r_start"), F.col("query_end").alias("r_end"))
    slim = rows.withColumn("start", F.col("query_start")).withColumn("end", F.col("query_end"))
    met = alignments._strongest(slim, y, intervals.HEAVY)
    lost = met.where(alignments._beats("id", 2.0, 0, 0.0)).select("id").distinct()
    assert met.count() <= 100_000 * 24 and lost.count() > 99_900
    kept = alignments.dominance_filter(rows, "id", 2.0).collect()
    assert len(kept) <= 1
