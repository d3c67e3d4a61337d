"""Operators that look at whole places in one shuffle, against plain models and the ways for crowded places."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions import cigar
from strandframe.operators import compose, intervals, minimizers, partition


def exchanges(df):
    """Shuffles of rows in df's plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def ranges(seed, n=300):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["a", "b", "c", None]), s, s + rnd.choice([0, 1, 2, 30, 400, 70_000])) for i, s in enumerate(rnd.randint(-80_000, 300_000) if i % 3 else rnd.randint(0, 90) for i in range(n))]


@pytest.mark.parametrize("most", [4, 60, 1 << 18])
def test_drop_shorter(spark, most):
    rows = ranges(1)
    table = spark.createDataFrame(rows, "id long, k string, start long, end long")
    kept = sorted(r.id for r in intervals.drop_shorter(table, ["k"], most=most).collect())
    over = lambda a, b: a[1] is not None and a[1] == b[1] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3]
    assert kept == [a[0] for a in rows if not any(over(a, b) and b[3] - b[2] > a[3] - a[2] for b in rows)]


def test_drop_shorter_shuffles_once(spark):
    table = spark.range(1000).select("id", F.lit("k").alias("k"), (F.col("id") * 5).alias("start"), (F.col("id") * 6 + 9).alias("end"))
    assert exchanges(intervals.drop_shorter(table, ["k"])) == 1


def paf_rows(seed, n=120):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        parts = [rnd.randint(0, 30), rnd.randint(1, 4), rnd.randint(1, 30), rnd.randint(1, 4), rnd.randint(1, 30)]
        q, t = rnd.randint(0, 500), rnd.choice([rnd.randint(0, 200), rnd.randint(65_500, 65_600)])
        cg = "{}M{}I{}M{}D{}M".format(*parts)
        out.append((i, rnd.choice(["qa", "qb", "qé", "q1", "q10"]), 1000, q, q + sum(parts) - parts[3], rnd.choice("+-"), rnd.choice(["n", "m", None]), 70_000, t, t + sum(parts) - parts[1], cg))
    return out


@pytest.mark.parametrize("most,pieces", [(5, 1 << 22), (1 << 15, 1 << 22), (1 << 15, 7)])
def test_compose_as_by_joins(spark, most, pieces):
    text = "row long, query_name string, query_len long, query_start long, query_end long, strand string, target_name string, target_len long, target_start long, target_end long, cg string"
    paf = spark.createDataFrame(paf_rows(3), text).withColumn("cigar", cigar.parse(F.col("cg"))).localCheckpoint()
    show = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    by_joins = compose._compose_joined(paf, "row")
    assert show(compose.compose(paf, "row", True, most, pieces)) == show(by_joins)
    assert show(compose.stable_pieces(paf, "row", most, pieces)) == show(compose.stable_mapping(compose.target_blocks(paf, "row")))
    if most > 5:
        assert exchanges(compose.compose(paf, "row")) == exchanges(compose.stable_pieces(paf, "row")) == 1 < exchanges(by_joins)


@pytest.mark.parametrize("most", [12, 1 << 18])
def test_counts_as_by_joins(spark, most):
    rnd = random.Random(8)
    rows = []
    for i in range(90):
        off = [rnd.randint(1, 9) for _ in range(rnd.randint(0, 4))]
        t = rnd.choice([rnd.randint(0, 40), rnd.randint(65_500, 65_560)])
        rows.append((i, rnd.choice(["n", "m", None]), i % 3, rnd.random() < 0.5, 131_100, t, t + sum(off) + 15, off, off, 15, rnd.randint(0, 1)))
    hits = spark.createDataFrame(rows, "row long, target_name string, file_ord int, is_reverse boolean, target_len long, t_start long, t_end long, t_off array<int>, q_off array<int>, kmer long, good int").localCheckpoint()
    show = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    keep = F.col("good") == 1
    plain, files = minimizers.counts(hits, keep).localCheckpoint(), minimizers.cumulative(minimizers.counts(hits, keep, by=["file_ord"]))
    assert show(minimizers.counts_by_place(hits, keep, most=most)) == show(plain)
    assert show(minimizers.counts_by_place(hits, keep, by_file=True, most=most)) == show(files)
    marked = minimizers.keep_universal(hits, plain, "row", 0.5).where("target_name is not null").select("row", "ok")
    assert show(minimizers.universal_marks(hits, keep, "row", 0.5, most)) == show(marked)
    if most > 12:
        assert exchanges(minimizers.counts_by_place(hits, keep)) == exchanges(minimizers.universal_marks(hits, keep, "row", 0.5)) == 1


@pytest.mark.parametrize("carried", [3, 1024])
def test_route(spark, carried):
    rnd = random.Random(9)
    rows = [(i, rnd.choice(["p", "q", "r", "s", None]), 100, s, s + rnd.randint(0, 20)) for i, s in enumerate(rnd.randint(0, 90) for _ in range(80))]
    chunks = [("p", f"k{i}", 100, i * 20, i * 20 + 20) for i in range(5)] + [("q", "a", 100, 0, 100), ("r", "b", 100, 0, 50), ("r", "c", 100, 30, 70)]
    paf = spark.createDataFrame(rows, "id long, query_name string, query_len long, query_start long, query_end long").localCheckpoint()
    table = spark.createDataFrame(chunks, "query_name string, contig string, query_len long, start long, end long")
    got = partition.route(paf, table, "id", carried)
    exp = []
    for i, q, n, s, e in rows:
        met = [c for c in chunks if c[0] == q and s < c[4] and c[3] < e]
        if len(met) == 1:
            exp.append((i, q, n, s, e, met[0][1], met[0][3], met[0][4], met[0][3] == 0 and met[0][4] >= 100))
    assert sorted(tuple(r) for r in got.select("id", "query_name", "query_len", "query_start", "query_end", "contig", "chunk_start", "chunk_end", "whole").collect()) == exp
    assert carried == 3 or exchanges(got) == 0


@pytest.mark.parametrize("most", [12, 1 << 18])
def test_single_as_by_joins(spark, most):
    rnd = random.Random(10)
    rows = []
    for i in range(90):
        off = [rnd.randint(1, 40) for _ in range(rnd.randint(0, 4))]
        q = rnd.choice([rnd.randint(0, 900), rnd.randint(65_500, 65_560)])
        rows.append((i, rnd.choice(["n", "m", None]), q, q + sum(off) + 15, rnd.choice([10, 300]), off, 15))
    hits = spark.createDataFrame(rows, "row long, query_name string, q_start long, query_end long, block_len long, q_off array<int>, kmer long").withColumn("query_start", F.col("q_start")).localCheckpoint()
    show = lambda df: sorted(map(repr, df.select("row", "ok").collect()))
    got = minimizers.single_marks(hits, hits, "row", 200, most)
    assert show(got) == show(minimizers.keep_single(hits, hits, "row", 200))
    assert most == 12 or exchanges(got) == 1
