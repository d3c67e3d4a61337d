"""Operators that avoid one task for each key, file or step of depth, against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import graph, intervals
from strandframe.sources import alignments, sinks


@pytest.mark.parametrize("width", [5, 64])
def test_depth_and_complement_across_bins(spark, width):
    rnd = random.Random(width)
    rows = [("k", s, s + rnd.randint(1, 30)) for s in (rnd.randint(0, 400) for _ in range(60))] + [("far", 1000, 1003), (None, 1, 2)]
    table = spark.createDataFrame(rows, "k string, start long, end long")
    cover = {}
    for k, s, e in rows:
        for b in range(s, e):
            cover[k, b] = cover.get((k, b), 0) + 1
    deep = intervals.depth(table, ["k"], None, width).collect()
    assert {(r.k, b): r.depth for r in deep for b in range(r.start, r.end)} == {x: n for x, n in cover.items() if x[0]}
    lengths = spark.createDataFrame([("k", 500), ("far", 1100), ("bare", 9)], "k string, length long")
    gaps = intervals.complement(intervals.merge(table, ["k"], 0, None, width), lengths, ["k"], 1, width).collect()
    free = {(k, b) for k, n in (("k", 500), ("far", 1100), ("bare", 9)) for b in range(n)} - set(cover)
    assert {(r.k, b) for r in gaps for b in range(r.start, r.end)} == free
    assert sum(r.end - r.start for r in gaps) == len(free)


def test_one_key_is_no_single_task(spark):
    rows = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") * 50).alias("start"), (F.col("id") * 50 + 20).alias("end"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        deep = intervals.depth(rows, ["k"], None, 1000).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in deep) == 20_000
    assert max(r["count"] for r in deep) < 10_000


def test_labels_against_steps(spark):
    rnd = random.Random(5)
    ranks = {n: 0 if n % 9 == 0 else rnd.randint(1, 3) for n in range(60)}
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(70)]
    ways = [(u, v) for a, b in edges for u, v in ((a, b), (b, a)) if ranks[v] > 0 and ranks[u] <= ranks[v]]
    exp = {(n, f"c{n}") for n, r in ranks.items() if r == 0}
    while True:
        more = {(v, c) for u, v in ways for n, c in exp if n == u} - exp
        if not more:
            break
        exp |= more
    nodes = spark.createDataFrame([(n, r, f"c{n}" if r == 0 else None) for n, r in ranks.items()], "node_id long, rank long, contig string")
    got = graph.label_nodes(nodes, spark.createDataFrame(edges, "source long, sink long"), strict=False).collect()
    assert len(got) == len(exp) and {(r.node_id, r.contig) for r in got} == exp


def test_labels_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(0, 0, "c"), *[(i, 1, None) for i in range(1, 400)]], "node_id long, rank long, contig string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(399)], "source long, sink long")
    assert graph.label_nodes(nodes, edges).where("contig = 'c'").count() == 400


def test_parents_from_splits_before(spark):
    hit = "*\t>t{}\t100\t1\t0.0\t0\t15\t0\t15\t15\t\t"
    parent = "q{}\t50\t0\t15\t+\tp\t1\t0\t1\t15\t15\t60"
    lines, exp = [], []
    for block, what in ((0, "p1 h1 h2"), (64, "h3"), (128, "h4 p2 h5"), (192, "p3"), (256, "h6")):
        for i, x in enumerate(what.split()):
            lines.append((0, ("f", block, block * 1000 + i), (parent if x[0] == "p" else hit).format(x[1])))
    exp = {"t1": "q1", "t2": "q1", "t3": "q1", "t4": "q1", "t5": "q2", "t6": "q3"}
    rnd = random.Random(1)
    rnd.shuffle(lines)
    table = spark.createDataFrame(lines, "file_ord int, pos struct<file:string,block:long,row:long>, value string").repartition(4)
    got = alignments.parse_minimizers(table).select("target_name", "parent.query_name").collect()
    assert len(got) == 6 and {r.target_name: r.query_name for r in got} == exp


def test_totals_and_fasta(spark):
    before = spark.createDataFrame([("a", 0, 10), ("b", 5, 9)], "query_name string, query_start long, query_end long")
    r = sinks.loss_totals(before, F.col("query_name") == "a").first()
    assert (r["rows"], r.bases, r.rows_left, r.bases_left, r.bases_lost) == (2, 14, 1, 10, 4)
    assert sinks.loss_totals(before.limit(0), F.lit(True)).first().bases_lost == 0
    out = []
    assert sinks.observed_losses(before, lambda df: df.where("query_name = 'a'"), lambda df: out.extend(df.collect())) == r.asDict() and len(out) == 1
    fasta = spark.createDataFrame([("n", "d e", "ACGTACGTA"), ("m", "", "ACGT"), ("z", None, None)], "name string, description string, seq string")
    got = {r.name: r.value for r in sinks.fasta_lines(fasta, 4).collect()}
    assert got == {"n": ">n d e\nACGT\nACGT\nA", "m": ">m\nACGT", "z": ">z\n"}
