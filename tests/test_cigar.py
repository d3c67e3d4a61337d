"""Row-local cigar operators against a sequential model."""

import random

from pyspark.sql import functions as F

from strandframe.functions import cigar, names


def text(ops):
    return "".join(f"{n}{o}" for o, n in ops)


def random_cigar(rnd, ops="MIDX="):
    return [(rnd.choice(ops), rnd.randint(1, 9)) for _ in range(rnd.randint(1, 8))]


def by_target(ops, start, end):
    """Operations of the window by walking base after base; operations without target bases belong to the window that holds their place."""
    out, t = [], 0
    for o, n in ops:
        if o in "MD=XN":
            k = len([i for i in range(t, t + n) if start <= i < end])
            t += n
        else:
            k = n if start <= t < end else 0
        if k:
            out.append((o, k))
    return out


def by_query(ops, start, end):
    out, q = [], 0
    for o, n in ops:
        if o in "MIS=X":
            k = len([i for i in range(q, q + n) if start <= i < end])
            q += n
        else:
            k = n if start < q < end else 0
        if k:
            out.append((o, k))
    return out


def test_windows(spark):
    rnd, rows = random.Random(5), []
    for _ in range(300):
        ops = random_cigar(rnd)
        a, b = sorted((rnd.randint(0, 40), rnd.randint(0, 40)))
        rows.append((text(ops), a, b, text(by_target(ops, a, b)), text(by_query(ops, a, b))))
    df = spark.createDataFrame(rows, "cg string, a long, b long, t string, q string")
    p = cigar.placed(cigar.parse(F.col("cg"), cigar.PAF_OPS))
    got = df.select("t", "q", cigar.to_text(cigar.cut_target(p, F.col("a"), F.col("b"))).alias("gt"), cigar.to_text(cigar.cut_query(p, F.col("a"), F.col("b"))).alias("gq")).collect()
    assert all(r.t == r.gt and r.q == r.gq for r in got)


def test_small_gaps(spark):
    rows = [("10M2I3M", 2), ("2I10M2I", 0), ("5M2I2D5M", 2), ("5M9I5M", 0), ("5M2I9D5M", 0), ("5M2I5M3I5M", 5)]
    df = spark.createDataFrame(rows, "cg string, n long")
    assert all(r.n == r.g for r in df.select("n", cigar.small_gap_bases(cigar.parse(F.col("cg")), 5).alias("g")).collect())


def test_bad_cigar_raises(spark):
    import pytest

    with pytest.raises(Exception, match="not a cigar"):
        spark.createDataFrame([("5M2Q",)], "cg string").select(cigar.parse(F.col("cg"))).collect()


def test_difference_string(spark):
    got = spark.createDataFrame([(":6*ag:2+tt-c",)], "cs string").select(cigar.parse_cs(F.col("cs")).alias("c")).first().c
    assert [(x.op, x.len, x.query, x.target) for x in got] == [(":", 6, "", ""), ("*", 1, "g", "a"), (":", 2, "", ""), ("+", 2, "tt", ""), ("-", 1, "", "c")]


def test_names(spark):
    df = spark.createDataFrame([("id=x|chr1:11-20", "s42", "ACGTn")], "a string, b string, c string")
    p = names.parse_subpath(names.strip_sample(F.col("a")))
    r = df.select(
        p.alias("p"), names.node_id(F.col("b")).alias("n"), names.reverse_complement(F.col("c")).alias("rc"), names.rounded(F.lit(0.8755)).alias("f"), names.rounded(F.lit(1.0)).alias("g"),
        names.breakend(F.lit("N[chr2:77[")).alias("b"), names.identity(F.lit("ACGN"), F.lit("ACTA"), True).alias("i"), names.with_prefix(F.col("b"), "s4").alias("w"),
    ).first()
    assert (r.p.name, r.p.start, r.p.end) == ("chr1", 10, 20)
    assert (r.n, r.rc, r.f, r.g, r.w) == (42, "nACGT", "0.876", "1", "s42")
    assert (r.b.contig, r.b.pos, r.i) == ("chr2", 77, 0.75)
