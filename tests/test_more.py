"""SQL functions, validators, sinks and streams."""

from pyspark.sql import functions as F

from strandframe.functions import cigar, sql
from strandframe.operators import sequences, validate
from strandframe.sources import sinks
from strandframe.streaming import rowlocal

PAF = "q\t60\t4\t24\t{s}\tt\t60\t10\t32\t20\t22\t60\tcg:Z:{cg}"
A = "ACGTTGCATTAGCCATGGACTTACGGATCCATTGCAACGTTAGGCATCCGATTACAGGCT"


def paf(spark, strand, cg, qs, qe, ts, te):
    row = (1, "q", 60, qs, qe, strand, "t", 60, ts, te, cg)
    df = spark.createDataFrame([row], "row long, query_name string, query_len long, query_start long, query_end long, strand string, target_name string, target_len long, target_start long, target_end long, cg string")
    return df.withColumn("cigar", cigar.parse(F.col("cg")))


def test_sql(spark):
    sql.register(spark)
    r = spark.sql("select cigar_query_span(cigar_parse('10M2I3D')) q, cigar_target_span(cigar_parse('10M2I3D')) t, cigar_text(cigar_parse('1M2D')) x, reverse_complement('AACG') rc, graph_node_id('s7') n, make_subpath('c', 9, 99) p").first()
    assert tuple(r) == (12, 13, "1M2D", "CGTT", 7, "c:10-99")


def test_identity(spark):
    rc = A[::-1].translate(str.maketrans("ACGT", "TGCA"))
    fa = spark.createDataFrame([("q", A)], "name string, seq string")
    fwd, back = spark.createDataFrame([("t", A[:30] + "GG" + A[30:58])], "name string, seq string"), spark.createDataFrame([("t", rc)], "name string, seq string")
    good = paf(spark, "+", "20M2D10M", 10, 40, 10, 42)
    chunks = sequences.chunks_of
    assert tuple(validate.base_identity(good, chunks(fa), chunks(fwd), "row").first()) == (1, 30, 1.0)
    assert validate.wrong_spans(good).count() == 0 and validate.wrong_spans(paf(spark, "+", "20M", 10, 40, 10, 42)).count() == 1
    assert tuple(validate.base_identity(paf(spark, "-", "20M", 5, 25, len(A) - 25, len(A) - 5), chunks(fa), chunks(back), "row").first()) == (1, 20, 1.0)
    assert validate.wrong_lengths(good, fa.unionByName(fwd)).count() == 0


def test_minimizers(spark):
    fa = spark.createDataFrame([("q", A), ("t", A[5:])], "name string, seq string")
    hit = spark.createDataFrame([(1, "q", "t", False, 55, 5, 0, [4, 3], [4, 3], 6), (2, "q", "t", False, 55, 5, 1, [4], [4], 6)], "id int, query_name string, target_name string, is_reverse boolean, target_len long, q_start long, t_start long, q_off array<int>, t_off array<int>, kmer long")
    assert [r.t_start for r in validate.wrong_minimizers(hit, sequences.chunks_of(fa), sequences.chunks_of(fa), "id").collect()] == [1]


def test_sinks(spark):
    labels = spark.createDataFrame([(3, "c")], "node_id long, contig string")
    lines = sinks.contig_map_lines(labels)
    assert lines.first().value == "S3\tc" and tuple(sinks.read_contig_map(lines).first()) == (3, "c")
    gaps = spark.createDataFrame([("q", 1, 5, "x")], "query_name string, start long, end long, label string")
    assert sinks.bed_lines(gaps).first().value == "q\t1\t5\tx"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.paf").write_text(PAF.format(s="+", cg="10M2D10M") + "\nnot a row\n")
    rows = rowlocal.paf(spark, str(tmp_path / "in"))
    q = rowlocal.lastz(rows).select("value").writeStream.format("memory").queryName("lastz_out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.value for r in spark.table("lastz_out").collect()] == ["cigar: q 4 24 + t 10 32 + 60 M 10 D 2 M 10"]
    got = []
    bed = spark.createDataFrame([("q", 0, 10)], "name string, start long, end long")
    q = rowlocal.masked(rows, bed, lambda df, n: got.extend(df.select("query_start", "query_end", "target_start").collect()))
    q.awaitTermination()
    assert [tuple(r) for r in got] == [(10, 24, 16)]


def test_long_rows(spark):
    """Rows of 400,000 operations and minimizers take time in proportion to their length."""
    import time

    from strandframe.functions import cigar
    from strandframe.operators import minimizers

    n = 400_000
    row = spark.range(1).select(F.expr(f"transform(sequence(1, {n}), i -> named_struct('op', case when i % 3 = 0 then 'I' else 'M' end, 'len', cast(i % 5 + 1 as bigint)))").alias("c"))
    began = time.time()
    last = row.select(F.element_at(cigar.placed(F.col("c")), -1).alias("x")).first().x
    assert (last.q1, last.t1) == (sum(i % 5 + 1 for i in range(1, n + 1)), sum(i % 5 + 1 for i in range(1, n + 1) if i % 3))
    off = F.expr(f"transform(sequence(1, {n}), i -> 5)")
    hits = spark.range(1).select(F.lit(7).alias("q_start"), off.alias("q_off"), F.lit(9).alias("t_start"), off.alias("t_off"), F.lit(15).alias("kmer"), F.lit(None).cast("array<boolean>").alias("ok"))
    found = minimizers.chains(hits).select("blocks").first().blocks
    assert [tuple(b) for b in found] == [(7, 7 + 5 * n + 15, 9, 9 + 5 * n + 15)] and time.time() - began < 60


def test_chains_side_by_side(spark):
    """Chains of many rows at once are those of one row after the other."""
    import random

    from strandframe.operators import minimizers

    rnd, rows = random.Random(11), []
    for i in range(300):
        n = rnd.choice([0, 1, 2, 5, 9, 40, 300])
        q = [rnd.choice([3, 5, 20, 60]) for _ in range(n)]
        t = [x if rnd.random() < 0.7 else max(0, x + rnd.choice([-30, -4, 4, 30])) for x in q]
        rows.append((i, rnd.randint(0, 50), q, rnd.randint(0, 50), t, 15, None if i % 3 else [rnd.random() < 0.8 for _ in range(n + 1)]))
    rows.append((300, 1, None, 1, None, 15, None))
    df = spark.createDataFrame(rows, "id int, q_start int, q_off array<int>, t_start int, t_off array<int>, kmer int, ok array<boolean>")
    for min_gap, min_match in ((0, 0), (10, 20)):
        for r in minimizers.chains(df, min_gap, min_match).collect():
            if r.q_off is None:
                assert r.blocks is None
                continue
            q, t = [r.q_start], [r.t_start]
            for a, b in zip(r.q_off, r.t_off):
                q, t = [*q, q[-1] + a], [*t, t[-1] + b]
            assert [list(b) for b in r.blocks] == minimizers.chain(q, t, r.ok or [True] * len(q), 15, min_gap, min_match)
