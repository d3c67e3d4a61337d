"""Reading and printing of text formats, and operators that need their rows."""

import pytest
from pyspark.sql import functions as F

from strandframe.functions import cigar
from strandframe.operators import alignments as al
from strandframe.operators import compose, graph, minimizers, partition, sequences
from strandframe.sources import alignments as src
from strandframe.sources import graphs, text


def put(tmp_path, name, lines):
    p = tmp_path / name
    p.write_text("".join(x + "\n" for x in lines))
    return str(p)


PAF = [
    "q1\t100\t0\t20\t+\tt1\t50\t5\t23\t18\t20\t60\ttp:A:P\tcg:Z:10M2I8M\tAS:i:7",
    "q1\t100\t50\t60\t-\tt1\t50\t30\t42\t10\t12\t255\ttp:A:S\txx:Z:a:b:\tcg:Z:4M2D6M",
]
GAF = ["g1\t30\t0\t25\t+\t>a:0-10<b\t20\t0\t20\t22\t25\t60\ttp:A:P\tcg:Z:10M5I3D7M", "g2\t30\t0\t10\t-\tchr1\t100\t20\t30\t10\t10\t255\tcg:Z:10M", "g3\t9\t*\t*\t*\t*\t*\t*\t*\t*\t*\t255"]


def test_paf(spark, tmp_path):
    paf = src.read_paf(spark, put(tmp_path, "a.paf", PAF))
    assert [r.value for r in paf.orderBy(*text.ORDER).collect()] == PAF
    lines = {r.secondary: r.value for r in al.to_lastz(paf).collect()}
    assert lines[False] == "cigar: q1 0 20 + t1 5 23 + 7 M 10 I 2 M 8"
    assert lines[True] == "cigar: q1 60 50 - t1 30 42 + 255 M 4 D 2 M 6"
    shown = [r.v for r in paf.orderBy(*text.ORDER).select(src.paf_line().alias("v")).collect()]
    assert shown[0] == PAF[0].replace("tp:A:P\tcg:Z:10M2I8M\tAS:i:7", "AS:i:7\tcg:Z:10M2I8M\ttp:A:P")
    s = al.coverage_summary(paf).first()
    assert (s.covered, s.max_gap, s.avg_gap, s.n_gaps) == (28, 40, 24, 3)
    with pytest.raises(Exception, match="not PAF"):
        src.read_paf(spark, put(tmp_path, "bad.paf", ["a\tb"])).collect()


def test_mask(spark, tmp_path):
    paf = src.read_paf(spark, put(tmp_path, "a.paf", ["q\t200\t0\t100\t+\tt\t200\t0\t100\t100\t100\t60\tcg:Z:100M"])).withColumn("row", F.lit(1))
    bed = spark.createDataFrame([("q", 20, 31), ("q", 60, 71)], "name string, start long, end long")
    got = sorted((r.query_start, r.query_end, r.target_start) for r in al.mask_queries(paf, bed, "row", 0, 1).collect())
    assert got == [(0, 20, 0), (31, 60, 31), (71, 100, 71)]
    lines = sorted(r.value for r in al.mask_queries(paf, bed, "row", 0, 1).collect())
    assert lines[0] == "q\t200\t0\t20\t+\tt\t200\t0\t20\t20\t20\t60\tcg:Z:20M"
    assert len(al.mask_queries(paf, bed, "row", 100, 1).collect()) == 2


def test_gaf(spark, tmp_path):
    gaf = src.read_gaf(spark, put(tmp_path, "a.gaf", [*GAF, "*\tminimizers"]))
    shown = [r.v for r in gaf.orderBy(*text.ORDER).select(src.gaf_line().alias("v")).collect()]
    assert shown[1] == GAF[1] and shown[2] == GAF[2] and shown[0].split("\t")[:12] == GAF[0].split("\t")[:12]
    lengths = spark.createDataFrame([("a", 10), ("b", 10)], "name string, length long")
    out = al.gaf_to_paf(gaf.where("query_name = 'g1'").withColumn("row", F.lit(1)), lengths, "row").orderBy("step").collect()
    assert [(r.strand, r.query_start, r.query_end, r.target_start, r.target_end, "".join(f"{c.len}{c.op}" for c in r.cigar)) for r in out] == [("+", 0, 10, 0, 10, "10M"), ("-", 10, 22, 0, 10, "7M3D5I")]
    assert {t.key: t.val for t in out[0].tags} == {"tp": "P", "gm": "22", "gl": "25", "gi": "0.88"}


def test_dominance(spark):
    cols = "id long, query_name string, query_start long, query_end long, query_len long, block_len long, mapq long, tp string, rc string, identity double"
    rows = [(1, "q", 0, 100, 1000, 100, 60, "P", None, 1.0), (2, "q", 50, 120, 1000, 70, 10, "P", None, 1.0), (3, "q", 110, 300, 1000, 200, 11, "S", "c1", 1.0), (4, "q", 150, 160, 1000, 10, 60, "P", "c2", 1.0), (5, "r", 0, 9, 9, 9, None, None, None, None)]
    df = spark.createDataFrame(rows, cols)
    assert {r.id for r in al.dominance_filter(df, "id", ratio=2.0).collect()} == {1, 4, 5}
    assert {r.id for r in al.dominance_filter(df, "id", min_overlap_len=80).collect()} == {1, 3, 4, 5}
    with pytest.raises(ValueError, match="needed"):
        al.dominance_filter(df, "id")


def test_minimizers(spark, tmp_path):
    lines = ["q\t1000000\t709000\t710000\t+\t>s43\t97\t5\t91\t86\t86\t60", "*\t<s43\t97\t12\t0\t6\t92\t709771\t709857\t19\t4,2,10,7,2,9,10,8,4,6,5\t4,2,10,7,2,9,10,8,4,6,5", "*\t>s44\t50\t0"]
    hits = src.parse_minimizers(text.read_lines(spark, put(tmp_path, "m.gaf", lines)))
    r = minimizers.to_paf(hits.where("num_minimizers > 0")).first()
    assert (r.query_name, r.query_start, r.query_end, r.strand, r.target_name, r.target_len, r.target_start, r.target_end, r.num_matching, r.mapq) == ("q", 709771, 709857, "-", "s43", 97, 5, 91, 86, 60)
    assert [(c.op, c.len) for c in r.cigar] == [("M", 86)]
    # extend, open behind a gap, step back, and the length filter
    assert minimizers.chain([0, 3, 20], [0, 3, 25], [True] * 3, 5) == [[0, 8, 0, 8], [20, 25, 25, 30]]
    assert minimizers.chain([0, 3], [0, 1], [True] * 2, 5) == []
    assert minimizers.chain([0, 20], [0, 20], [True] * 2, 5, min_gap=16) == [[0, 5, 0, 5]]
    assert minimizers.chain([0, 20, 24], [0, 20, 24], [True] * 3, 5, min_match=6) == [[20, 29, 20, 29]]
    assert minimizers.chain([0, 20], [0, 20], [False, True], 5) == [[20, 25, 20, 25]]


GFA = ["H\tVN:Z:1.0", "S\ts1\tACGT\tSN:Z:chr1\tSO:i:0\tSR:i:0", "S\ts2\t*\tLN:i:6\tSN:Z:chr1\tSO:i:4\tSR:i:0", "S\ts3\tGG\tSN:Z:x\tSO:i:0\tSR:i:1", "L\ts1\t+\ts2\t-\t0M", "L\ts1\t+\ts3\t+\t0M", "P\tp\ts1+,s2-\t*"]


def test_graph(spark, tmp_path):
    g = graphs.read_graph(spark, put(tmp_path, "g.gfa", GFA))
    seg, edge = graphs.segments(g), graphs.edges(g)
    assert graphs.version(g).first().version == 1.0
    assert sorted((r.name, r.length, r.sr, r.node_id) for r in seg.collect()) == [("s1", 4, 0, 1), ("s2", 6, 0, 2), ("s3", 2, 1, 3)]
    assert sorted((r.source, r.source_fwd, r.sink, r.sink_fwd) for r in edge.collect()) == [("s1", True, "s2", False), ("s1", True, "s3", True)]
    lines = [r.value for r in graphs.graph_lines(seg, edge, graphs.paths(g)).orderBy("block", "file_ord", "pos").collect()]
    assert lines[1:6] == GFA[1:6] and lines[6] == "P\tp\ts1+,s2-\t*,*"
    ids = edge.select(F.substring("source", 2, 9).cast("long").alias("source"), F.substring("sink", 2, 9).cast("long").alias("sink"))
    nodes = seg.select("node_id", F.col("sr").alias("rank"), F.col("sn").alias("contig"))
    labels = graph.label_nodes(nodes, ids)
    assert {r.node_id: r.contig for r in labels.collect()} == {1: "chr1", 2: "chr1", 3: "chr1"}
    with pytest.raises(ValueError, match="two contigs"):
        graph.label_nodes(spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 1, None)], "node_id long, rank long, contig string"), spark.createDataFrame([(1, 3), (2, 3)], "source long, sink long"))
    gaf = src.parse_gaf(text.read_lines(spark, put(tmp_path, "s.gaf", ["q\t9\t0\t5\t+\tchr1\t10\t2\t7\t5\t5\t60\tcg:Z:5M", "r\t9\t0\t6\t+\t<chr1:4-10\t6\t0\t6\t6\t6\t60\tcg:Z:6M"]))).withColumn("row", F.col("query_name"))
    out = {r.row: r for r in graph.to_nodes(gaf, seg, labels, "row").select("row", src.path_text(F.col("path")).alias("p"), "path_start", "path_end", "path_len", "rc").collect()}
    assert (out["q"].p, out["q"].path_start, out["q"].path_end, out["q"].path_len, out["q"].rc) == (">s1>s2", 2, 7, 10, "chr1")
    assert (out["r"].p, out["r"].path_start) == ("<s2", 0)
    kept, left = graph.trim_segments(seg, edge, 3)
    assert {r.name for r in kept.collect()} == {"s1", "s2"} and left.count() == 1
    assert graph.assembly_stats(spark.createDataFrame([(x,) for x in (2, 3, 5, 10)], "length long")).first()[:6] == (4, 20, 10, 3, 1, 3)
    renamed, _ = graph.renumber(seg, edge, 10)
    assert sorted(r.name for r in renamed.collect()) == ["11", "12", "13"]


def test_tables(spark, tmp_path):
    fa = text.read_fasta(spark, put(tmp_path, "a.fa", [">x one", "ACG", "TT", ">y", "GGG"]))
    assert sorted((r.name, r.description, r.seq) for r in fa.collect()) == [("x", "one", "ACGTT"), ("y", "", "GGG")]
    cut = sequences.windows(sequences.chunks_of(fa), spark.createDataFrame([("x", 1, 3)], "name string, start long, end long"), ["name"]).first()
    assert cut.seq == "CG"
    lens = text.read_lengths(spark, put(tmp_path, "l.tsv", ["a\t5", "b\t7\tz", "a\t6"]), "p_")
    assert sorted((r.name, r.length) for r in lens.collect()) == [("p_a", 6), ("p_b", 7)]
    bed = text.read_bed(spark, put(tmp_path, "b.bed", ["#x", "q\t1\t5\tn", "q\t3\t9"]))
    assert text.mask_totals(bed).first().masked == 10
    lines = text.read_lines(spark, [put(tmp_path, "1.txt", ["b"]), put(tmp_path, "2.txt", ["a"])])
    text.write_lines(lines, f"{tmp_path}/out", text.ORDER, single=True)
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["b", "a"]


def test_compose(spark):
    # two queries on one node, one of them reversed: the first by name stands for the node
    rows = [(1, "a", 100, 10, 30, "+", "n", 20, 0, 20, "20M"), (2, "b", 100, 0, 10, "-", "n", 20, 5, 15, "10M")]
    paf = spark.createDataFrame(rows, "row long, query_name string, query_len long, query_start long, query_end long, strand string, target_name string, target_len long, target_start long, target_end long, cg string")
    got = {r.row: r for r in compose.compose(paf.withColumn("cigar", cigar.parse(F.col("cg"))), "row").collect()}
    assert (got[1].target_name, got[1].target_start, got[1].target_end, got[1].strand) == ("a", 10, 30, "+")
    assert (got[2].target_name, got[2].query_start, got[2].query_end, got[2].target_start, got[2].target_end, got[2].strand) == ("a", 0, 10, 15, 25, "-")


def test_partition(spark):
    cov = spark.createDataFrame([("q", 1000, "c1", 0, 400, 400), ("q", 1000, "c2", 400, 700, 300), ("q", 1000, "c1", 700, 1000, 300), ("r", 1000, "c1", 0, 100, 100), ("s", 100, "c1", 0, 50, 50), ("s", 100, "c2", 50, 99, 49)], "query_name string, query_len long, contig string, start long, end long, cover long")
    got = {r.query_name: r.contig for r in partition.assign(cov, None, [], 0.3, 1.2).collect()}
    assert got == {"q": "c1", "r": "ambiguous", "s": "ambiguous"}
    chunks = sorted((r.query_name, r.contig, r.start, r.end) for r in partition.smooth_chunks(cov, None, [], 0.5, 200).collect() if r.query_name == "q")
    assert chunks == [("q", "c1", 0, 400), ("q", "c2", 400, 700), ("q", "c1", 700, 1000)] or sorted(chunks) == sorted([("q", "c1", 0, 400), ("q", "c2", 400, 700), ("q", "c1", 700, 1000)])
