"""One file for each contig, and what is let through to them."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import graph, partition
from strandframe.sources import contig_files, formats


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_round_trip(spark, tmp_path, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice(["a", "b", "b", "b", None]), i, rnd.choice(["", "x", "é\ty"]) + str(i)) for i in range(400)]
    lines = spark.createDataFrame(rows, "contig string, pos int, value string").repartition(5)
    names = spark.createDataFrame([("a",), ("none",), (None,)], "contig string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        contig_files.write(lines, f"{tmp_path}/p_", ".paf", ["pos"], names)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["p_a.paf", "p_b.paf", "p_none.paf"]
    for c in "ab":
        assert (tmp_path / f"p_{c}.paf").read_text() == "".join(v + "\n" for k, _, v in rows if k == c)
    assert (tmp_path / "p_none.paf").read_text() == ""


def test_no_lines_and_bad_names(spark, tmp_path):
    none = spark.createDataFrame([], "contig string, pos int, value string")
    contig_files.write(none, f"{tmp_path}/", ".paf", ["pos"], spark.createDataFrame([("a",)], "contig string"))
    assert [p.name for p in tmp_path.iterdir()] == ["a.paf"]
    with pytest.raises(Exception, match="slash"):
        contig_files.write(spark.createDataFrame([("a/b", 1, "x")], none.schema), f"{tmp_path}/", ".paf", ["pos"])


def test_gate(spark):
    rows = [(1, "q", "t1", "c1"), (2, "q", "t2", "c1"), (3, "q", "q", "c1"), (4, "q", "t2", "c2"), (5, "q", "t1", "amb"), (6, "q", "t9", "amb"), (7, "q", "q", "c3")]
    routed = spark.createDataFrame(rows, "id int, query_name string, target_name string, contig string")
    targets = spark.createDataFrame([("t1", "c1"), ("t2", "c2")], "name string, contig string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(partition.write_gate(routed, targets, None, "amb")) == [1, 3, 4, 5, 6, 7]
    visited = spark.createDataFrame([("c1",), ("c1",)], "contig string")
    assert ids(partition.write_gate(routed, targets, visited, "amb")) == [1, 3, 5, 6]
    assert ids(partition.write_gate(routed.where("id < 5"), targets, visited)) == [1, 3]
    with pytest.raises(Exception, match="no contig of target t9"):
        partition.write_gate(routed, targets).collect()
    names = partition.contig_names(routed.where("id < 5"), targets.withColumnRenamed("contig", "contig"))
    assert sorted((r.contig, r["rank"], r.value) for r in names.collect()) == [("c1", 0, "q"), ("c1", 1, "t1"), ("c2", 0, "q"), ("c2", 1, "t2")]


def test_graph_files(spark, tmp_path):
    formats.register(spark)
    lines = ["H\tVN:Z:1.0", "S\ts1\tACGT", "S\ts2\tGG", "S\ts30\tT", "L\ts1\t+\ts2\t-\t0M", "P\tp\ts1+\t*"]
    (tmp_path / "g.gfa").write_text("\n".join(lines))
    table = spark.read.format("gfa").load(str(tmp_path / "g.gfa"))
    labels = spark.createDataFrame([(1, "c1"), (2, "c1"), (30, "c2")], "node_id long, contig string")
    (tmp_path / "out").mkdir()
    contig_files.write(graph.split_lines(table, labels), f"{tmp_path}/out/", ".gfa", ["file_ord", "pos"])
    assert (tmp_path / "out/c1.gfa").read_text().split("\n") == [lines[1], lines[2], lines[4], ""]
    assert (tmp_path / "out/c2.gfa").read_text() == lines[3] + "\n"
    for wrong in (labels.where("node_id <> 30"), labels.withColumn("contig", F.col("node_id").cast("string"))):
        with pytest.raises(Exception, match="not of one contig"):
            graph.split_lines(table, wrong).collect()
