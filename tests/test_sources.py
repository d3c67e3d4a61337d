"""Formats read by ranges of bytes."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandframe.sources import alignments, formats, graphs

PAF = [
    "q1\t100\t0\t20\t+\tt1\t50\t5\t23\t18\t20\t60\ttp:A:P\tcg:Z:10M2I8M\tAS:i:7",
    "q1\t100\t50\t60\t-\tt1\t50\t30\t42\t10\t12\t255\ttp:A:S\txx:Z:a:b:\tcg:Z:4M2D6M",
    "é\t9\t1\t2\t+\tt\t9\t1\t2\t1\t1\t0",
]
GAF = ["g1\t30\t0\t25\t+\t>a:0-10<b\t20\t0\t20\t22\t25\t60\ttp:A:P\tcg:Z:10M5I3D7M", "*\tminimizers\t", "g3\t9\t*\t*\t*\t*\t*\t*\t*\t*\t*\t255"]


@pytest.fixture(scope="module")
def session(spark):
    formats.register(spark)
    return spark


@pytest.mark.parametrize("split", [1, 2, 3, 7, 20, 1000])
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_lines_of_any_ranges(session, tmp_path, split, ends):
    rnd = random.Random(split)
    lines = ["x" * rnd.choice([0, 1, 2, 5, 30]) + rnd.choice(["", "é", "ß€"]) for _ in range(60)] + ["last"]
    p = tmp_path / "a.txt"
    p.write_bytes(ends.join(lines).encode())
    got = [(r.pos, r.value) for part in formats.ranges([str(p)], split) for pos, data in formats.whole_lines(part, 4) for r in _rows(pos, data)]
    at, exp = 0, []
    for line in lines:
        exp.append((at, line))
        at += len((line + ends).encode())
    assert got == exp
    rows = session.read.format("lines").option("split", split).load(str(p)).orderBy("file_ord", "pos").collect() if split > 19 else []
    assert [(r.pos, r.value) for r in rows] == (exp if split > 19 else [])


def _rows(pos, data):
    from pyspark.sql import Row

    at, lines = formats.arrow_lines(pos, data)
    return [Row(pos=int(a), value=t) for a, t in zip(at, lines.to_pylist(), strict=True)]


def test_paf(session, tmp_path):
    (tmp_path / "a.paf").write_text("\n".join(PAF) + "\n")
    with gzip.open(tmp_path / "b.paf.gz", "wt") as f:
        f.write("\n\n".join(PAF))
    rows = session.read.format("paf").option("split", 50).load(f"{tmp_path}/a.paf,{tmp_path}/b.paf.gz").orderBy("file_ord", "pos")
    assert [r.value for r in rows.collect()] == PAF * 2
    assert [r.pos for r in rows.where("file_ord = 0").collect()] == [0, len(PAF[0]) + 1, len(PAF[0]) + len(PAF[1]) + 2]
    old = alignments.read_paf(session, str(tmp_path / "a.paf")).orderBy("file_ord", "pos").drop("file_ord", "pos", "cigar")
    assert rows.where("file_ord = 0").select(*old.columns).collect() == old.collect()
    assert session.read.format("paf").load(f"{tmp_path}/*.paf*").count() == 6 and session.read.format("paf").load(str(tmp_path)).count() == 6
    (tmp_path / "bad.paf").write_text("a\tb\n" + PAF[0])
    with pytest.raises(Exception, match="not PAF"):
        session.read.format("paf").load(f"{tmp_path}/bad.paf").collect()
    assert session.read.format("paf").option("strict", "false").load(f"{tmp_path}/bad.paf").count() == 1
    (tmp_path / "none.paf").write_text("")
    assert session.read.format("paf").load(f"{tmp_path}/none.paf").count() == 0


def test_gaf_and_bed(session, tmp_path):
    (tmp_path / "a.gaf").write_text("\n".join(GAF) + "\n")
    got = session.read.format("gaf").load(f"{tmp_path}/a.gaf").orderBy("pos").collect()
    old = alignments.read_gaf(session, str(tmp_path / "a.gaf")).orderBy("pos").collect()
    for a, b in zip(got, old, strict=True):
        assert (a.query_name, a.query_end, a.strand, a.path_len, a.matches, a.mapq, a.tags) == (b.query_name, b.query_end, b.strand, b.path_len, b.matches, b.mapq, b.tags)
    (tmp_path / "a.bed").write_text("#c\ntrack x\nq 1\t5 name\nr\t2\t3\nshort\t1\n")
    assert sorted(map(tuple, session.read.format("bed").load(f"{tmp_path}/a.bed").collect())) == [("q", 1, 5), ("r", 2, 3)]


def test_graph_kinds(session, tmp_path):
    lines = ["H\tVN:Z:1.0", "S\ts1\tACGT\tLN:i:4", "S\ts2\t*\tLN:i:9", "L\ts1\t+\ts2\t-\t0M", "x\tkey\tinfo", "a\ts1\t3\tref\t+\t9", "# note"]
    p = tmp_path / "g.gfa"
    p.write_text("\n".join(lines) + "\n")
    table = session.read.format("gfa").load(str(p))
    assert [r.value for r in table.orderBy("pos").collect()] == lines
    chosen = session.read.format("gfa").option("kinds", "SL").load(str(p))
    assert [r.kind for r in chosen.orderBy("pos").collect()] == ["S", "S", "L"]
    # one table in several places of a query
    assert table.where("kind = 'S'").unionByName(table.where("kind = 'L'")).count() == 3
    assert [r.name for r in graphs.segments(table).orderBy("pos").collect()] == ["s1", "s2"]
    assert graphs.edges(table).select("source", "sink", "source_fwd", "sink_fwd").first() == ("s1", "s2", True, False)
    p.write_text("\n".join([*lines, "Q\tunknown"]) + "\n")
    with pytest.raises(Exception, match="not a graph line"):
        session.read.format("gfa").load(str(p)).where("kind = 'S'").collect()
    assert session.read.format("gfa").option("strict", "false").load(str(p)).where(F.col("kind").isin("S", "L")).count() == 3
