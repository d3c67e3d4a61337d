"""GFA1 to GFA2 and back."""

import pytest

from strandframe.operators import gfa
from strandframe.sources import formats, graphs

ONE = [
    "H\tVN:Z:1.0", "H\tau:Z:me", "S\t1\tACGTAC\tLN:i:6", "S\t2\tGGGG", "S\t3\t*\tLN:i:20", "L\t1\t+\t2\t-\t2M1D1M", "L\t2\t+\t3\t+\t0M", "L\t1\t-\t3\t+\t*\tab:Z:x", "C\t3\t+\t2\t+\t5\t4M", "P\tp1\t1+,2-\t6M,4M",
]
TWO = [
    "H\tVN:Z:2.0", "H\tau:Z:me", "S\t1\t6\tACGTAC\tLN:i:6", "S\t2\t4\tGGGG", "S\t3\t20\t*\tLN:i:20", "E\t5\t1+\t2-\t2\t6$\t0\t3\t2M1D1M", "E\t6\t2+\t3+\t4$\t4$\t0\t0\t0M", "E\t7\t1-\t3+\t6$\t6$\t0\t0\t*\tab:Z:x",
    "E\t8\t3+\t2+\t5\t9\t0\t4$\t4M", "O\tp1\t1+ 2-",
]
MORE = ["O\tg1\tg2- 3+", "O\tg2\t1+ g3+ 2-\txx:i:1", "O\tg3\t3-", "U\tu1\t1 2 g1", "G\tgap\t1\t2\t17\t*", "F\t1\tread+\t0\t4\t2\t6\t4M\tyy:Z:a"]


def table(spark, tmp_path, name, lines):
    formats.register(spark)
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return spark.read.format("gfa").option("split", 64).load(str(tmp_path / name))


def lines(df):
    return [r.value for r in df.orderBy("block", "file_ord", "pos").collect()]


def test_round_trip(spark, tmp_path):
    two = lines(gfa.convert(table(spark, tmp_path, "a.gfa", ONE), 2))
    assert two == TWO
    assert lines(gfa.convert(table(spark, tmp_path, "b.gfa", two), 1)) == ONE
    assert lines(gfa.convert(table(spark, tmp_path, "b.gfa", two), 2)) == TWO
    assert lines(gfa.convert(table(spark, tmp_path, "a.gfa", ONE), 1)) == ONE


def test_all_kinds(spark, tmp_path):
    """Groups in groups open from either side; what GFA1 lacks is left out."""
    g = table(spark, tmp_path, "c.gfa", [*TWO, *MORE])
    assert sorted(lines(gfa.convert(g, 2))) == sorted([*TWO, *MORE])
    one = lines(gfa.convert(g, 1))
    assert one[:-3] == ONE and one[-3:] == ["P\tg1\t2+,3+,1-,3+\t4M,0M,6M,0M", "P\tg2\t1+,3-,2-\t6M,0M,4M\txx:i:1", "P\tg3\t3-\t0M"]
    loop = graphs.groups(table(spark, tmp_path, "d.gfa", ["O\ta\tb+", "O\tb\t1+ a-"]))
    with pytest.raises(ValueError, match="holds itself"):
        gfa.flat_groups(loop)
    assert gfa.base_id(graphs.segments(table(spark, tmp_path, "e.gfa", ["S\tx\tA", "S\ty\tC"]))).first().base == 2


def test_types(spark, tmp_path):
    g = table(spark, tmp_path, "f.gfa", ["S\ta\t10\t*", "S\tb\t6\t*", "E\te1\ta+\tb+\t7\t10$\t0\t3\t3M", "E\te2\ta+\tb+\t2\t8\t0\t6$\t6M", "E\te3\ta+\tb+\t2\t5\t1\t4\t3M", "E\t*\ta+\tb+\t4\t10$\t0\t6$\t6M"])
    assert [r.type for r in gfa.to_gfa1(graphs.edges(g)).orderBy("pos").collect()] == [1, 2, 3, 1]
    assert [r.id for r in gfa.to_gfa2(graphs.segments(g), graphs.edges(g)).orderBy("pos").collect()] == ["e1", "e2", "e3", "3"]
