"""Sequences in chunks, their index, and checks that read windows of them."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions import cigar
from strandframe.operators import graph, sequences, skew, validate
from strandframe.sources import formats, text

RC = str.maketrans("ACGT", "TGCA")


def letters(rnd, n):
    return "".join(rnd.choices("ACGT", k=n))


@pytest.fixture
def small(monkeypatch):
    """Chunks of 16 bases that overlap by 8."""
    monkeypatch.setattr(sequences, "CHUNK", 16)
    monkeypatch.setattr(sequences, "TAIL", 8)


def fasta(rnd, ends="\n"):
    records, out, lines = [], {}, b""
    for i in range(12):
        name, seq, width = f"r{i}", letters(rnd, rnd.choice([0, 1, 15, 16, 17, 40, 100])), rnd.choice([5, 16, 1000])
        records.append((name, seq))
        lines += f">{name} some words {i}{ends}".encode()
        offset = len(lines)
        for k in range(0, len(seq), width):
            lines += (seq[k : k + width] + ends).encode()
        chars = min(width, len(seq))
        out[name] = (len(seq), offset, chars, chars + len(ends) if seq else 0)
    return records, out, lines


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [1, 3, 17, 60, 1 << 20])
def test_pieces_of_any_ranges(tmp_path, split, ends):
    """Each base and header is met once, whatever the ranges and blocks."""
    records, out, lines = fasta(random.Random(split), ends)
    p = tmp_path / "a.fa"
    p.write_bytes(lines)
    name, at, got = None, 0, {}
    for part in formats.ranges([str(p)], split):
        first = True
        for batch in formats._fasta(part, 7):
            for r in batch.to_pylist():
                assert r["record"] > 0 or first or name is not None
                if r["record"] and not r["bases"] and r["eol"] is None:
                    name = r["name"]
                    got[name] = ""
                    assert r["pos"] == out[name][1]
                elif r["bases"]:
                    got[name] += r["bases"]
    assert got == dict(records)


@pytest.mark.parametrize("split", [13, 64, 1 << 20])
def test_index_and_chunks(spark, tmp_path, small, split):
    records, out, lines = fasta(random.Random(split + 1))
    lines += b">r0 again\nACGTA\nCC"  # the last record of a name counts
    p = tmp_path / "a.fa"
    p.write_bytes(lines)
    exp, seqs = out | {"r0": (7, len(lines) - 8, 5, 6)}, dict(records) | {"r0": "ACGTACC"}
    pieces = sequences.read_pieces(spark, str(p), split)
    found = sequences.index(pieces)
    assert {r["name"]: (r["length"], r["offset"], r["line_chars"], r["line_bytes"]) for r in found.collect()} == exp
    text.write_lines(sequences.index_lines(found), str(tmp_path / "fai"), ["offset"])
    back = sequences.read_index(text.read_lines(spark, str(tmp_path / "fai")))
    assert {r["name"]: (r["length"], r["offset"], r["line_chars"], r["line_bytes"]) for r in back.collect()} == exp
    for r in back.withColumn("b", sequences.byte_range(F.lit(1), F.col("length"))).where("length > 1").collect():
        assert lines[r.b["first"] : r.b["last"]].replace(b"\n", b"").decode() == seqs[r["name"]][1:]
    with pytest.raises(Exception, match="not a line of an index"):
        sequences.read_index(spark.createDataFrame([("a\t1",)], "value string")).collect()

    chunks = sequences.read_chunks(spark, str(p), split)
    got = {(r["name"], r["chunk"]): r["bases"] for r in chunks.collect()}
    assert got == {(n, c): s[16 * c : 16 * c + 24] for n, s in seqs.items() for c in range(max(1, -(-len(s) // 16)))}
    table = spark.createDataFrame(list(seqs.items()), "name string, seq string")
    assert {(r["name"], r["chunk"]): r["bases"] for r in sequences.chunks_of(table).collect()} == got
    assert {r["name"]: r["length"] for r in sequences.lengths(chunks).collect()} == {n: len(s) for n, s in seqs.items()}
    assert {r["name"]: r["seq"] for r in sequences.whole(chunks, table).collect()} == seqs
    asked = [(i, n, s, s + k) for i, (n, s, k) in enumerate((n, s, k) for n in [*seqs, "none"] for s in (-3, 0, 5, 15, 16, 90) for k in (0, 1, 17, 60))]
    cut = sequences.windows(chunks, spark.createDataFrame(asked, "id int, name string, start long, end long"), ["id"]).collect()
    assert {r.id: r.seq for r in cut} == {i: seqs.get(n, "")[max(0, s) : max(0, e)] for i, n, s, e in asked}
    for width in (0, 5, 8):
        shown = "".join(r.value + ("\n" if width else "") for r in sequences.fasta_lines(chunks.where("name = 'r4'"), width).orderBy("chunk").collect())
        assert shown.replace("\n", "") == ">r4" + seqs["r4"] and (not width or all(len(x) == width for x in shown.split("\n")[1:-2]))


def test_gzip(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(">a\nACGT\nAC\n>b\n")
    assert sorted(map(tuple, sequences.read_chunks(spark, str(tmp_path / "a.fa.gz")).collect())) == [("a", 0, "ACGTAC"), ("b", 0, "")]


def test_identity_by_chunks(spark, small):
    """Runs that cross borders on both sides, on both strands, against whole strings."""
    rnd = random.Random(3)
    q, rows, targets, exp = letters(rnd, 300), [], [], {}
    for i in range(60):
        s, back = rnd.randint(0, 100), rnd.random() < 0.5
        parts, at, t, same = [], s, "", 0
        for _ in range(rnd.randint(1, 5)):
            op, n = rnd.choice("MMID"), rnd.randint(1, 50)
            if op == "M":
                made = "".join(c if rnd.random() < 0.8 else rnd.choice("ACGT") for c in q[at : at + n])
                n = len(made)
                same += sum(a == b for a, b in zip(made, q[at : at + n], strict=True))
                t, at = t + made, at + n
            elif op == "I":
                n = min(n, 300 - at)
                at += n
            else:
                t += letters(rnd, n)
            if n:
                parts.append((op, n))
        paired = sum(n for op, n in parts if op == "M")
        before, after = letters(rnd, rnd.randint(0, 40)), letters(rnd, rnd.randint(0, 40))
        whole = before + t + after
        ts = len(before)
        if back:
            whole, ts, parts = whole[::-1].translate(RC), len(after), parts[::-1]
        targets.append((f"t{i}", whole))
        rows.append((i, "q", 300, s, at, "-" if back else "+", f"t{i}", len(whole), ts, ts + len(t), "".join(f"{n}{op}" for op, n in parts)))
        if paired:
            exp[i] = (paired, same / paired)
    paf = spark.createDataFrame(rows, "row int, query_name string, query_len long, query_start long, query_end long, strand string, target_name string, target_len long, target_start long, target_end long, cg string")
    paf = paf.withColumn("cigar", cigar.parse(F.col("cg")))
    table = lambda x: sequences.chunks_of(spark.createDataFrame(x, "name string, seq string"))
    got = {r.row: (r.paired, r.identity) for r in validate.base_identity(paf, table([("q", q)]), table(targets), "row").collect()}
    assert got == {i: (n, pytest.approx(x)) for i, (n, x) in exp.items()}


def test_minimizers_by_chunks(spark, small):
    rnd = random.Random(4)
    q, rows, exp = letters(rnd, 200), [], {}
    t = "".join(c if rnd.random() < 0.97 else rnd.choice("ACGT") for c in q)
    for i in range(40):
        back, at, off = rnd.random() < 0.5, rnd.randint(0, 60), [rnd.randint(1, 20) for _ in range(5)]
        shift = rnd.choice([0, 0, 1])
        places = [at + sum(off[:k]) for k in range(6)]
        wrong = sum(q[p : p + 8] != t[p + shift : p + shift + 8] for p in places)
        rows.append((i, "q", "tr" if back else "t", back, 200, at, at + shift, off, off, 8))
        if wrong:
            exp[i] = wrong
    hits = spark.createDataFrame(rows, "id int, query_name string, target_name string, is_reverse boolean, target_len long, q_start long, t_start long, q_off array<int>, t_off array<int>, kmer long")
    chunks = sequences.chunks_of(spark.createDataFrame([("q", q), ("t", t), ("tr", t[::-1].translate(RC))], "name string, seq string"))
    assert {r.id: r.wrong for r in validate.wrong_minimizers(hits, chunks, chunks, "id").collect()} == exp
    with pytest.raises(Exception, match="longer than"):
        validate.wrong_minimizers(hits.withColumn("kmer", F.lit(9).cast("bigint")), chunks, chunks, "id").collect()


def test_fill(spark):
    chunks = sequences.chunks_of(spark.createDataFrame([("s1", "ACGT" * 9000), ("s2", "CC")], "name string, seq string"))
    segments = spark.createDataFrame([("s1", "*", 5), ("s2", "GG", 2), ("s3", "*", 7)], "name string, sequence string, length long")
    got = {r["name"]: (r["sequence"], r["length"]) for r in graph.fill_sequences(segments, chunks).collect()}
    assert got == {"s1": ("ACGT" * 9000, 36_000), "s2": ("GG", 2), "s3": ("*", 7)}


def test_hot_key(spark):
    left = spark.range(5000).select((F.col("id") % 10 * F.when(F.col("id") % 3 == 0, 1).otherwise(0)).alias("k"), "id")
    right = spark.range(8).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    for how in ("inner", "left"):
        got = skew.lookup(left, right, ["k"], how, 100)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = skew.lookup(left, right, ["k"], "inner", 100).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in parts) < 2500
