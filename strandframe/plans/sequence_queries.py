"""Queries over sequences that derived.py makes of documents, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import cigar
from strandframe.operators import partition, sequences, validate
from strandframe.plans import derived
from strandframe.plans.queries import query
from strandframe.scratch import Scratch
from strandframe.sources import contig_files

WITH = f"with {derived.FASTA}"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.chunks_of(derived.sequences(spark, sf_dir).select("name", "seq"))


@query(WITH + """, w as (select name, seq, cast(k as int) as k, (doc_id * 7919 + k * 997) % 4000 as s, 100 + k * 9000 as n from fa, range(3) t(k))
    select name, k, cast(s as bigint) as start, cast(length(substr(seq, s + 1, n)) as bigint) as bases, md5(substr(seq, s + 1, n)) as digest from w""")  # fmt: skip
def fasta_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three windows of each sequence, the longest over two chunks."""
    rows = derived.sequences(spark, sf_dir).select("name", "doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    start = (F.col("doc_id") * 7919 + F.col("k") * 997) % 4000
    ranges = rows.select("name", "k", start.cast("bigint").alias("start"), (start + 100 + F.col("k") * 9000).cast("bigint").alias("end"))
    out = sequences.windows(_chunks(spark, sf_dir), ranges, ["name", "k"])
    return out.select("name", "k", "start", F.length("seq").cast("bigint").alias("bases"), F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(WITH + """ select name, cast(length(seq) as bigint) as length, cast(least(length(seq), 60) as int) as line_chars,
    cast(case when seq = '' then 0 else least(length(seq), 60) + 1 end as int) as line_bytes, md5(seq) as digest from fa""")  # fmt: skip
def fasta_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences written as FASTA in lines of 60, read by ranges of bytes into an index and chunks."""
    folder = Scratch(spark, "fasta").path("files")
    lines = sequences.fasta_lines(_chunks(spark, sf_dir), 60)
    lines.repartitionByRange("name").sortWithinPartitions("name", "chunk").select("value").write.text(folder)
    pieces = Scratch(spark, "fasta").save(sequences.read_pieces(spark, folder, 1 << 18), "pieces")
    found = sequences.index(pieces)
    digest = F.md5(F.col("seq").cast("binary")).alias("digest")
    wholes = sequences.windows(sequences.join_pieces(pieces), found.select("name", F.lit(0).cast("bigint").alias("start"), F.col("length").alias("end")), ["name"])
    return found.select("name", "length", "line_chars", "line_bytes").join(wholes.select("name", digest), "name")


@query(WITH + """, p as (select a.doc_id, a.doc_id % 2 = 1 as rev, a.seq as q, b.seq as t, a.doc_id * 31 % 50 as qs, a.doc_id * 17 % 60 as ts, a.doc_id * 17 % 60 + 315 as te
        from fa a join fa b on b.doc_id = a.doc_id + 1 where length(a.seq) >= 400 and length(b.seq) >= 400),
    blk(rev, q0, t0, n) as (values (false, 0, 0, 100), (false, 107, 100, 150), (false, 257, 255, 60), (true, 0, 0, 60), (true, 60, 65, 150), (true, 217, 215, 100)),
    e as (select doc_id, substr(q, qs + q0 + u + 1, 1) = case when p.rev then translate(substr(t, te - t0 - u, 1), 'acgt', 'tgca') else substr(t, ts + t0 + u + 1, 1) end as same
        from p join blk on p.rev = blk.rev, range(150) r(u) where u < n)
    select doc_id, cast(count(*) as bigint) as paired, sum(same::int) / count(*)::double as identity from e group by doc_id""")  # fmt: skip
def cigar_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases that agree along cigars between each document and the next, on both strands."""
    fa = derived.sequences(spark, sf_dir)
    some = fa.select("doc_id", "name", F.length("seq").cast("bigint").alias("n")).where("n >= 400")
    pairs = some.join(some.select((F.col("doc_id") - 1).alias("doc_id"), F.col("name").alias("target_name"), F.col("n").alias("target_len")), "doc_id")
    qs, ts = F.col("doc_id") * 31 % 50, F.col("doc_id") * 17 % 60
    paf = pairs.select(
        "doc_id", F.col("name").alias("query_name"), F.col("n").alias("query_len"), qs.alias("query_start"), (qs + 317).alias("query_end"), F.when(F.col("doc_id") % 2 == 1, "-").otherwise("+").alias("strand"),
        "target_name", "target_len", ts.alias("target_start"), (ts + 315).alias("target_end"), cigar.parse(F.lit("100M7I150M5D60M")).alias("cigar"),
    )
    chunks = _chunks(spark, sf_dir)
    return validate.base_identity(paf, chunks, chunks, "doc_id")


@query(WITH + """, h as (select *, length(seq) as n, doc_id % 2 = 1 as rev, doc_id * 13 % 300 as qs, case when doc_id % 3 = 0 then 1 else 0 end as d from fa where length(seq) >= 400),
    m as (select doc_id, substr(seq, qs + o + 1, 15) as q, case when rev then translate(reverse(substr(seq, n - (qs + d + o) - 15 + 1, 15)), 'acgt', 'tgca') else substr(seq, qs + d + o + 1, 15) end as t from h, (values (0), (5), (12), (21)) v(o))
    select doc_id, cast(sum((q <> t)::int) as bigint) as wrong from m group by doc_id having sum((q <> t)::int) > 0""")  # fmt: skip
def minimizer_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimizers of each document against itself, some of them shifted or on the other strand."""
    off = F.array(*map(F.lit, (5, 7, 9)))
    qs = F.col("doc_id") * 13 % 300
    rows = derived.sequences(spark, sf_dir).withColumn("n", F.length("seq").cast("bigint")).where("n >= 400")
    hits = rows.select(
        "doc_id", F.col("name").alias("query_name"), F.col("name").alias("target_name"), F.col("n").alias("target_len"), (F.col("doc_id") % 2 == 1).alias("is_reverse"), qs.alias("q_start"),
        (qs + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("t_start"), off.alias("q_off"), off.alias("t_off"), F.lit(15).cast("bigint").alias("kmer"),
    )
    chunks = _chunks(spark, sf_dir)
    return validate.wrong_minimizers(hits, chunks, chunks, "doc_id").select("doc_id", "wrong")


_ROUTED = """with """ + derived.WITH[5:] + """, ch as (select query_name, 'k' || i as contig, i * 250000 as cs, (i + 1) * 250000 as ce from (select distinct query_name from aln), range(4) t(i)),
    m as (select aln_id, count(*) as n, min(cs) as cs, min(ce) as ce, min(contig) as contig from aln join ch using (query_name) where query_start < ce and cs < query_end group by all),
    g as (select contig, concat(query_name, ':', m.cs + 1, '-', m.ce) as query_name, query_start - m.cs as s, query_end - m.cs as e, strand, case when b = 1 then query_name else target_name end as target_name, aln_id
        from aln join m using (aln_id) where n = 1 and (contig = 'k3' or (contig in ('k0', 'k1') and (b = 1 or contig = 'k' || cast(cast(substr(target_name, 2) as bigint) % 4 as varchar)))))
    select contig, concat_ws(chr(9), query_name, 250000, s, e, strand, target_name, aln_id) as value from g"""


@query(_ROUTED)
def routed_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments routed by the chunk of their query, let through by the contig of their target, written to a file for each contig, and read back."""
    paf = derived.alignments(spark, sf_dir)
    i = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint")))
    chunks = paf.select("query_name", "query_len").distinct().select("query_name", "query_len", i.alias("i"))
    chunks = chunks.select("query_name", "query_len", F.concat(F.lit("k"), F.col("i").cast("string")).alias("contig"), (F.col("i") * 250000).alias("start"), ((F.col("i") + 1) * 250000).alias("end"))
    targets = paf.select(F.col("target_name").alias("name")).distinct().withColumn("contig", F.concat(F.lit("k"), (F.substring("name", 2, 20).cast("bigint") % 4).cast("string")))
    names = spark.createDataFrame([("k0",), ("k1",), ("k2",), ("k3",)], "contig string")
    own = paf.withColumn("target_name", F.when(F.col("b") == 1, F.col("query_name")).otherwise(F.col("target_name")))
    written = partition.write_gate(partition.route(own, chunks, "aln_id"), targets, names.where("contig in ('k0', 'k1')"), "k3")
    rows = partition.rebase(written)
    value = F.concat_ws("\t", *[F.col(c).cast("string") for c in ("query_name", "query_len", "query_start", "query_end", "strand", "target_name", "aln_id")])
    folder = Scratch(spark, "contigs").path("files")
    contig_files.write(rows.select("contig", "aln_id", value.alias("value")), folder + "/by_", ".txt", ["aln_id"], names)
    lines = spark.read.text(folder + "/by_*.txt")
    return lines.select(F.regexp_extract(F.input_file_name(), r"by_([^/]*)\.txt", 1).alias("contig"), "value")
