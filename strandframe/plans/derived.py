"""Alignments, masks and graphs derived from the given tables, in Spark and as SQL.

The same expressions make the Spark tables and the common table expressions of
the SQL, so that both engines see equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import cigar

#: From lineitem: block length n, and the parts a M, b I, c M, d D, e M of a cigar.
_PARTS = [
    "concat_ws('.', cast(l_orderkey as string), cast(l_partkey as string), cast(l_suppkey as string), cast(l_linenumber as string), cast(cast(l_quantity as bigint) as string), cast(cast(round(l_extendedprice * 100) as bigint) as string)) as aln_id",
    "concat('q', cast(l_suppkey as string)) as query_name",
    "concat('s', cast(l_partkey as string)) as target_name",
    "case when l_returnflag = 'R' then '-' else '+' end as strand",
    "cast((l_partkey * 7919 + l_orderkey * 104729) % 900000 as bigint) as query_start",
    "cast((l_partkey * 17 + l_orderkey * 31) % 800000 as bigint) as target_start",
    "cast(l_quantity as bigint) * 20 as n",
    "cast(l_linenumber as bigint) as b",
    "cast(floor(cast(l_quantity as bigint) * 20 / 3) as bigint) as a",
    "cast(l_quantity as bigint) * 5 as c",
    "cast(1 + l_partkey % 7 as bigint) as d",
    "cast((l_linenumber * 10) % 61 as bigint) as mapq",
    "case when l_linestatus = 'F' then 'P' else 'S' end as tp",
]
_ROW = [
    "aln_id", "query_name", "cast(1000000 as bigint) as query_len", "query_start", "query_start + n as query_end", "strand", "target_name", "cast(1000000 as bigint) as target_len", "target_start",
    "target_start + n - b + d as target_end", "n - b as num_matching", "n as num_bases", "n as block_len", "mapq", "tp",
    "concat(cast(a as string), 'M', cast(b as string), 'I', cast(c as string), 'M', cast(d as string), 'D', cast(n - a - b - c as string), 'M') as cg", "a", "b", "c", "d", "n - a - b - c as e",
]
_MASK = ["concat('q', cast(o_custkey % 100 as string)) as query_name", "cast((o_orderkey * 7919) % 990000 as bigint) as m_start", "cast((o_orderkey * 7919) % 990000 + 200 + o_custkey % 300 as bigint) as m_end"]
#: Segments from part: rank by size, a contig of ten; and edges to the next parts.
_SEGMENT = [
    "concat('s', cast(p_partkey as string)) as name", "cast(p_partkey as bigint) as node_id", "concat('chr', cast(cast(floor(p_partkey / 10) as bigint) as string)) as sn", "cast((p_partkey % 10) * 100 as bigint) as so",
    "cast(case when p_partkey % 10 = 0 then 0 else 1 + (p_partkey % 10) % 3 end as bigint) as sr", "cast(40 + p_size as bigint) as length",
]


def _sql(exprs: list[str], table: str) -> str:
    return f"select {', '.join(exprs)} from {table}".replace(" as string)", " as varchar)")


#: Common table expressions: aln, mask, seg.
WITH = f"with parts as ({_sql(_PARTS, 'lineitem')}), aln as ({_sql(_ROW, 'parts')}), mask as ({_sql(_MASK, 'orders')}), seg as ({_sql(_SEGMENT, 'part')})"


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAF columns of lineitem's rows, with row key aln_id, cigar and tags."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*_PARTS).selectExpr(*_ROW)
    tag = lambda k, t, v: F.struct(F.lit(k).alias("key"), F.lit(t).alias("type"), v.alias("val"))
    return rows.withColumn("cigar", cigar.parse(F.col("cg"))).withColumn("tags", F.array(tag("tp", "A", F.col("tp")), tag("cg", "Z", F.col("cg"))))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_name, start, end from orders."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*_MASK)
    return rows.select("query_name", F.col("m_start").alias("start"), F.col("m_end").alias("end"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes from part; contigs are runs of ten parts, the first of which has rank 0."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(*_SEGMENT)
    return rows.withColumn("file_ord", F.lit(0)).withColumn("pos", F.col("node_id")).withColumn("sequence", F.lit("*"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts of one contig: to the next one and to the third."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("bigint").alias("source"))
    out = rows.select("source", F.explode(F.array(F.col("source") + 1, F.col("source") + 3)).alias("sink"))
    return out.where(F.floor(F.col("source") / 10) == F.floor(F.col("sink") / 10)).join(rows.select(F.col("source").alias("sink")), "sink").select("source", "sink")


#: Letters and the bases that stand for them in sequences made of documents.
_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", ("acgt" * 7)[:26] * 2
#: Common table expression: fa, a sequence for each document.
FASTA = f"fa as (select doc_id, concat('d', doc_id) as name, translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), '{_LETTERS}', '{_BASES}') as seq from documents)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, name, seq: the letters of each document as bases."""
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.translate(letters, _LETTERS, _BASES).alias("seq"))
