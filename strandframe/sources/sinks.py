"""Lines of result tables, as column value; write them with text.write_lines or text.write_by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandframe.functions.names import rounded


def bed_lines(ranges: DataFrame, name: str = "query_name") -> DataFrame:
    """name, start, end, and label if there is one."""
    cols = [F.col(name), F.col("start").cast("string"), F.col("end").cast("string"), *([F.col("label")] if "label" in ranges.columns else [])]
    return ranges.select(F.concat_ws("\t", *cols).alias("value"))


def coverage_lines(summary: DataFrame) -> DataFrame:
    """rank and value: a title, the names of the columns, and a line for each query."""
    head = summary.sparkSession.createDataFrame([(0, "# coverage of queries"), (1, "query-name\tpct-coverage\tmax-gap\tavg-gap")], "rank int, value string")
    return head.unionByName(summary.select(F.lit(2).alias("rank"), F.concat_ws("\t", "query_name", rounded(F.col("coverage"), 6), F.col("max_gap").cast("string"), F.col("avg_gap").cast("string")).alias("value")))


def contig_map_lines(labels: DataFrame) -> DataFrame:
    """node_id and value: S and the node's number, and its contig."""
    return labels.select("node_id", F.concat(F.lit("S"), F.col("node_id").cast("string"), F.lit("\t"), F.col("contig")).alias("value"))


def read_contig_map(lines: DataFrame) -> DataFrame:
    """node_id, contig from lines of contig_map_lines."""
    t = F.split("value", "\t")
    return lines.select(F.regexp_replace(t[0], "^S", "").cast("bigint").alias("node_id"), t[1].alias("contig"))


def length_lines(lengths: DataFrame) -> DataFrame:
    return lengths.select("name", F.concat_ws("\t", "name", F.col("length").cast("string")).alias("value"))


def run_totals(paf: DataFrame) -> DataFrame:
    """rows, matches, bases, queries, targets of a table of alignments, all exact."""
    return paf.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("num_matching"), F.lit(0)).alias("matches"), F.coalesce(F.sum("num_bases"), F.lit(0)).alias("bases"),
        F.count_distinct("query_name").alias("queries"), F.count_distinct("target_name").alias("targets"),
    )


def _totals(more: str = "", keep: Column | None = None) -> list[Column]:
    span = F.col("query_end") - F.col("query_start")
    one = (lambda c: c) if keep is None else (lambda c: F.when(keep, c))
    return [F.count(one(F.lit(1))).alias("rows" + more), F.coalesce(F.sum(one(span)), F.lit(0)).alias("bases" + more)]


def loss_totals(paf: DataFrame, keep: Column) -> DataFrame:
    """rows, bases, rows_left, bases_left, bases_lost: query bases of alignments before and after a filter, in one pass."""
    return paf.agg(*_totals(), *_totals("_left", keep)).withColumn("bases_lost", F.col("bases") - F.col("bases_left"))


def observed_losses(paf: DataFrame, step: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None]) -> dict[str, int]:
    """Write what step (a filter or a mask) makes of paf, and return loss_totals' figures, which are counted while the rows pass by."""
    before, after = Observation(), Observation()
    write(step(paf.observe(before, *_totals())).observe(after, *_totals()))
    found, left = before.get, after.get
    return {"rows": found["rows"], "bases": found["bases"], "rows_left": left["rows"], "bases_left": left["bases"], "bases_lost": found["bases"] - left["bases"]}


def fasta_lines(fasta: DataFrame, width: int = 0) -> DataFrame:
    """name and value: a record's header and its sequence, in lines of width letters if that is given."""
    head = F.concat(F.lit(">"), F.concat_ws(" ", "name", F.nullif(F.col("description"), F.lit("")))) if "description" in fasta.columns else F.concat(F.lit(">"), F.col("name"))
    seq = F.coalesce("seq", F.lit(""))
    if width:
        seq = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    return fasta.select("name", F.concat(head, F.lit("\n"), seq).alias("value"))
