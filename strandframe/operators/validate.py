"""Checks of alignments against themselves and against sequences. Each returns the rows at fault, or figures by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import cigar
from strandframe.functions.names import equal_bases, reverse_complement
from strandframe.operators import sequences, skew
from strandframe.operators.minimizers import positions


def wrong_spans(paf: DataFrame) -> DataFrame:
    """Rows whose query or target range is not as long as their cigar says, or lies outside its sequence."""
    c = F.col("cigar")
    span = (cigar.query_span(c) != F.col("query_end") - F.col("query_start")) | (cigar.target_span(c) != F.col("target_end") - F.col("target_start"))
    out = (F.col("query_end") > F.col("query_len")) | (F.col("target_end") > F.col("target_len")) | (F.col("query_start") < 0) | (F.col("target_start") < 0)
    return paf.where(span | out)


def wrong_lengths(paf: DataFrame, fasta: DataFrame) -> DataFrame:
    """name, length, found: sequences whose length differs from what rows say, or that are missing (found null)."""
    said = paf.select(F.explode(F.array(F.struct(F.col("query_name").alias("name"), F.col("query_len").alias("length")), F.struct(F.col("target_name").alias("name"), F.col("target_len").alias("length")))).alias("s")).select("s.*").distinct()
    has = fasta.select("name", F.length("seq").cast("bigint").alias("found"))
    return said.join(has, "name", "left").where(~F.col("length").eqNullSafe(F.col("found")))


def base_identity(paf: DataFrame, queries: DataFrame, targets: DataFrame, row: str, n_matches: bool = False) -> DataFrame:
    """row, paired, identity: the paired bases of each row and the share of equal ones, from the chunks of sequences (name, chunk, bases).

    Runs of paired bases are cut at the borders of chunks of either side, so
    that each part looks up one chunk of its query and one of its target.
    """
    back = F.col("strand") == "-"
    along = F.when(back, cigar.flip(F.col("cigar"))).otherwise(F.col("cigar"))
    b = paf.select(row, "query_name", "target_name", "query_start", "target_start", "target_end", back.alias("back"), F.explode(cigar.match_blocks(cigar.placed(along))).alias("b"))
    t0 = F.when(F.col("back"), F.col("target_end") - F.col("b.t1")).otherwise(F.col("target_start") + F.col("b.t0"))
    b = b.select(row, "query_name", "target_name", "back", F.col("b.len").alias("n"), (F.col("query_start") + F.col("b.q0")).alias("q"), t0.alias("t")).where("n > 0")
    # how far into the run the next border is; a reverse target is walked from its end
    size = F.lit(sequences.CHUNK).cast("bigint")
    steps = lambda first: F.when(first < F.col("n"), F.sequence(first, F.col("n") - 1, size)).otherwise(F.array().cast("array<bigint>"))
    left = F.when(F.col("back"), (F.col("t") + F.col("n") - 1) % size + 1).otherwise(size - F.col("t") % size)
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), steps(size - F.col("q") % size), steps(left))))
    parts = b.select("*", cuts.alias("c")).select(row, "query_name", "target_name", "back", "n", "q", "t", "c", F.posexplode("c").alias("i", "u"))
    stop = F.coalesce(F.get("c", F.col("i") + 1), F.col("n"))
    parts = parts.select(
        row, "query_name", "target_name", "back", (stop - F.col("u")).cast("int").alias("n"), (F.col("q") + F.col("u")).alias("q"),
        F.when(F.col("back"), F.col("t") + F.col("n") - stop).otherwise(F.col("t") + F.col("u")).alias("t"), "i", "u",
    )
    both = _bases(_bases(parts, queries, "query_name", "q", F.col("n"), "qs"), targets, "target_name", "t", F.col("n"), "ts")
    equal = equal_bases(F.col("qs"), F.when(F.col("back"), reverse_complement(F.col("ts"))).otherwise(F.col("ts")), n_matches)
    each = both.select(row, "n", equal.alias("equal"))
    return each.groupBy(row).agg(F.sum("n").alias("paired"), (F.sum("equal") / F.sum("n")).alias("identity"))


def _bases(rows: DataFrame, chunks: DataFrame, name: str, at: str, n: Column, into: str) -> DataFrame:
    """rows with the n bases from at on of the sequence name; these lie in the chunk in which they begin. Rows whose sequence is missing are left out."""
    asked = rows.withColumn("__chunk", sequences.chunk_of(F.col(at)))
    side = chunks.select(F.col("name").alias(name), F.col("chunk").alias("__chunk"), F.col("bases").alias("__bases"))
    return skew.lookup(asked, side, [name, "__chunk"]).withColumn(into, F.substring("__bases", sequences.inside(F.col(at)), n.cast("int"))).drop("__chunk", "__bases")


def wrong_minimizers(hits: DataFrame, queries: DataFrame, targets: DataFrame, row: str) -> DataFrame:
    """hits (with query_name; row tells them apart) of which some k-mer differs between query and target, with wrong: the number of these. queries and targets are chunks of sequences; k-mers are no longer than chunks overlap."""
    q, t = positions(F.col("q_start"), F.col("q_off")), positions(F.col("t_start"), F.col("t_off"))
    each = hits.select(row, "query_name", "target_name", "is_reverse", "target_len", "kmer", F.posexplode(F.arrays_zip(q.alias("q"), t.alias("t"))).alias("i", "x"))
    k = F.when(F.col("kmer") <= sequences.TAIL, F.col("kmer")).otherwise(F.raise_error(F.lit("k-mers are longer than chunks overlap")).cast("bigint"))
    at = F.when(F.col("is_reverse"), F.col("target_len") - F.col("x.t") - F.col("kmer")).otherwise(F.col("x.t"))
    each = each.select(row, "query_name", "target_name", "is_reverse", k.alias("k"), "i", F.col("x.q").cast("bigint").alias("q"), at.cast("bigint").alias("t"))
    both = _bases(_bases(each, queries, "query_name", "q", F.col("k"), "qs"), targets, "target_name", "t", F.col("k"), "ts")
    differs = F.upper("qs") != F.upper(F.when(F.col("is_reverse"), reverse_complement(F.col("ts"))).otherwise(F.col("ts")))
    wrong = both.groupBy(row).agg(F.sum(differs.cast("int")).alias("wrong")).where("wrong > 0")
    return hits.join(wrong, row)
