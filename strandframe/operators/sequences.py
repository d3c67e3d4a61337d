"""Sequences in chunks, and windows of them.

A sequence is rows of (name, chunk, bases): chunk c holds the bases from
c * CHUNK on, and TAIL more than CHUNK, so that short windows lie in the chunk
in which they begin. No row or task holds a whole sequence, be it a chromosome,
and a window reads the chunks that it touches. Chunks come from FASTA files by
ranges of bytes, or from a table of short sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.operators import skew
from strandframe.scratch import Scratch
from strandframe.sources import formats
from strandframe.sources.text import fields

CHUNK, TAIL = 1 << 14, 256
INDEX = ["name", "length", "offset", "line_chars", "line_bytes"]


def chunk_of(at: Column) -> Column:
    return F.shiftright(at.cast("bigint"), CHUNK.bit_length() - 1)


def inside(at: Column) -> Column:
    """The place of a base in its chunk, from 1 on."""
    return (at.cast("bigint").bitwiseAND(F.lit(CHUNK - 1)) + 1).cast("int")


def chunks_of(fasta: DataFrame) -> DataFrame:
    """name, chunk, bases from a table (name, seq)."""
    n = F.greatest(F.length("seq") - 1, F.lit(0))
    each = fasta.where("seq is not null").select("name", "seq", F.explode(F.sequence(F.lit(0).cast("bigint"), chunk_of(n))).alias("chunk"))
    return each.select("name", "chunk", F.substring("seq", (F.col("chunk") * CHUNK + 1).cast("int"), F.lit(CHUNK + TAIL)).alias("bases"))


def read_pieces(spark: SparkSession, paths: str | list[str], split: int = formats.SPLIT) -> DataFrame:
    """record (where its header is), name, description, start, pos, bases, line_chars, eol: the sequences of FASTA files in pieces, start their first base.

    Each range of bytes is read by itself. Pieces before its first header
    belong to the last record of the ranges before it, whose name and length
    so far come from a table with a row for each range. What comes before any
    header is left out.
    """
    formats.register(spark)
    scratch = Scratch(spark, "fasta")
    path = paths if isinstance(paths, str) else ",".join(paths)
    raw = scratch.save(spark.read.format("fasta").option("split", split).load(path), "raw")
    n = F.length("bases").cast("bigint")
    by_record = raw.groupBy("file_ord", "split", "record").agg(F.sum(n).alias("n"), F.max("name").alias("name"), F.max("description").alias("description"))
    last = F.max_by(F.struct("split", "record", "name", "description", "n"), "record")
    splits = by_record.groupBy("file_ord", "split").agg(F.when(F.max("record") > 0, last).alias("own"), F.coalesce(F.sum(F.when(F.col("record") == 0, F.col("n"))), F.lit(0)).alias("n0"))
    order = Window.partitionBy("file_ord").orderBy("split")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    splits = splits.withColumn("g", F.sum(F.col("own").isNotNull().cast("int")).over(upto))
    within = Window.partitionBy("file_ord", "g").orderBy("split").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = F.sum(F.coalesce("own.n", "n0")).over(within)
    splits = splits.withColumn("so_far", so_far).withColumn("owner", F.last("own", ignorenulls=True).over(upto))
    carried = splits.select("file_ord", "split", F.lag("owner").over(order).alias("owner"), F.lag("so_far").over(order).alias("before"))
    carried = scratch.save(carried, "carried")
    both = raw.join(F.broadcast(carried) if carried.count() <= skew.BROADCAST_ROWS else carried, ["file_ord", "split"])
    early = F.col("record") == 0
    pick = lambda c: F.when(early, F.col(f"owner.{c}")).otherwise(F.col(c)).alias(c)
    key = F.struct("file_ord", F.when(early, F.col("owner.split")).otherwise(F.col("split")).alias("split"), F.when(early, F.col("owner.record")).otherwise(F.col("record")).alias("record"))
    start = F.col("at") + F.when(early, F.col("before")).otherwise(0)
    return both.where(~early | F.col("owner").isNotNull()).select(key.alias("record"), pick("name"), pick("description"), start.alias("start"), "pos", "bases", "line_chars", "eol")


def index(pieces: DataFrame) -> DataFrame:
    """name, length, offset, line_chars, line_bytes, description, record: of each name the last record, as a FASTA index counts them."""
    bare = F.length("bases") == 0
    # the first line ends at the least of all line ends
    stop = F.min(F.when(F.col("line_chars").isNotNull(), F.struct((F.col("start") + F.col("line_chars")).alias("chars"), "eol")))
    records = pieces.groupBy("record").agg(
        F.max("name").alias("name"), F.max("description").alias("description"), F.sum(F.length("bases").cast("bigint")).alias("length"), F.min(F.struct(bare.alias("bare"), "pos")).alias("first"), stop.alias("stop")
    )
    last = records.groupBy("name").agg(F.max_by(F.struct("length", "first", "stop", "description", "record"), "record").alias("r"))
    chars = F.coalesce("r.stop.chars", "r.length").cast("int")
    return last.select("name", "r.length", F.col("r.first.pos").alias("offset"), chars.alias("line_chars"), (chars + F.coalesce("r.stop.eol", F.lit(0))).alias("line_bytes"), "r.description", "r.record")


def index_lines(index_: DataFrame) -> DataFrame:
    """offset and value: lines of a FASTA index; written in order of offset with text.write_lines."""
    return index_.select("offset", F.concat_ws("\t", *[F.col(c).cast("string") for c in INDEX]).alias("value"))


def read_index(lines: DataFrame) -> DataFrame:
    """name, length, offset, line_chars, line_bytes from lines (value) of a FASTA index; other lines raise."""
    t = fields(F.col("value"))
    fine = F.when(F.size("t") == 5, True).otherwise(F.raise_error(F.concat(F.lit("not a line of an index: "), F.substring("value", 1, 100))).cast("boolean"))
    rows = lines.where(F.trim("value") != "").select("value", t.alias("t")).where(fine)
    return rows.select(F.col("t")[0].alias("name"), *[F.col("t")[i].cast("bigint" if i < 3 else "int").alias(c) for i, c in enumerate(INDEX) if i])


def byte_range(start: Column, end: Column) -> Column:
    """struct<first,last>: the bytes of a file that hold the bases [start, end) of a sequence, from the columns of its index."""
    at = lambda p: F.col("offset") + F.floor(p / F.col("line_chars")) * F.col("line_bytes") + p % F.col("line_chars")
    return F.struct(at(start).alias("first"), (at(end - 1) + 1).alias("last"))


def read_chunks(spark: SparkSession, paths: str | list[str], split: int = formats.SPLIT) -> DataFrame:
    """name, chunk, bases of FASTA files; of each name the last record."""
    pieces = Scratch(spark, "fasta").save(read_pieces(spark, paths, split), "pieces")
    return join_pieces(pieces.join(index(pieces).select("record"), "record", "left_semi"))


def join_pieces(pieces: DataFrame) -> DataFrame:
    """name, chunk, bases from pieces (name, start, bases) of sequences. A sequence without bases has one empty chunk."""
    n = F.length("bases")
    first, last = F.greatest(chunk_of(F.col("start") - TAIL), F.lit(0).cast("bigint")), chunk_of(F.col("start") + F.greatest(n, F.lit(1)) - 1)
    each = pieces.where((n > 0) | (F.col("start") == 0)).select("name", "start", "bases", F.explode(F.sequence(first, last)).alias("chunk")).withColumn("__o", F.col("chunk") * CHUNK)
    lo = F.greatest("start", "__o")
    hi = F.least(F.col("start") + n, F.col("__o") + CHUNK + TAIL)
    part = F.substring("bases", (lo - F.col("start") + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    parts = each.select("name", "chunk", F.struct(lo.alias("at"), part.alias("b")).alias("p"))
    return parts.groupBy("name", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["b"]), "").alias("bases"))


def lengths(chunks: DataFrame) -> DataFrame:
    """name, length."""
    return chunks.groupBy("name").agg(F.max(F.col("chunk") * CHUNK + F.least(F.length("bases"), F.lit(CHUNK))).alias("length"))


def windows(chunks: DataFrame, ranges: DataFrame, row: list[str]) -> DataFrame:
    """ranges (name, start, end and others; row tells them apart) with seq, half-open and cut at the sequence's ends; empty where there is none.

    Windows are cut at the borders of chunks, and a chunk that many windows
    touch is dealt.
    """
    start, end = F.greatest("start", F.lit(0)), F.greatest("end", F.lit(0))
    touched = F.when(end > start, F.sequence(chunk_of(start), chunk_of(end - 1))).otherwise(F.array().cast("array<bigint>"))
    asked = ranges.select(*row, "name", start.alias("__s"), end.alias("__e"), F.explode(touched).alias("chunk"))
    met = skew.lookup(asked, chunks, ["name", "chunk"])
    lo, hi = F.greatest(F.col("__s"), F.col("chunk") * CHUNK), F.least(F.col("__e"), (F.col("chunk") + 1) * CHUNK)
    part = F.substring("bases", inside(lo), (hi - lo).cast("int"))
    parts = met.groupBy(*row).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", part.alias("b")))), lambda p: p["b"]), "").alias("seq"))
    return ranges.join(parts, row, "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def whole(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """name, seq of the sequences in names, for short ones: each becomes one row."""
    some = chunks.join(names.select("name").distinct(), "name", "left_semi").select("name", F.struct("chunk", F.substring("bases", F.lit(1), F.lit(CHUNK)).alias("b")).alias("p"))
    return some.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["b"]), "").alias("seq"))


def fasta_lines(chunks: DataFrame, width: int = 60) -> DataFrame:
    """name, chunk and value: the records of chunks as FASTA lines of width letters, or one line if width is 0; a line belongs to the chunk in which it begins, so no task holds a sequence."""
    own = F.substring("bases", F.lit(1), F.lit(CHUNK))
    if width > TAIL:
        raise ValueError("lines are longer than chunks overlap")
    n = F.length(own)
    head = F.when(F.col("chunk") == 0, F.concat(F.lit(">"), F.col("name"), F.lit("\n"))).otherwise("")
    if not width:
        return chunks.select("name", "chunk", F.concat(head, own).alias("value"))
    first = (width - (F.col("chunk") * CHUNK) % width) % width
    starts = F.when(first < n, F.sequence(first, n.cast("bigint") - 1, F.lit(width).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    lines = F.transform(starts, lambda s: F.substring("bases", (s + 1).cast("int"), F.lit(width)))
    return chunks.select("name", "chunk", F.concat(head, F.array_join(lines, "\n")).alias("value")).where("value <> ''").withColumn("value", F.regexp_replace("value", "\n$", ""))
