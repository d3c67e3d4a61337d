"""Text lines with an order key, and small tables.

The key (file_ord, pos) sorts lines as they stand in the files: file_ord is the
place of the file in the list of paths, pos the start of the split and a number
that grows within it. Reading stays splittable, and .gz files work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.names import with_prefix

ORDER = ["file_ord", "pos"]


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file_ord, pos, value for each line of the files, in the order of paths."""
    out = None
    for i, path in enumerate([paths] if isinstance(paths, str) else paths):
        pos = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        one = spark.read.text(path).select(F.lit(i).alias("file_ord"), pos.alias("pos"), "value")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no paths")
    return out


def fields(line: Column, delimiters: str = "\\t") -> Column:
    """The parts of a line between delimiters, without empty ones."""
    return F.filter(F.split(line, f"[{delimiters}]"), lambda x: x != "")


def read_bed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """name, start, end; comments, track lines and lines of under three columns are left out."""
    t = fields(F.col("value"), "\\t ")
    rows = read_lines(spark, paths).where(~F.col("value").rlike("^(#|track|browser)")).select(t.alias("t")).where(F.size("t") >= 3)
    return rows.select(F.col("t")[0].alias("name"), F.col("t")[1].cast("bigint").alias("start"), F.col("t")[2].cast("bigint").alias("end"))


def mask_totals(bed: DataFrame) -> DataFrame:
    """name, masked: the summed lengths; ranges that overlap count twice."""
    return bed.groupBy("name").agg(F.sum(F.col("end") - F.col("start")).alias("masked"))


def read_lengths(spark: SparkSession, paths: str | list[str], prefix: str = "") -> DataFrame:
    """name, length from tables of two or more columns (FASTA indexes too); the last line of a name counts."""
    t = fields(F.col("value"), "\\t ")
    rows = read_lines(spark, paths).select(*ORDER, t.alias("t")).where(F.size("t") >= 2)
    name = with_prefix(F.col("t")[0], prefix) if prefix else F.col("t")[0]
    return rows.groupBy(name.alias("name")).agg(F.max_by(F.col("t")[1].cast("bigint"), F.struct(*ORDER)).alias("length"))


def read_names(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """name: the first column of each line that has one, once each."""
    return read_lines(spark, paths).select(F.get(fields(F.col("value"), "\\t "), F.lit(0)).alias("name")).where("name is not null").distinct()


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """name, description, seq. Records are cut at '>' by the reader, so large files stay splittable."""
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        raw = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
        head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
        seq = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
        one = raw.select(F.regexp_extract(F.trim(head), r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(F.trim(head), r"^\S*", "")).alias("description"), seq.alias("seq"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no paths")
    return out


def prefix_headers(lines: DataFrame, prefix: str) -> DataFrame:
    """FASTA lines with prefix put before each record's name."""
    return lines.withColumn("value", F.regexp_replace("value", "^>", ">" + prefix.replace("\\", "\\\\").replace("$", "\\$")))


def write_lines(lines: DataFrame, path: str, order: list[str] | None = None, single: bool = False) -> None:
    """Write column value as text, sorted by order (a range sort, so files ascend); single puts it into one file, for small results."""
    out = lines.orderBy(*order) if order else lines
    (out.coalesce(1) if single else out).select("value").write.text(path)


def write_by(lines: DataFrame, path: str, key: str, order: list[str]) -> None:
    """Write column value to a folder for each value of key, in order within each task's file. Rows of a key may come from many tasks, so none holds it whole."""
    lines.sortWithinPartitions(key, *order).select("value", key).write.partitionBy(key).text(path)
