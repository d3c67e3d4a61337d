"""Row-local operators on text streams. Nothing here keeps state: each batch of new lines is read, transformed and written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandframe.operators import alignments
from strandframe.sources.alignments import parse_gaf, parse_paf


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """value of each line of the files that arrive in folder."""
    return spark.readStream.text(folder).where(F.trim("value") != "")


def paf(spark: SparkSession, folder: str) -> DataFrame:
    return parse_paf(lines(spark, folder), strict=False)


def gaf(spark: SparkSession, folder: str) -> DataFrame:
    return parse_gaf(lines(spark, folder))


def lastz(rows: DataFrame, use_mapq: bool = False) -> DataFrame:
    return rows.withColumn("value", alignments.lastz_line(use_mapq))


def masked(rows: DataFrame, bed: DataFrame, write, padding: int = 100, least: int = 1, checkpoint: str | None = None) -> StreamingQuery:
    """Mask each batch with a static bed and hand it to write(frame, batch). The batch is keyed within itself, so batches may be repeated."""

    def each(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("__row", F.xxhash64("value"))
        write(alignments.mask_queries(keyed.dropDuplicates(["__row"]), bed, "__row", padding, least).drop("__row"), number)

    out = rows.writeStream.foreachBatch(each)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).trigger(availableNow=True).start()
