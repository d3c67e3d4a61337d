"""Token counts: an exact histogram of encoded lengths, and suffix sums that answer every context limit.

The histogram has a row for each length that occurs. With the number of
documents and of ids at each length and above, the total under any limit, any
quantile and the total of texts cut at any limit are one look-up each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm.common import extended
from strandframe.llm.tokens import _encoder, bounded, default_tokenizer
from strandframe.scratch import Scratch

#: Lengths of one range of the suffix sums.
RANGE = 1024


def token_lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """docs' doc_id and n_tokens: the ids of the whole text, none for null."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            text = batch.column("text")
            n = [encoder.lengths(text.slice(at, rows)) for at, rows in bounded(text)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([*n, np.empty(0, np.int64)]))], ["doc_id", "n_tokens"])

    return rows.mapInArrow(run, extended(rows.select("doc_id"), ("n_tokens", "long")))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: one row for each length that occurs."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """n_tokens, n_docs, docs_at_least, tokens_at_least, docs_total, tokens_total, truncated_total, quantile.

    A row holds for the context limit n_tokens: truncated_total is what is left
    of all texts if each is cut to n_tokens ids, quantile the share of
    documents of at most n_tokens ids. Sums run within ranges of RANGE lengths,
    each in a task, and then over the totals of the ranges.
    """
    ranged = histogram.withColumn("range", F.floor(F.col("n_tokens") / RANGE))
    totals = ranged.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    above = totals.select(
        "range",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_above"),
        F.sum("d").over(every).alias("docs_total"),
        F.sum("t").over(every).alias("tokens_total"),
    )
    inside = Window.partitionBy("range").orderBy("n_tokens").rowsBetween(0, Window.unboundedFollowing)
    summed = ranged.select(
        "range", "n_tokens", "n_docs", F.sum("n_docs").over(inside).alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside).alias("t")
    )
    out = summed.join(above, "range").withColumn("docs_at_least", F.col("d") + F.col("d_above")).withColumn("tokens_at_least", F.col("t") + F.col("t_above"))
    cut = F.col("tokens_total") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")
    share = (F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total")
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "docs_total", "tokens_total", cut.alias("truncated_total"), share.alias("quantile"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_fit, tokens_fit, truncated_total for any limits, whether or not a text has that length."""
    spark = sums.sparkSession
    asked = F.broadcast(spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "context_limit long"))
    # the next longer length holds what is over the limit
    over = sums.select(F.explode(F.array(*[F.lit(int(x)) for x in sorted(set(limits))])).alias("context_limit"), "n_tokens", "docs_at_least", "tokens_at_least")
    over = over.where("n_tokens > context_limit").groupBy("context_limit").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens").alias("o"))
    totals = sums.select("docs_total", "tokens_total").limit(1).select("*", F.explode(F.array(*[F.lit(int(x)) for x in sorted(set(limits))])).alias("context_limit"))
    d, t = F.coalesce("o.docs_at_least", F.lit(0)), F.coalesce("o.tokens_at_least", F.lit(0))
    out = asked.join(totals, "context_limit", "left").join(over, "context_limit", "left")
    fit = F.coalesce(F.col("tokens_total"), F.lit(0)) - t
    return out.select("context_limit", (F.coalesce(F.col("docs_total"), F.lit(0)) - d).alias("docs_fit"), fit.alias("tokens_fit"), (fit + d * F.col("context_limit")).alias("truncated_total"))


def length_at(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of the documents does not exceed."""
    asked = sums.select(F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"), "n_tokens", "quantile")
    return asked.where("quantile >= share - 1e-12").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op1_query(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Every length of `documents` with its suffix sums. Null and empty texts have length 0; repeated rows count each; no rows give none."""
    lengths = token_lengths(docs, tokenizer_path or default_tokenizer())
    histogram = Scratch(docs.sparkSession, "lengths").save(length_histogram(lengths), "histogram")
    return suffix_sums(histogram)
