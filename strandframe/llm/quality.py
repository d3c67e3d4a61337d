"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Every text is a bag of words and word pairs hashed to BUCKETS features. Two
generative models, the feature frequencies of the target texts and of all raw
texts, give a document the weight sum(log target - log raw) over its features.
Adding Gumbel noise and taking the k largest draws k documents without
replacement in proportion to their weights.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import extended, small
from strandframe.scratch import Scratch

BUCKETS = 20_000
#: The share of documents that the sample keeps.
KEEP = 0.85
SEED = 42


def features(text: str | None) -> np.ndarray:
    """The hashed words and word pairs of a text, repeats included. A-Z are lower-cased; words are cut at ASCII white space."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    crc = zlib.crc32
    one = np.fromiter(map(crc, words), np.uint64, len(words))
    # a pair is hashed from the hashes of its words
    two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7) if len(one) > 1 else one[:0]
    return (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64)


def feature_counts(docs: DataFrame, target: Column) -> DataFrame:
    """bucket, raw, target: how often each feature occurs in all documents and in those of the target, over all rows.

    Each task counts what it reads, so what is shuffled is at most BUCKETS rows a task.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(target.cast("boolean"), F.lit(False)).alias("target"))

    def run(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, chosen in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist(), strict=True):
                found = np.bincount(features(text), minlength=BUCKETS)
                counts[0] += found
                if chosen:
                    counts[1] += found
        seen = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[0][seen]), pa.array(counts[1][seen])], ["bucket", "raw", "target"])

    partial = rows.mapInArrow(run, "bucket long, raw long, target long")
    return partial.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log(target / raw) of each feature, smoothed by one in each model; BUCKETS numbers."""
    table = counts.toArrow()
    both = np.ones((2, BUCKETS))
    at = table.column("bucket").to_numpy()
    both[0, at] += table.column("raw").to_numpy()
    both[1, at] += table.column("target").to_numpy()
    logs = np.log(both / both.sum(1, keepdims=True))
    return logs[1] - logs[0]


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """docs with log_weight: the sum of the log ratios of a document's features; 0 for null and blank texts."""
    names = [c for c in docs.columns if c != "log_weight"]
    kept = docs.select(*names)

    def run(batches):
        for batch in batches:
            w = pa.array([float(ratios[features(t)].sum()) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, w], [*batch.schema.names, "log_weight"])

    return kept.mapInArrow(run, extended(kept, ("log_weight", "double")))


def gumbel(*keys: Column, seed: int = SEED) -> Column:
    """A standard Gumbel number drawn by hash."""
    u = (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, k: int) -> int | None:
    """The k-th largest of column v (a long, not null), or None if there are fewer.

    Four rounds count the values by their next 16 bits; each sends at most
    65,536 counts to the driver, at any size of the table.
    """
    shifted, low, left = values.select(F.col("v").bitwiseXOR(F.lit(-(1 << 63))).alias("v")), 0, k
    for shift in (48, 32, 16, 0):
        piece = F.shiftrightunsigned("v", shift).bitwiseAND(F.lit(0xFFFF))
        inside = shifted if shift == 48 else shifted.where(F.shiftrightunsigned("v", shift + 16) == F.lit(low))
        counts = dict(inside.groupBy(piece.alias("p")).count().collect())
        for p in sorted(counts, reverse=True):
            if left <= counts[p]:
                break
            left -= counts[p]
        else:
            return None
        low = (low << 16) | p
    return (low ^ (1 << 63)) - ((low ^ (1 << 63)) >> 63 << 64)


def resample(docs: DataFrame, target: Column, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, key, kept for each row of docs: the ceil(keep * rows) documents with the largest weight plus noise are kept.

    target is a condition on docs: true for the texts of the target model (null
    counts as false). Without any target text all weights come from the
    smoothing alone. Ties and repeated rows at the last place are all kept.
    Null and blank texts have weight 0 and take part. No rows give none.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    ratios = log_ratios(feature_counts(docs, target))
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), gumbel(F.col("doc_id"), text, seed=seed).alias("noise"))
    weighed = weigh(rows, ratios).drop("text")
    key = F.col("log_weight") + F.col("noise")
    # an integer in the order of the keys, so that the k-th can be found by counting
    weighed = scratch.save(weighed.select("doc_id", "log_weight", key.alias("key"), F.round(key * (1 << 20)).cast("long").alias("v")), "weights")
    k = math.ceil(keep * weighed.count())
    bar = kth_largest(weighed, k) if k else None
    kept = F.lit(False) if bar is None else F.col("v") >= F.lit(bar)
    return weighed.select("doc_id", "log_weight", "key", kept.alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with target: whether a label says that the document is of good quality."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("target", F.lit(True))
    return docs.select("doc_id", "text").join(small(good), "doc_id", "left")


def op10_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return resample(good_documents(docs, labels), F.col("target"))
