"""The corpus pipeline: from raw documents to token shards in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import decontaminate, mixing, near_copies, tokens, toxicity
from strandframe.llm.common import load
from strandframe.scratch import Scratch

#: Pieces of text whose ids a worker of the last stage remembers.
CACHE_PIECES = 200_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score stays under 0.5; the model learns from the labels of this stage's own documents."""
    model = toxicity.train(docs, load(spark, sf_dir, "labels"))
    # a row travels as one column, so that no name of its own meets those of the score
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    return toxicity.score(rows, model).where("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles of a Jaccard similarity of 0.8 or more, found by SimHash and verified; the README gives the recall."""
    return near_copies.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window similar to a benchmark item."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take_mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards on disk; returns what is read back from them, a row for each document taken."""
    folder = Scratch(spark, "tokens").path("files")
    # fewer texts at once in a Python worker and fewer pieces remembered, beside a JVM that the stages before have filled
    with near_copies.arrow_rows(docs, near_copies.TEXT_ROWS):
        shards = tokens.write_shards(docs, folder, tokens.default_tokenizer(), pieces=CACHE_PIECES)
    return tokens.read_digests(shards, folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_shards", write_tokens),
]

#: A trained classifier, SimHash groups and random rounding are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        scratch.free(before)
    return docs
