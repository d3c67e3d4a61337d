"""Toxicity by multiple-instance learning: a document is a bag of sentences, its score a noisy-or over their scores.

A sentence that holds evidence (a hashed word that the labels speak for) gets
the probability sigmoid(bias + sum of weights); other sentences get none. The
document's score is 1 - (1 - leak) * product of (1 - p). Leak, bias and weights
are trained from labels of whole documents, so that the sentences which made a
document toxic can be told from the others.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import extended

#: Labelled documents that a model is fitted on, at most; the ones with the smallest hash of doc_id are taken.
TRAIN_ROWS = 12_000
#: Buckets of hashed words.
BUCKETS = 1 << 20
#: Bytes of a word's start that is a feature too.
STEM = 7
#: A bucket is evidence if it is in at least so many toxic documents, and so many times likelier in them than in others.
LEAST_DOCS, LEAST_LIFT = 5, 4.0

_ENDS = b".!?\n"
_TABLE = bytes(
    10 if c in _ENDS else 32 if c < 128 and not (48 <= c <= 57 or 97 <= c <= 122) else c for c in range(256)
)


def sentences(text: str | None) -> list[list[int]]:
    """The hashed words and word starts of each sentence that has any; sentences end at . ! ? or a line's end."""
    clean = (text or "").lower().encode("utf-8", "replace").translate(_TABLE)
    out = ([zlib.crc32(x) % BUCKETS for w in part.split() for x in _features(w)] for part in clean.split(b"\n"))
    return [x for x in out if x]


def _features(word: bytes) -> tuple[bytes, ...]:
    """A word, and if it is longer the start of it, which stands for its inflected and joined forms."""
    return (word, word[:STEM] + b"-") if len(word) > STEM else (word,)


@dataclass
class Model:
    """weights: of the buckets that are evidence."""

    leak: float
    bias: float
    weights: dict[int, float]

    def score(self, text: str | None) -> tuple[float, int | None, float]:
        """The document's score, the number of its worst sentence (None if none holds evidence) and that one's score."""
        clear, worst, top = 1 - self.leak, None, 0.0
        get = self.weights.get
        for i, words in enumerate(sentences(text)):
            found = [x for x in map(get, words) if x is not None]
            if found:
                p = 1 / (1 + np.exp(-np.clip(self.bias + sum(found), -30, 30)))
                clear *= 1 - p
                if p > top:
                    worst, top = i, float(p)
        return float(1 - clear), worst, top


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 300, rate: float = 0.3, shrink: float = 1e-4) -> Model:
    """Fit on documents (their hashed words, and the number of words of each sentence) with labels 0 or 1, by gradient steps on the noisy-or's log loss."""
    rate_of = float(y.mean()) if len(y) else 0.0
    if not 0 < rate_of < 1:
        return Model(min(max(rate_of, 1e-6), 1 - 1e-6), 0.0, {})
    toxic, clean = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    for (ids, _), label in zip(bags, y, strict=True):
        (toxic if label else clean)[np.unique(ids)] += 1
    lift = ((toxic + 0.5) / (y.sum() + 1)) / ((clean + 0.5) / ((1 - y).sum() + 1))
    evidence = np.flatnonzero((toxic >= LEAST_DOCS) & (lift >= LEAST_LIFT))
    place = np.full(BUCKETS, -1, np.int32)
    place[evidence] = np.arange(len(evidence))
    # (document, sentence, evidence) of all occurrences, once each
    found = []
    for d, (ids, sizes) in enumerate(bags):
        at = place[ids]
        held = at >= 0
        if held.any():
            of = np.repeat(np.arange(len(sizes)), sizes)[held]
            found.append(np.column_stack([np.full(len(of), d), of, at[held]]))
    rows = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)
    words = rows[:, 2]
    pairs, sentence = np.unique(rows[:, :2], axis=0, return_inverse=True)
    sentence, doc = sentence.reshape(-1), pairs[:, 0]
    theta, bias, leak = np.zeros(len(evidence)), 0.0, -3.0
    grads = [np.zeros(len(evidence)), 0.0, 0.0]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(sentence, theta[words], len(doc)), -30, 30)))
        p0 = 1 / (1 + np.exp(-leak))
        clear = np.log1p(-p0) + np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
        prob = np.maximum(-np.expm1(clear), 1e-9)
        pull = (prob - y) / prob  # of the loss, by a bag's member and over its probability
        dz = pull[doc] * p
        step = [np.bincount(words, dz[sentence], len(evidence)) + shrink * len(y) * theta, dz.sum(), (pull * p0).sum()]
        # each weight moves by its own scale, so that rare words are learnt as fast as frequent ones
        grads = [0.9 * g + 0.1 * s * s for g, s in zip(grads, step, strict=True)]
        theta = theta - rate * step[0] / np.sqrt(grads[0] + 1e-9)
        bias -= rate * step[1] / np.sqrt(grads[1] + 1e-9)
        leak = np.clip(leak - 0.1 * rate * step[2] / np.sqrt(grads[2] + 1e-9), -9, 9)
        rate *= 0.99
    return Model(float(1 / (1 + np.exp(-leak))), float(bias), {int(b): float(w) for b, w in zip(evidence, theta, strict=True)})


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from training: crc32 of doc_id as text is divisible by 5. False for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most rows labelled documents that aren't held out (the sample's bound in rows; texts are taken whole).

    Labels other than 0 and 1, and labels without doc_id, are left out; a
    document with several labels counts as toxic if one of them says so.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    sample = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    rows_in = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic")

    def run(batches):
        for batch in batches:
            bags = [sentences(t.as_py()) for t in batch.column("text")]
            flat = [np.array([w for s in bag for w in s], np.int32) for bag in bags]
            sizes = [np.array([len(s) for s in bag], np.int32) for bag in bags]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").cast(pa.int32()), pa.array(flat, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], ["toxic", "words", "sizes"]
            )

    found = rows_in.mapInArrow(run, "toxic int, words array<int>, sizes array<int>").toArrow()
    arrays = lambda c: [x.values.to_numpy(zero_copy_only=False) for x in found.column(c)]
    return fit(list(zip(arrays("words"), arrays("sizes"), strict=True)), found.column("toxic").to_numpy().astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text and any other columns) with score, worst_sentence (its number among those with words) and worst_score.

    Null and empty texts have no sentences and get the leak as their score.
    Every row is scored, repeated ones alike.
    """
    names = [c for c in docs.columns if c not in ("score", "worst_sentence", "worst_score")]
    kept = docs.select(*names)

    def run(batches):
        for batch in batches:
            found = [model.score(t.as_py()) for t in batch.column("text")]
            new = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.float64(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "score", "worst_sentence", "worst_score"])

    schema = extended(kept, ("score", "double"), ("worst_sentence", "integer"), ("worst_score", "double"))
    return kept.mapInArrow(run, schema)


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence (its number), sentence_score and text for each sentence that scores least or more."""
    ids = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    parts = F.filter(F.split("text", r"[.!?\n]"), lambda s: F.lower(s).rlike(r"[a-z0-9]|[^\x00-\x7F]"))
    each = ids.select("doc_id", F.posexplode(parts).alias("sentence", "text"))
    return score(each, model).where(F.col("score") >= least).select("doc_id", "sentence", F.col("worst_score").alias("sentence_score"), "text")


def op8_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    out = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_sentence"
    )
