"""How filters interact: survivors of every subset of five filters, and from them all orders of applying them.

A document becomes a 32-bit survival word: bit S is set where none of the
filters of subset S rejects it. It is the conjunction of truth tables, one for
each filter that the document fails. Carry-save adders count the set bits of
all words by position, for each part and label, which gives the survivors of
each subset; whatever an order of filters keeps, removes or finds removed
already is a difference of two of them.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import WORD
from strandframe.scratch import Scratch

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: For each filter, the word whose bit S is set where subset S holds that filter.
TABLES = [sum(1 << s for s in range(SUBSETS) if s >> i & 1) for i in range(len(FILTERS))]
#: Labels that survivors are counted by.
ALL, GOOD, TOXIC = range(3)
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 100, 80, 10, "[#$%&*|]"
#: Parts whose counts a task holds before it hands them on.
HELD_PARTS = 4096


def survival_words(failed: np.ndarray) -> np.ndarray:
    """The survival words of documents, from the bits of the filters that each fails."""
    words = np.full(len(failed), 0xFFFFFFFF, np.uint32)
    for i, table in enumerate(TABLES):
        words &= np.where(failed >> i & 1, np.uint32(~table & 0xFFFFFFFF), np.uint32(0xFFFFFFFF))
    return words


def positional_popcounts(words: np.ndarray) -> np.ndarray:
    """How many words have each bit set.

    An adder turns three words of one weight into one of the same and one of
    twice the weight. Fewer than three words are left of each weight, and only
    these are looked at bit by bit.
    """
    counts, weight, level = np.zeros(SUBSETS, np.int64), 0, words
    while len(level):
        carries = []
        while len(level) >= 3:
            k = len(level) // 3
            a, b, c = level[:k], level[k : 2 * k], level[2 * k : 3 * k]
            either = a ^ b
            carries.append((a & b) | (either & c))
            level = np.concatenate([either ^ c, level[3 * k :]])
        for word in level.tolist():
            counts += (np.uint64(word) >> np.arange(SUBSETS, dtype=np.uint64) & np.uint64(1)).astype(np.int64) << weight
        weight, level = weight + 1, np.concatenate(carries) if carries else level[:0]
    return counts


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, part, failed (bits of the filters A to D) and digest (SHA-256 of the whole text) of each row of docs (doc_id, text, lang).

    Null texts are empty ones and a null lang is the empty string; rows are not folded, equal ones included.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            points = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            marked = pc.match_substring_regex(texts, MARKS).to_numpy(zero_copy_only=False)
            failed, digests = np.empty(len(texts), np.int32), []
            for i, text in enumerate(texts.cast(pa.large_binary())):
                raw = text.as_py()
                words = raw.split()  # of bytes: at ASCII white space alone
                n = len(words)
                capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                failed[i] = (
                    (n < MIN_WORDS)
                    | (100 * len(set(words)) < DISTINCT_PERCENT * n) << 1
                    | (100 * capitals > CAPITAL_PERCENT * int(points[i])) << 2
                    | bool(marked[i]) << 3
                )
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(failed), pa.array(digests, pa.binary())], ["doc_id", "part", "failed", "digest"]
            )

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank("lang").alias("part"), blank("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, failed int, digest binary")


def failures(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, failed (bits of all five filters), good and toxic of each row of docs (doc_id, text, lang).

    E: the text is that of a smaller doc_id as well. A text's smallest doc_id
    is pre-aggregated and joined by (doc_id, digest), so copies of one text
    never meet in a task. Rows without doc_id neither are smaller nor have
    smaller ones, and carry no label. Of several labels of a document one that
    is 1 is enough; rows that share a doc_id each carry them.
    """
    rows = scratch.save(measure(docs), "measured")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality"), is_one("toxic"))
    known = rows.where("doc_id is not null").join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    copy = F.when(F.col("first").isNull(), 1 << 4).otherwise(0)
    flag = lambda c, name: F.coalesce(F.col(c), F.lit(False)).alias(name)
    unknown = rows.where("doc_id is null").select("part", "failed", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return known.select("part", F.col("failed").bitwiseOR(copy).alias("failed"), flag("quality", "good"), flag("toxic", "toxic")).unionByName(unknown)


def survivors(rows: DataFrame) -> DataFrame:
    """part, label (ALL, GOOD, TOXIC), subset and n: how many of rows (part, failed, good, toxic) no filter of the subset rejects."""

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def flush():
            parts = list(held)
            flat = np.concatenate([held[p].reshape(-1) for p in parts])
            each = 3 * SUBSETS
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(parts, pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), each))),
                    pa.array(np.tile(np.repeat(np.arange(3, dtype=np.int32), SUBSETS), len(parts))),
                    pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), 3 * len(parts))),
                    pa.array(flat),
                ],
                ["part", "label", "subset", "n"],
            )
            held.clear()
            return out

        for batch in batches:
            coded = batch.column("part").dictionary_encode()
            codes = coded.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            cuts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
            words = survival_words(batch.column("failed").to_numpy())[order]
            chosen = [np.ones(len(words), bool), *(batch.column(c).to_numpy(zero_copy_only=False).astype(bool)[order] for c in ("good", "toxic"))]
            for part, lo, hi in zip(coded.dictionary.to_pylist(), cuts, cuts[1:], strict=False):
                counts = np.stack([positional_popcounts(words[lo:hi][c[lo:hi]]) for c in chosen])
                held[part] = held[part] + counts if part in held else counts
            if len(held) > HELD_PARTS:
                yield flush()
        if held:
            yield flush()

    found = rows.select("part", "failed", "good", "toxic").mapInArrow(run, "part string, label int, subset int, n long")
    return found.groupBy("part", "label", "subset").agg(F.sum("n").alias("n"))


def _of(label: int, subset: Column | int) -> Column:
    return F.col("counts")[F.lit(label * SUBSETS) + subset]


def _shapley(i: int) -> Column:
    """What filter i removes, summed over all orders: those with exactly subset s before it number |s|! (4 - |s|)!."""
    terms = [
        (_of(ALL, s) - _of(ALL, s | 1 << i)) * (factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())) for s in range(SUBSETS) if not s >> i & 1
    ]
    return sum(terms[1:], terms[0])


def orders(counts: DataFrame) -> DataFrame:
    """One row for each part, filter_order and step, from the survivors of all subsets; see op12_query."""
    sums = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("label", "subset", "n"))).alias("counts")).withColumn("counts", F.col("counts.n"))
    sums = sums.withColumn("shapleys", F.array(*[_shapley(i) for i in range(len(FILTERS))]))
    names = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = sums.withColumn("filter_order", F.explode(names)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("i", F.expr("ascii(substring(filter_order, step, 1)) - 65"))
    steps = steps.withColumn("before", F.expr("aggregate(slice(split(filter_order, ''), 1, step - 1), 0, (s, c) -> s + shiftleft(1, ascii(c) - 65))"))
    steps = steps.withColumn("bit", F.expr("shiftleft(1, i)")).withColumn("after", F.col("before") + F.col("bit"))
    before, after, bit = F.col("before"), F.col("after"), F.col("bit")
    lost = lambda label: _of(label, before) - _of(label, after)
    return steps.select(
        "part", "filter_order", "step",
        _of(ALL, after).alias("kept"), lost(ALL).alias("removed"), (_of(ALL, 0) - _of(ALL, bit) - lost(ALL)).alias("redundant"),
        (_of(ALL, F.lit(SUBSETS - 1) - bit) - _of(ALL, SUBSETS - 1)).alias("unique_fails"), lost(GOOD).alias("good_lost"), lost(TOXIC).alias("toxic_lost"),
        F.col("shapleys")[F.col("i")].alias("shapley"),
    )


def op12_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the five filters and step: documents kept after it, removed by it, and so on.

    An empty table gives no rows. Null texts, nulls in other columns, equal
    rows and rows that share a doc_id are told in measure and failures.
    """
    return orders(survivors(failures(docs, labels, Scratch(docs.sparkSession, "filter_audit"))))


SQL = rf"""
with words as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents
), failed as (
  select part,
    (len(ws) < {MIN_WORDS})::int + 2 * (100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws))::int
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {CAPITAL_PERCENT} * length(text))::int
    + 8 * regexp_matches(text, '{MARKS}')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as mask,
    coalesce(doc_id in (select doc_id from labels where quality = 1), false)::int as good,
    coalesce(doc_id in (select doc_id from labels where toxic = 1), false)::int as toxic
  from words
), masks as (
  select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by part, mask
), letters(c) as (values ('A'), ('B'), ('C'), ('D'), ('E')
), orders as (
  select a.c || b.c || d.c || e.c || f.c as filter_order from letters a, letters b, letters d, letters e, letters f
  where a.c <> b.c and a.c <> d.c and a.c <> e.c and a.c <> f.c and b.c <> d.c and b.c <> e.c and b.c <> f.c and d.c <> e.c and d.c <> f.c and e.c <> f.c
), steps as (
  select filter_order, step::int as step, 1 << (ascii(filter_order[step]) - 65) as bit,
    coalesce(list_sum([1 << (ascii(filter_order[k]) - 65) for k in range(1, step)]), 0)::int as before
  from orders, range(1, 6) r(step)
), counted as (
  select part, filter_order, step, bit,
    coalesce(sum(n) filter ((mask & (before | bit)) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter ((mask & before) = 0 and (mask & bit) <> 0), 0)::bigint as removed,
    coalesce(sum(n) filter ((mask & before) <> 0 and (mask & bit) <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter ((mask & before) = 0 and (mask & bit) <> 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter ((mask & before) = 0 and (mask & bit) <> 0), 0)::bigint as toxic_lost
  from masks, steps group by part, filter_order, step, bit
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley
from counted
"""
