"""SimHash near-duplicates: segment popcounts, a grid range-join under Manhattan distance, exact Hamming distance.

A fingerprint of 64 bits is mapped to the bit counts of its 32 two-bit
segments, a point of a grid. One differing bit changes one count by one, so the
Manhattan distance of two points never exceeds the Hamming distance of the
fingerprints. The axes are dealt into as few parts as leave a distance of two
at most in one of them. In each part a fingerprint stands in its own cell and
in those next to it: two points at a distance of two or less meet in a cell
beside or between them. Pairs that meet are held against the Manhattan distance
of all axes first and then against the exact Hamming distance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import connected_components, extended, small
from strandframe.scratch import Scratch

_EVEN = 0x5555555555555555
_SEGMENTS = 32
#: Shingles that are hashed and counted at once.
_CHUNK = 1 << 16
#: Members of a cell (or of one block of a large cell) that a task compares.
CELL_ROWS = 1024


def text_fingerprint(text: str | None, width: int) -> int:
    """SimHash of a text: the majority of each bit over the XXH64 hashes (seed 42) of its shingles of width words.

    Lower-cases A-Z; words are separated by ASCII white space; repeats count.
    A text of fewer words is one shingle; one without words gives 0.
    """
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - width + 1)
    starts, stops = (ends - [len(w) + 1 for w in words])[:n].tolist(), (ends[min(width, len(words)) - 1 :] - 1)[:n].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, and fp: the fingerprint of column text as a signed long."""
    fields = docs.select(*keep)

    def run(batches):
        for batch in batches:
            fps = pa.array([text_fingerprint(t.as_py(), width) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), fps], [*keep, "fp"])

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, extended(fields, ("fp", "long")))


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments in two bits each: none, the lower or both set for 0, 1 and 2, so that the bits in which two of them differ are their Manhattan distance."""
    high = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(high).bitwiseAND(F.lit(_EVEN)), fp.bitwiseAND(high).bitwiseAND(F.lit(_EVEN))
    return some.bitwiseOR(F.shiftleft(both, 1))


def parts_for(radius: int) -> int:
    """The fewest parts of the axes of which one has a distance of two at most."""
    return radius // 3 + 1


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _axes(part: int, n: int) -> range:
    return range(_SEGMENTS * part // n, _SEGMENTS * (part + 1) // n)


def part_masks(radius: int) -> list[int]:
    """The bits of segment counts that each part of the axes has."""
    n = parts_for(radius)
    return [sum(3 << (2 * s) for s in _axes(part, n)) for part in range(n)]


def _cells(counts: Column, radius: int) -> Column:
    """An array of (part, cell): in each part of the axes the cell of a point, and the cells at a distance of one."""
    n, keys = parts_for(radius), []
    for part, bits in enumerate(part_masks(radius)):
        axes, mask = _axes(part, n), F.lit(_signed(bits))
        cell = lambda c, part=part, mask=mask: F.struct(F.lit(part).cast("short").alias("part"), c.bitwiseAND(mask).alias("cell"))
        keys.append(cell(counts))
        for s in axes:
            low, high = F.lit(_signed(1 << (2 * s))), F.lit(_signed(2 << (2 * s)))
            # 0 and 1 differ in the lower bit, 1 and 2 in the upper one
            keys.append(F.when(counts.bitwiseAND(high) == 0, cell(counts.bitwiseXOR(low))))
            keys.append(F.when(counts.bitwiseAND(low) != 0, cell(counts.bitwiseXOR(high))))
    return F.array_compact(F.array(*keys))


def _counts(fps: np.ndarray) -> np.ndarray:
    """segment_counts of unsigned fingerprints."""
    even, one = np.uint64(_EVEN), np.uint64(1)
    return ((fps | fps >> one) & even) | ((fps & fps >> one) & even) << one


def _spanning(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what links within radius connect. Pairs beyond it by Manhattan distance are left out; the exact distance decides on the others."""
    left, edges = np.unique(fps.view(np.uint64)), []
    at = _counts(left)
    while len(left) > 1:
        front, left, front_at, at = left[:1], left[1:], at[:1], at[1:]
        while len(front) and len(left):
            parent, near = np.zeros(len(left), np.uint64), np.zeros(len(left), bool)
            for f, c in zip(front, front_at, strict=True):
                close = np.flatnonzero(~near & (np.bitwise_count(at ^ c) <= radius))
                hit = close[np.bitwise_count(left[close] ^ f) <= radius]
                near[hit], parent[hit] = True, f
            edges += zip(parent[near].view(np.int64).tolist(), left[near].view(np.int64).tolist(), strict=True)
            front, left, front_at, at = left[near], left[~near], at[near], at[~near]
    return edges


def links(distinct: DataFrame, radius: int, scratch: Scratch, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links within radius.

    Cells of more than cell_rows members are dealt into blocks by hash, and
    each pair of blocks is compared in a task of its own: every pair is
    compared, and no task holds more than two blocks.
    """
    n = distinct.count()
    # each row becomes some fifty, so few small partitions would be few large tasks
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, math.ceil(n / 100_000))
    cells = distinct.select("fp").repartition(tasks, "fp").withColumn("counts", segment_counts(F.col("fp")))
    cells = cells.select("fp", F.explode(_cells(F.col("counts"), radius)).alias("c")).select("fp", "c.*")
    large = scratch.save(
        cells.groupBy("part", "cell").count().where(F.col("count") > cell_rows).withColumn("blocks", F.ceil(F.col("count") / cell_rows).cast("int")), "large"
    )
    dealt = cells.join(small(large.select("part", "cell", "blocks")), ["part", "cell"], "left")
    dealt = dealt.withColumn("block", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), F.lit(0)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    a, b = F.col("fps")[0], F.col("fps")[1]
    close = (F.bit_count(segment_counts(a).bitwiseXOR(segment_counts(b))) <= radius) & (F.bit_count(a.bitwiseXOR(b)) <= radius)
    groups = (
        dealt.groupBy("part", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .agg(F.collect_list("fp").alias("fps"))
        .where((F.size("fps") > 2) | ((F.size("fps") == 2) & close))
        .select("fps")
    )

    def verify(batches):
        for batch in batches:
            edges = [e for fps in batch.column("fps") for e in _spanning(fps.values.to_numpy(), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return groups.mapInArrow(verify, "a long, b long")


def text_key(text: Column) -> Column:
    """A hash that tells texts that share a doc_id apart."""
    return F.xxhash64(text.cast("string"))


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = 4, cell_rows: int = CELL_ROWS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id, fp, component_id for each row of docs (doc_id, text; other columns are ignored), and text_key if keep has it.

    Documents link if their fingerprints differ in at most radius bits;
    component_id is the smallest doc_id of all documents that links reach. Null
    and blank texts have fingerprint 0 and link like others. Repeated rows give
    repeated results. A null doc_id is kept and is never the smallest unless
    alone. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    marked = scratch.save(fingerprints(rows, width, keep), "fingerprints")
    distinct = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    edges = scratch.save(links(distinct, radius, scratch, cell_rows), "links")
    found = connected_components(edges, scratch)
    of_fp = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = of_fp.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = of_fp.join(smallest, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(*keep, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 5, radius: int = 4) -> DataFrame:
    """docs without all but one document of each group: the one with the smallest doc_id stays, whole and unchanged.

    Rows equal in doc_id and text are one document and give one row, the least
    in order of the other columns as text. Of rows that share a doc_id, the one
    with the smallest hash of its text stands for the group. Rows without doc_id stay.
    """
    found = near_duplicates(docs, width, radius, keep=("doc_id", "text_key"))
    named = found.where("doc_id is not null").groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    kept = named.select(F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__key"))
    # what stays is most of the table, so what goes is joined
    gone = found.where("doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    gone = gone.join(kept, ["__id", "__key"], "left_anti").distinct()
    gone = Scratch(docs.sparkSession, "simhash").save(gone, "gone")
    same = (docs["doc_id"] == F.col("__id")) & (text_key(docs["text"]) == F.col("__key"))
    return _once(docs.join(small(gone), same, "left_anti").select(*docs.columns))


def _once(docs: DataFrame) -> DataFrame:
    """docs with one row for each (doc_id, text) that repeats; rows without doc_id stay."""
    key = text_key(docs["text"])
    times = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id"), key.alias("__key")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__id", "__key")
    times = Scratch(docs.sparkSession, "simhash").save(times, "repeated")
    if times.isEmpty():
        return docs
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (key == F.col("__key"))
    again = docs.join(small(times), same)
    others = F.to_json(F.struct(*[docs[c] for c in docs.columns]))
    one = again.groupBy("__id", "__key").agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), others).alias("r")).select("r.*")
    return docs.join(small(times), same, "left_anti").unionByName(one)


def op6_query(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs, width=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
