"""Cigar algebra as Column functions over array<struct<op string, len bigint>>.

All of it is row-local, so no shuffle follows from it. Offsets are half-open.
Offsets of operations are summed over whole Arrow batches; the rest is native.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations of alignments in PAF, and of ones in GAF.
PAF_OPS, GAF_OPS = "MIDX=", "MIDNSHPX="
CIGAR_TYPE = "array<struct<op:string,len:bigint>>"
PLACED_TYPE = "array<struct<op:string,len:bigint,q0:bigint,q1:bigint,t0:bigint,t1:bigint>>"


def parse(text: Column, ops: str = GAF_OPS, strict: bool = True) -> Column:
    """Operations of a cigar text such as 10M2I5M; null for null. strict raises on anything else in the text."""
    pattern = f"([0-9]+)([{ops}])"
    lens, kinds = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    out = F.zip_with(kinds, lens, lambda o, n: F.struct(o.alias("op"), n.cast("bigint").alias("len")))
    if not strict:
        return out
    bad = F.regexp_replace(text, pattern, "") != ""
    return F.when(bad, F.raise_error(F.concat(F.lit("not a cigar: "), F.substring(text, 1, 100))).cast(CIGAR_TYPE)).otherwise(out)


def to_text(cigar: Column) -> Column:
    return F.array_join(F.transform(cigar, lambda c: F.concat(c["len"].cast("string"), c["op"])), "")


def parse_cs(text: Column) -> Column:
    """array<struct<op,len,query,target>> of a difference string: :n equal, *xy changed from x to y, +s in the query only, -s in the target only."""
    parts = F.regexp_extract_all(text, F.lit(r"(:[0-9]+|\*[A-Za-z]{2}|[+-][A-Za-z]+)"), F.lit(1))

    def of(p: Column) -> Column:
        op, rest = F.substring(p, 1, 1), F.substring(p, 2, 1 << 30)
        n = F.when(op == ":", rest.try_cast("bigint")).when(op == "*", F.lit(1)).otherwise(F.length(rest))
        query = F.when(op == "*", F.substring(rest, 2, 1)).when(op == "+", rest).otherwise("")
        target = F.when(op == "*", F.substring(rest, 1, 1)).when(op == "-", rest).otherwise("")
        return F.struct(op.alias("op"), n.cast("bigint").alias("len"), query.alias("query"), target.alias("target"))

    return F.transform(parts, of)


def in_query(op: Column) -> Column:
    return op.isin("M", "I", "S", "=", "X")


def in_target(op: Column) -> Column:
    return op.isin("M", "D", "N", "=", "X")


def total(cigar: Column, *ops: str) -> Column:
    """The summed length of the operations ops, of all if none are named."""
    return F.aggregate(cigar, F.lit(0).cast("bigint"), lambda s, c: s + (F.when(c["op"].isin(*ops), c["len"]).otherwise(0) if ops else c["len"]))


def query_span(cigar: Column) -> Column:
    return total(cigar, "M", "I", "S", "=", "X")


def target_span(cigar: Column) -> Column:
    return total(cigar, "M", "D", "N", "=", "X")


def flip(cigar: Column) -> Column:
    return F.reverse(cigar)


def _row_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums of values within rows of the given sizes."""
    sums = np.cumsum(values)
    before = np.concatenate([[0], sums])[np.cumsum(sizes) - sizes]
    return sums - np.repeat(before, sizes)


def as_lists(values: pa.Array, sizes: np.ndarray, null: np.ndarray) -> pa.Array:
    """Rows of the given sizes; null marks rows without a value."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array(null))


def list_sizes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The size of each row's list, and whether the row is null."""
    return pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


def placed(cigar: Column) -> Column:
    """Each operation with the query and target bases before and after it: running sums over all rows of an Arrow batch, linear in their operations."""

    @F.arrow_udf(PLACED_TYPE)
    def place(column: pa.Array) -> pa.Array:
        sizes, null = list_sizes(column)
        flat = column.flatten()
        op, n = pc.struct_field(flat, "op"), pc.struct_field(flat, "len").to_numpy(zero_copy_only=False).astype(np.int64)
        out = [op, pa.array(n)]
        for kinds in ("MIS=X", "MDN=X"):  # those on the query, those on the target
            own = np.where(pc.is_in(op, pa.array(list(kinds))).to_numpy(zero_copy_only=False), n, 0)
            after = _row_sums(own, sizes)
            out += [pa.array(after - own), pa.array(after)]
        return as_lists(pa.StructArray.from_arrays(out, ["op", "len", "q0", "q1", "t0", "t1"]), sizes, null)

    return place(cigar)


def cut_query(placed_: Column, start: Column, end: Column) -> Column:
    """Operations within the query window [start, end): those on the query are cut to it, others stay if strictly inside."""

    def keep(c: Column) -> Column:
        on = in_query(c["op"])
        lo, hi = F.greatest(c["q0"], start), F.least(c["q1"], end)
        shift = F.when(in_target(c["op"]) & on, lo - c["q0"]).otherwise(0)
        n = F.when(on, hi - lo).when((start < c["q0"]) & (c["q0"] < end), c["len"]).otherwise(0)
        t1 = c["t0"] + shift + F.when(in_target(c["op"]), n).otherwise(0)
        return F.struct(c["op"].alias("op"), n.alias("len"), lo.alias("q0"), hi.alias("q1"), (c["t0"] + shift).alias("t0"), t1.alias("t1"))

    return F.filter(F.transform(placed_, keep), lambda c: c["len"] > 0)


def cut_target(placed_: Column, start: Column, end: Column) -> Column:
    """Operations within the target window [start, end). One without target bases goes to the window that starts at or before it and ends after it."""

    def keep(c: Column) -> Column:
        on = in_target(c["op"])
        lo, hi = F.greatest(c["t0"], start), F.least(c["t1"], end)
        shift = F.when(in_query(c["op"]) & on, lo - c["t0"]).otherwise(0)
        n = F.when(on, hi - lo).when((start <= c["t0"]) & (c["t0"] < end), c["len"]).otherwise(0)
        q1 = c["q0"] + shift + F.when(in_query(c["op"]), n).otherwise(0)
        return F.struct(c["op"].alias("op"), n.alias("len"), (c["q0"] + shift).alias("q0"), q1.alias("q1"), lo.alias("t0"), hi.alias("t1"))

    return F.filter(F.transform(placed_, keep), lambda c: c["len"] > 0)


def plain(placed_: Column) -> Column:
    """A placed cigar without its offsets."""
    return F.transform(placed_, lambda c: F.struct(c["op"].alias("op"), c["len"].alias("len")))


def match_blocks(placed_: Column) -> Column:
    """The placed operations that pair bases (M, =, X)."""
    return F.filter(placed_, lambda c: c["op"].isin("M", "=", "X"))


def small_gap_bases(cigar: Column, max_gap: int) -> Column:
    """Inserted bases of runs of gaps between matches in which both the inserted and the deleted bases stay under max_gap.

    A run counts only if matches stand on both sides of it.
    """
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit(False).alias("seen"), zero.alias("ins"), zero.alias("del"), zero.alias("sum"))

    def step(s: Column, c: Column) -> Column:
        match = c["op"].isin("M", "=", "X")
        counted = s["seen"] & (s["ins"] < max_gap) & (s["del"] < max_gap)
        return F.struct(
            (s["seen"] | match).alias("seen"),
            F.when(match, zero).otherwise(s["ins"] + F.when(c["op"] == "I", c["len"]).otherwise(0)).alias("ins"),
            F.when(match, zero).otherwise(s["del"] + F.when(c["op"] == "D", c["len"]).otherwise(0)).alias("del"),
            (s["sum"] + F.when(match & counted, s["ins"]).otherwise(0)).alias("sum"),
        )

    return F.aggregate(cigar, start, step, lambda s: s["sum"])


def as_matches(cigar: Column) -> Column:
    """X and = as M, runs as they are."""
    return F.transform(cigar, lambda c: F.struct(F.when(c["op"].isin("X", "="), "M").otherwise(c["op"]).alias("op"), c["len"].alias("len")))
